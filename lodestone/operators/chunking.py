"""Files cut into line-addressed chunks.

Cutting depends on the lines before, so it is done per file inside Arrow batches; files
are rows, nothing is shuffled.  Python files are cut by their syntax tree, C and C++ files
by a scanner of braces and declarations, everything else by windows of lines.  Windows
over rows of text that are already loaded are also available as built-ins in SQL form
(``plans.catalog`` checks them against a recursive query).
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..runtime import ship, spread

_IMPORTS = (ast.Import, ast.ImportFrom)
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

Chunk = tuple[int, str, str, str]  # line, text, symbol, chunk type


def windows(text: str, max_chars: int = V.MAX_CHARS, overlap: int = V.OVERLAP_LINES, strip: bool = False) -> list[tuple[int, str]]:
    """(line offset, text) of windows of whole lines; a short text is one window as it is.

    A window takes lines while it is shorter than ``max_chars``, so its last line may reach
    beyond; the next one starts ``overlap`` lines before its end, at least one line further.
    With ``strip`` windows are trimmed and a short text may be blank.
    """
    if len(text) <= max_chars:
        return [(0, text)] if strip or text.strip() else []
    rows = text.split("\n")
    before = list(accumulate((len(r) + 1 for r in rows), initial=0))  # characters in front of every line
    found = []
    start, stop = 0, 0
    while stop < len(rows):
        stop = min(bisect_left(before, before[start] + max_chars), len(rows))
        found.append((start, "\n".join(rows[start:stop])))
        start = max(stop - overlap, start + 1)
    pieces = ((line, piece.strip() if strip else piece) for line, piece in found)
    return [(line, piece) for line, piece in pieces if not piece.isspace() and piece]


def _whole(text: str, name: str) -> list[Chunk]:
    return [(1 + i, t, name, "file") for i, t in windows(text)]


def python_chunks(text: str, name: str) -> list[Chunk]:
    """Functions and classes with the file's imports in front, and the runs of statements between them."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _whole(text, name)
    lines = text.splitlines()
    source = lambda first, last: "\n".join(lines[first.lineno - 1 : last.end_lineno])
    header = "".join(source(n, n) + "\n" for n in body if isinstance(n, _IMPORTS))
    out: list[Chunk] = []
    rest = (n for n in body if not isinstance(n, _IMPORTS))  # imports do not end a run of statements
    for defines, group in groupby(rest, lambda n: isinstance(n, _DEFINITIONS)):
        nodes = list(group)
        if defines:
            parts = [(n, (header and header + "\n") + source(n, n), n.name, "class" if isinstance(n, ast.ClassDef) else "function") for n in nodes]
        else:
            parts = [(nodes[0], source(nodes[0], nodes[-1]), name, "module")]
        out += [(n.lineno + i, t, symbol, kind) for n, whole, symbol, kind in parts for i, t in windows(whole)]
    return out or _whole(text, name)


_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S)
_SPACE = re.compile(r"\s*")
_STOP = re.compile(r"[{};]")
_CONTAINER = re.compile(r"(?:inline\s+)?namespace\b[\w:\s]*$|extern\s*$")
_TYPE = re.compile(r"(class|struct)\s+(?:alignas\s*\([^)]*\)\s*|\[\[[^\]]*\]\]\s*)?([\w:]+(?:\s*<[^{}]*>)?)\s*(?:final\s*)?(?::[^:].*)?$", re.S)
_FUNCTION = re.compile(r"((?:[\w]+(?:<[^<>]*>)?\s*::\s*)*(?:~\s*)?(?:operator\s*(?:\(\s*\)|[^\s\w(]+|\w+)|\w+))\s*\(")
_OTHER = re.compile(r"(?:template|enum|union|typedef|using)\b")


def _brace_end(code: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def c_chunks(text: str, name: str, profile: V.Profile = V.GENERAL) -> list[Chunk]:
    """Classes, structs and functions outside of classes, each with the one comment right before it.

    Contract: export macros are blanked in the stored text; templates are left out; members
    stay inside their class; of a run of line comments only the last line belongs to the
    definition.  Files in which nothing is found are cut by windows.
    """
    source = re.sub(profile.export_macro, lambda m: " " * len(m[0]), text)
    comments: dict[int, int] = {}  # end -> start
    parts, last = [], 0
    for m in _SKIP.finditer(source):
        if m[0][0] == "/":
            comments[m.end()] = m.start()
        parts += [source[last : m.start()], re.sub(r"[^\n]", " ", m[0])]
        last = m.end()
    code = "".join(parts) + source[last:]
    starts = sorted(comments)
    out: list[Chunk] = []

    def add(a: int, b: int, symbol: str, kind: str) -> None:
        begin, body = a, source[a:b]
        i = bisect_right(starts, a) - 1
        if i >= 0 and not source[starts[i] : a].strip():
            begin = comments[starts[i]]
            body = source[begin : starts[i]].rstrip("\n") + "\n" + body
        line = source.count("\n", 0, begin) + 1
        out.extend((line + k, t, symbol, kind) for k, t in windows(body))

    at, open_containers = 0, 0
    while at < len(code):
        at = _SPACE.match(code, at).end()
        if at >= len(code):
            break
        if code[at] == "#":
            end = code.find("\n", at)
            while end > 0 and code[end - 1] == "\\":
                end = code.find("\n", end + 1)
            at = len(code) if end < 0 else end + 1
            continue
        stop = _STOP.search(code, at)
        if not stop:
            break
        head = code[at : stop.start()]
        if stop[0] == "}":
            open_containers = max(0, open_containers - 1)
            at = stop.end()
        elif stop[0] == ";":
            at = stop.end()
        elif _CONTAINER.match(head.rstrip()) or head.strip().startswith("extern") and "(" not in head:
            open_containers += 1
            at = stop.end()
        else:
            end = _brace_end(code, stop.start())
            bare = head.strip()
            if _OTHER.match(bare):
                pass
            elif (m := _TYPE.match(bare)) and "(" not in bare.split(":", 1)[0]:
                add(at, end, re.sub(r"\s+", "", m[2]), m[1])
            elif (m := _FUNCTION.search(head)) and "=" not in head[: m.start()]:
                add(at, end, re.sub(r"\s+", "", m[1]), "function")
            at = end
    return out or _whole(text, name)


def file_chunks(path: str, text: str, profile: V.Profile = V.GENERAL) -> list[tuple[int, str, str, str, str]]:
    """(line, text, symbol, language, chunk type) of one file."""
    base = path.rsplit("/", 1)[-1]
    extension = base.rsplit(".", 1)[-1].lower() if "." in base[1:] else ""
    language = "cmake" if base == "CMakeLists.txt" or base.endswith(".cmake") else V.LANGUAGE_OF_EXTENSION.get(extension, "")
    if language == "py":
        rows = python_chunks(text, base)
    elif language in ("cpp", "c"):
        rows, language = c_chunks(text, base, profile), "cpp"
    else:
        rows, language = _whole(text, base), language or "txt"
    return [(line, t, symbol, language, kind) for line, t, symbol, kind in rows]


_CHUNKS = "path string, chunk_ord int, line int, text string, symbol string, language string, chunk_type string"


def chunk_files(files: DataFrame, path_col: str = "path", text_col: str = "text", profile: V.Profile = V.GENERAL) -> DataFrame:
    """One row per chunk of every file: (path, chunk_ord, line, text, symbol, language, chunk_type).

    Rows without a path or text give no chunk.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, *c) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, c in enumerate(file_chunks(p, t, profile))]
            if rows:
                types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["path", "chunk_ord", "line", "text", "symbol", "language", "chunk_type"])

    work = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).filter(F.col("path").isNotNull() & F.col("text").isNotNull())
    return spread(work).mapInArrow(run, _CHUNKS)


def split_windows(
    rows: DataFrame, id_col: str, text_col: str = "text", max_chars: int = V.MAX_CHARS, overlap: int = V.OVERLAP_LINES, strip: bool = False
) -> DataFrame:
    """(id, window_no, line_offset, piece) of every text of a table."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, n, a, t) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (a, t) in enumerate(windows(x, max_chars, overlap, strip))]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["id", "window_no", "line_offset", "piece"])

    work = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return work.mapInArrow(run, "id bigint, window_no int, line_offset int, piece string").withColumnRenamed("id", id_col)


def language_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by the language that their path implies."""
    return chunks.groupBy(T.language_of(F.col("path")).alias("language_of_path")).agg(F.count("*").alias("chunks"))
