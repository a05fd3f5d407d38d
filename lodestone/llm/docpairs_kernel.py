"""Pure-Python kernel of the function/documentation pairing operator.

The kernel works on one chunk of source text at a time and never needs the rest of
the file, so it runs unchanged inside an Arrow batch on any executor.  Chunks may
start or end in the middle of a definition; nothing here requires parseable code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: File extensions of the supported languages; the extension decides, the columns
#: ``language`` and ``chunk_type`` are not trusted.
FAMILY_BY_EXT = {
    "py": "py",
    "c": "c", "h": "c", "cpp": "c", "cc": "c", "cxx": "c", "hpp": "c", "hh": "c", "hxx": "c", "cu": "c", "cuh": "c",
    "cs": "c",
}

#: Keywords that may be followed by ``(...) {`` without defining a function.
_NOT_A_NAME = frozenset(
    "if for while switch catch return sizeof alignof decltype do else new delete throw using lock fixed foreach "
    "unchecked checked static_assert defined assert co_return co_await co_yield requires alignas noexcept when".split()
)

MIN_NEW_WORDS = 5


@dataclass
class Function:
    name: str
    start: int  # first line of the definition, decorators and template lines excluded
    end: int  # last line
    anchor: int  # line above which a comment has to end
    params: list[str] = field(default_factory=list)
    body: int = -1  # line on which the body opens


@dataclass
class Comment:
    start: int
    end: int
    text: str
    kind: str  # "line", "block", "docstring" or "trailing" (behind code)
    owner: int = -1  # docstrings: index of the function they sit in


# --------------------------------------------------------------------------- C family

_C_TOKEN = re.compile(
    r"//[^\n]*|/\*|R\"([^()\\ ]{0,16})\(.*?\)\1\"|@\"(?:[^\"]|\"\")*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S
)


def _blank(s: str) -> str:
    return s if s.isspace() else re.sub(r"[^\n]", " ", s)


def _strip_c(text: str) -> tuple[str, list[Comment]]:
    """Code with comments and literals blanked out, and the comments by line."""
    out, pos, comments = [], 0, []
    line_at, counted = 0, 0

    def line_of(offset: int) -> int:
        nonlocal line_at, counted
        line_at += text.count("\n", counted, offset)
        counted = offset
        return line_at

    while m := _C_TOKEN.search(text, pos):
        a, b = m.span()
        head = text[a : a + 2]
        if head == "/*":
            close, nested = text.find("*/", b), text.find("/*", b)
            if close < 0 or 0 <= nested < close:  # never closed: only its own line is comment
                b = text.find("\n", a)
                b = len(text) if b < 0 else b
            else:
                b = close + 2
        if head in ("/*", "//"):
            first = line_of(a)
            alone = not text[text.rfind("\n", 0, a) + 1 : a].strip()
            last = first + text.count("\n", a, b)
            tail = text[b : (e if (e := text.find("\n", b)) >= 0 else len(text))]
            if not alone:
                comments.append(Comment(first, last, text[a:b], "trailing"))
            elif not (head == "/*" and tail.strip()):
                comments.append(Comment(first, last, text[a:b], "block" if head == "/*" else "line"))
        out.append(text[pos:a])
        out.append(_blank(text[a:b]))
        pos = b
    out.append(text[pos:])
    return "".join(out), comments


_C_NAME = re.compile(r"(~?[A-Za-z_]\w*(?:\s*<[^<>(){};]*>)?|operator\s*(?:\(\s*\)|\[\s*\]|[^\s\w(]{1,3}|\w+))\s*\(")
_C_AFTER = re.compile(
    r"(?:\s*(?:const\b|volatile\b|noexcept\b(?:\s*\([^()]*\))?|override\b|final\b|throw\s*\([^()]*\)|&&?|"
    r"->\s*[\w:<>,*&\s]+?|where\s+\w+\s*:[^{;]*|requires[^{;]*|try\b|\[\[[^\]]*\]\]))*\s*(?=[{:])"
)
_C_PARAM = re.compile(r"([A-Za-z_]\w*)\s*(?:=[^,]*)?(?:\[[^\]]*\])?\s*$")


def _match(code: str, at: int, open_: str, close: str) -> int:
    depth = 0
    for m in re.compile(f"[{re.escape(open_ + close)}]").finditer(code, at):
        depth += 1 if m[0] == open_ else -1
        if depth == 0:
            return m.start()
    return -1


def _c_functions(code: str) -> list[Function]:
    found = []
    lines_before = [0]
    for m in re.finditer("\n", code):
        lines_before.append(m.end())
    import bisect

    line_of = lambda o: bisect.bisect_right(lines_before, o) - 1
    pos = 0
    while m := _C_NAME.search(code, pos):
        pos = m.end()
        name = re.sub(r"\s*<.*", "", m[1], flags=re.S).strip() if not m[1].startswith("operator") else re.sub(r"\s+", "", m[1])
        if name in _NOT_A_NAME:
            continue
        # the statement the name belongs to starts after the previous ; { } or label
        begin = max(code.rfind(c, 0, m.start()) for c in ";{}") + 1
        head = code[begin : m.start()]
        for lab in re.finditer(r"(?:public|private|protected|internal|signals|slots)\s*:(?!:)", head):
            begin += lab.end()
            head = code[begin : m.start()]
            break
        while pp := re.match(r"\s*#[^\n]*\n", head):  # preprocessor lines end at their line end
            begin += pp.end()
            head = code[begin : m.start()]
        if re.search(r"[=!?+/%^|.(]|->|\breturn\b|\bnew\b|\bcase\b|\belse\b|\bgoto\b", re.sub(r"\[\[[^\]]*\]\]|<[^<>]*>|template\s*<[^;{}]*?>|\[[^\]]*\]|\balignas\s*\([^()]*\)", "", head)):
            continue
        close = _match(code, m.end() - 1, "(", ")")
        if close < 0:
            continue
        after = _C_AFTER.match(code, close + 1)
        if not after:
            continue
        brace = after.end()
        if code[brace] == ":":
            if code[brace : brace + 2] == "::":
                continue
            depth, i = 0, brace + 1  # constructor initialisers up to the body
            while i < len(code) and not (code[i] == "{" and depth == 0 and re.search(r"[\)}]\s*$", code[brace:i])):
                if code[i] in "([{":
                    depth += 1
                elif code[i] in ")]}":
                    depth -= 1
                elif code[i] == ";" and depth == 0:
                    break
                i += 1
            if i >= len(code) or code[i] != "{":
                continue
            brace = i
        if not head.strip() and begin > 0 and not re.match(r"[A-Z~]|operator", name):
            # no return type: a call followed by a block macro, not a definition
            continue
        first = begin + len(head) - len(head.lstrip()) if head.strip() else m.start()
        anchor_line = line_of(first)
        end = _match(code, brace, "{", "}")
        params = []
        for part in re.split(r",(?![^<(]*[>)])", code[m.end() : close]):
            if p := _C_PARAM.search(part.strip()):
                params.append(p[1])
        found.append(Function(name, line_of(m.start()), line_of(end if end >= 0 else len(code)), anchor_line, params, line_of(brace)))
        pos = brace + 1
    return found


# --------------------------------------------------------------------------- Python

_PY_STRING = re.compile(r"#[^\n]*|[rRbBuUfF]{0,2}(\"\"\"|''')|[rRbBuUfF]{0,2}(\"|')")
_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*\(", re.M)
_PY_PARAM = re.compile(r"[^\W\d]\w*")


def _strip_py(text: str) -> tuple[str, dict[int, tuple[int, str]], list[Comment]]:
    """Blanked code; string literals by their first offset; stand-alone comments."""
    out, pos, strings, comments = [], 0, {}, []
    while m := _PY_STRING.search(text, pos):
        a = m.start()
        if m[0][0] == "#":
            b = m.end()
            n = text.count("\n", 0, a)
            comments.append(Comment(n, n, text[a:b], "trailing" if text[text.rfind("\n", 0, a) + 1 : a].strip() else "line"))
        elif m[1]:
            b = _close(text, m.end(), m[1])
            strings[a] = (b, text[m.end() : b - 3])
        else:
            q, b = m[2], m.end()
            while b < len(text) and text[b] not in (q, "\n"):
                b += 2 if text[b] == "\\" else 1
            b = min(b + 1, len(text)) if b < len(text) and text[b] == q else min(b, len(text))
            strings[a] = (b, text[m.end() : b - 1])
        out.append(text[pos:a])
        out.append(_blank(text[a:b]) if m[0][0] == "#" else "\"" + _blank(text[a + 1 : b - 1]) + "\"" if b - a > 1 else " ")
        pos = b
    out.append(text[pos:])
    return "".join(out), strings, comments


def _close(text: str, at: int, quote: str) -> int:
    while True:
        e = text.find(quote, at)
        if e < 0:
            return len(text)
        back = 0
        while text[e - 1 - back] == "\\":
            back += 1
        if back % 2 == 0:
            return e + 3
        at = e + 1


def _py_functions(text: str) -> tuple[list[Function], list[Comment], list[str]]:
    code, strings, comments = _strip_py(text)
    comments = _merge(comments)
    functions: list[Function] = []
    total = text.count("\n")
    for m in _PY_DEF.finditer(code):
        close = _match(code, m.end() - 1, "(", ")")
        if close < 0:
            continue
        colon = re.compile(r"\s*(?:->[^:\n]*(?:\[[^\]]*\])?[^:\n]*)?:").match(code, close + 1)
        if not colon:
            continue
        start = code.count("\n", 0, m.start())
        indent = len(m[1].expandtabs())
        end = total
        n = code.count("\n", 0, colon.end())
        for line in code[colon.end() :].split("\n")[1:]:
            n += 1
            if line.strip() and len(line) - len(line.lstrip()) <= indent and not line.lstrip().startswith((")", "\"")):
                end = n - 1
                break
        params = [p for part in code[m.end() : close].split(",") if (g := _PY_PARAM.search(part)) and (p := g[0]) not in ("self", "cls")]
        anchor = start
        above = code.split("\n")[:start]
        while anchor > 0 and above[anchor - 1].lstrip().startswith("@"):
            anchor -= 1
        functions.append(Function(m[2], start, end, anchor, params, code.count("\n", 0, colon.end())))
        # the docstring is the first statement of the body
        body = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\s*\n)*[ \t]*").match(text, colon.end())
        at = body.end() if body else colon.end()
        while at < len(text) and text[at] == "#":  # comments may stand before it
            at = text.find("\n", at)
            if at < 0:
                at = len(text)
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
        if at in strings and "f" not in text[at : at + 2].lower().split("\"")[0].split("'")[0] and "b" not in text[at : at + 2].lower().split("\"")[0].split("'")[0]:
            stop, content = strings[at]
            line = text.count("\n", 0, at)
            comments.append(Comment(line, line + text.count("\n", at, stop), content, "docstring", len(functions) - 1))
    return functions, comments, code.split("\n")


# --------------------------------------------------------------------------- comment text

_MARKER = re.compile(r"^\s*(?:///?<?|//!<?|//|/\*[*!]*<?|\*/|\*+(?!\*)|#+:?)+[ \t]?|\s*\*+/\s*$")
_TAG_LINE = re.compile(
    r"^\s*(?:[@\\](?:t?param|return|returns|retval|throws?|exception|arg|author|date|version|since|see|sa|ingroup|"
    r"defgroup|addtogroup|file|todo|warning|note|tparam)\b|:(?:param|return|returns|rtype|type|raises|arg|keyword)\b|"
    r"<(?:param|returns|typeparam|exception|see|seealso)\b)", re.I
)
_SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Attributes|Keyword Args|See Also)\s*:?\s*$")
_DIRECTIVE = re.compile(
    r"\b(?:clang-format|clang-tidy|pylint|flake8|noqa|type:\s*ignore|mypy|NOLINT\w*|cppcheck|coverity|eslint|yapf|fmt:\s*o(?:n|ff)|"
    r"pragma|isort|nosec|GCOV_EXCL\w*|LCOV_EXCL\w*|IWYU|ReSharper|region|endregion)\b|^\s*-\*-", re.I
)
_POINTER = re.compile(
    r"^\W*(?:[{]?@inheritdoc[}]?|<inheritdoc\b.*|[@\\]copydoc\b.*|[@\\](?:see|sa)\b.*|see\s+(?:also\s+)?(?:the\s+)?(?:base|parent|super|header|above|below|declaration|interface|docs?\b|documentation)\b.*|"
    r"same as\s+\w+.*|overridden\b.*|overrides?\b.{0,40}|implements\s+\w+.{0,30}|documented (?:in|at)\b.*|siehe\b.{0,40}|voir\b.{0,40})\W*$", re.I
)
_PLACEHOLDER = re.compile(
    r"^\W*(?:todo|fixme|tbd|xxx|hack)\b.*$|^\W*(?:n/?a|none|no description|no documentation|undocumented|to be (?:documented|done|written)|write (?:docs?|me)|"
    r"description|docstring|documentation|doc|missing|dummy|placeholder)\b[\s:.\-]*(?:(?:write|add)?\s*(?:the\s+)?(?:docs?|document(?:ation|ed)?|description|this|later|me)?)\W*$", re.I
)
_BANNER = re.compile(
    r"\bcopyright\b|\ball rights reserved\b|\blicen[cs]e[ds]?\b|\bSPDX-|\bauto-?generated\b|\bautomatically generated\b|\bgenerated by\b|"
    r"\bdo not edit\b|\bproduced by\b.*\bfrom\b|\b(?:machine|tool|auto)[- ]?(?:made|generated|written|produced)\b|\bvendored from\b|\bpermission to use\b|\bno warranty\b|"
    r"\bthis (?:file|source|program) is (?:part of|free software)\b|\bunder the terms (?:of|in)\b|"
    r"^\W*(?:authors?|maintainers?|questions|contact)\s*[:=]|^\W*(?:written|maintained|contributed) by\b", re.I
)
_CODE_LINE = re.compile(
    r";\s*$|[{}]\s*$|^\s*(?:[\w.:\[\]]+(?:->|\.)\w+\s*\(.*\)|[\w.:\[\]]+\s*[-+*/]?=\s*[^=].*|(?:if|for|while|return|else|elif|def|class|import|from|print|switch|#\s*include)\b\s*[\w(<\"'].*[:;){>]?)\s*$"
)
_CODE_SURE = re.compile(r"[;{}]\s*$|\w\(.*\)\s*:?\s*$|^\s*\w[\w.\[\]]*\s*[-+*/]?=\s*\S+$|->\w|^\s*(?:import|from)\s+\w+(?:\s+import\b.*)?$|^\s*(?:return|break|continue|pass)\b(?:\s+[\w.]+)?$")
_TAG_WORD = re.compile(r"[@\\](?:brief|details|short|summary|remark[s]?|par|c|p|ref|note|return|returns)\b|</?(?:summary|remarks|para|c|see|code|b|i|br)\b[^>]*>", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def split_name(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)
    return {p.lower() for p in parts} | {name.lower()}


def description(comment: Comment) -> str:
    """The prose of a comment: markers, tags, parameter lists, directives and code removed."""
    keep, skipping, indent, code_lines, prose_lines = [], False, 0, 0, 0
    lines = comment.text.replace("\r", "").split("\n")
    in_doctest = False
    for raw in lines:
        line = raw if comment.kind == "docstring" else _MARKER.sub("", _MARKER.sub("", raw))
        bare = line.strip()
        if not bare:
            skipping = in_doctest = False
            continue
        if bare.startswith(">>>"):
            in_doctest = True
        if in_doctest:
            continue
        if _SECTION.match(bare):
            skipping, indent = True, len(line) - len(line.lstrip())
            continue
        if skipping:
            if len(line) - len(line.lstrip()) > indent:
                continue
            skipping = False
        if _TAG_LINE.match(bare):
            continue
        if not re.search(r"[^\W\d_]", bare) or _DIRECTIVE.search(bare) or _BANNER.search(bare) or _POINTER.match(bare):
            continue
        bare = _TAG_WORD.sub(" ", bare)
        if comment.kind != "docstring" and (_CODE_LINE.search(bare) and _CODE_SURE.search(bare) or re.search(r"\w\(\)?;|\)\s*\{$", bare)):
            code_lines += 1
            continue
        if _PLACEHOLDER.match(bare):
            continue
        if re.match(r"^[-=*~#+_]{2,}\s*\w[\w ]{0,30}\s*[-=*~#+_]{2,}$", bare):  # a titled divider
            continue
        prose_lines += 1
        keep.append(bare.strip())
    return " ".join(keep)


def is_informative(text: str, name: str, minimum: int = MIN_NEW_WORDS) -> bool:
    own = split_name(name)
    return sum(1 for w in _WORD.findall(text) if w.lower() not in own) >= minimum


# --------------------------------------------------------------------------- linking

_TAG_PARAM = re.compile(r"[@\\]t?param(?:\[[^\]]*\])?\s+(\w+)|:param\s+(?:\w+\s+)?(\w+)\s*:|<param\s+name\s*=\s*\"(\w+)\"|^\s{2,}(\w+)\s*(?:\([^)]*\))?:", re.M)


def _merge(comments: list[Comment]) -> list[Comment]:
    """Line comments on consecutive lines are one comment."""
    merged: list[Comment] = []
    for c in comments:
        last = merged[-1] if merged else None
        if last and c.kind == last.kind == "line" and c.start == last.end + 1:
            merged[-1] = Comment(last.start, c.end, last.text + "\n" + c.text, "line")
        else:
            merged.append(c)
    return merged


#: Costs of a link by the place of the comment; a link that costs more than REJECT is implausible.
PLACE_COST = {"docstring": -1.2, "above": -1.0, "gap": 0.8, "inside": 0.9, "trailing": 1.0}
DIRECT = ("docstring", "above")  # in touch with the definition
LINE_COST = 0.15  # a line between a comment and its function
TAG_COST = 0.5  # parameter tags that name none of the parameters
NAME_GAIN = 0.2  # the comment names the function
PARAM_GAIN = 0.2  # the comment names all parameters
REJECT = 1.9
_IDENTIFIER = re.compile(r"[^\W\d]\w*")
_BETWEEN = re.compile(r"\s*(?:template\s*<|\[\[?\w|@\w|__attribute__|__declspec|extern\s+\"C\")")


def _cost(f: Function, c: Comment, place: str, lines_between: int) -> float | None:
    """Cost of linking a comment to a function; None where the link is implausible.

    Far comments are rejected by their distance, and comments that are not in touch with the
    function also by parameter tags of which none is a parameter.
    """
    cost = PLACE_COST[place] + LINE_COST * lines_between
    tags = {t for m in _TAG_PARAM.findall(c.text) for t in m if t}
    if tags:
        agree = len(tags & set(f.params)) / len(tags)
        if not agree and place not in DIRECT:
            return None
        cost += TAG_COST * (1 - agree)
    low = c.text.lower()
    if f.name.lower() in low:
        cost -= NAME_GAIN
    if f.params:
        words = set(_IDENTIFIER.findall(low))
        cost -= PARAM_GAIN * sum(p.lower() in words for p in f.params) / len(f.params)
    return cost if cost < REJECT else None


def candidates(functions: list[Function], comments: list[Comment], code: list[str], python: bool) -> list[tuple[int, int, str, int]]:
    """(function, comment, place, lines between) of all comments in reach of each function.

    In reach are its docstring, every comment above it with no code between (attribute and
    template lines are none), comments inside it in front of its first statement, and
    comments behind the code of its signature.
    """
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    trailing: dict[int, list[int]] = {}
    found = []
    for j, c in enumerate(comments):
        if c.kind == "docstring":
            found.append((c.owner, j, "docstring", 0))
        elif c.kind == "trailing":
            trailing.setdefault(c.start, []).append(j)
        else:
            by_end.setdefault(c.end, []).append(j)
            by_start.setdefault(c.start, []).append(j)
    farthest = int((REJECT + NAME_GAIN + PARAM_GAIN - PLACE_COST["gap"]) / LINE_COST) + 1  # beyond it every link costs more than REJECT
    for k, f in enumerate(functions):
        i, gap, place = f.anchor - 1, 0, "gap" if python else "above"
        while i >= 0 and gap <= farthest:
            if i in by_end:
                for j in by_end[i]:
                    found.append((k, j, place, gap))
                    i = min(i, comments[j].start)
                place = "gap"
            elif not code[i].strip():
                gap, place = gap + 1, "gap"
            elif _BETWEEN.match(code[i]):
                gap += 1
            else:
                break
            i -= 1
        for line in range(f.anchor, f.body + 1):
            found += [(k, j, "trailing", 0) for j in trailing.get(line, ())]
        i, gap = f.body + 1, 0
        while i <= f.end and i < len(code) and not code[i].strip() and gap <= farthest:
            found += [(k, j, "inside", gap) for j in by_start.get(i, ())]
            i, gap = i + 1, gap + 1
    return found


def assign(costs: dict[tuple[int, int], float], n: int, m: int) -> dict[int, int]:
    """Cheapest maximum matching of functions to comments on a sparse bipartite graph.

    Successive shortest augmenting paths (Bellman-Ford on the residual graph): each
    round adds one link and may re-route earlier ones, which is exact.
    """
    left: dict[int, int] = {}
    right: dict[int, int] = {}
    by_left: dict[int, list[tuple[int, float]]] = {}
    for (i, j), w in costs.items():
        by_left.setdefault(i, []).append((j, w))
    for _ in range(min(n, m)):
        dist = {i: 0.0 for i in by_left if i not in left}
        come: dict[int, int] = {}
        dist_r: dict[int, float] = {}
        changed = True
        while changed:
            changed = False
            for i in list(dist):
                for j, w in by_left.get(i, ()):
                    if left.get(i) == j:
                        continue
                    if dist[i] + w < dist_r.get(j, float("inf")) - 1e-12:
                        dist_r[j], come[j] = dist[i] + w, i
                        changed = True
                        if j in right:
                            o = right[j]
                            dist[o] = dist_r[j] - costs[(o, j)]
        free = [(d, j) for j, d in dist_r.items() if j not in right]
        if not free:
            break
        j = min(free)[1]
        while True:
            i = come[j]
            before = left.get(i)
            left[i], right[j] = j, i
            if before is None:
                break
            j = before
    return left


def links(costs: dict[tuple[int, int], float]) -> dict[int, int]:
    """Cheapest one-to-one links of functions to comments, where staying alone costs REJECT.

    The graph falls apart into small components, each of which is solved by itself; a function
    and a comment that have only each other need no search.
    """
    of_left: dict[int, list[int]] = {}
    of_right: dict[int, list[int]] = {}
    for i, j in costs:
        of_left.setdefault(i, []).append(j)
        of_right.setdefault(j, []).append(i)
    out: dict[int, int] = {}
    done: set[int] = set()
    for first in of_left:
        if first in done:
            continue
        rows, columns, stack = [], set(), [first]
        done.add(first)
        while stack:
            i = stack.pop()
            rows.append(i)
            for j in of_left[i]:
                if j not in columns:
                    columns.add(j)
                    for o in of_right[j]:
                        if o not in done:
                            done.add(o)
                            stack.append(o)
        if len(rows) == len(columns) == 1:
            out[first] = of_left[first][0]
            continue
        part = {(i, j): costs[(i, j)] for i in rows for j in of_left[i]}
        part |= {(i, -1 - i): REJECT for i in rows}  # a place of its own for a function that stays alone
        out |= {i: j for i, j in assign(part, len(rows), len(columns) + len(rows)).items() if j >= 0}
    return out


@dataclass
class Pair:
    name: str
    start: int
    end: int
    text: str
    code: str
    place: str  # where the comment stands
    rivals: int  # further comments that were plausible for the function


def extension(path: str | None) -> str:
    if not path or path.startswith("forum/"):
        return ""
    base = path.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[-1].lower() if "." in base else ""


def pairs(path: str | None, text: str | None, min_words: int = MIN_NEW_WORDS, direct_only: bool = True) -> list[Pair]:
    """All documented functions of one chunk, in order of their first line.

    All comments in reach compete; ``direct_only`` then keeps the links in touch with their function.
    """
    family = FAMILY_BY_EXT.get(extension(path))
    if not family or not text or "(" not in text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if family == "py":
        if "def" not in text:
            return []
        functions, comments, code = _py_functions(text)
    else:
        if "{" not in text or "/" not in text:
            return []
        blanked, comments = _strip_c(text)
        comments = _merge(comments)
        if not comments:
            return []
        functions = _c_functions(blanked)
        code = blanked.split("\n")
    if not functions or not comments:
        return []
    costs: dict[tuple[int, int], float] = {}
    place_of: dict[tuple[int, int], str] = {}
    described: dict[int, str] = {}
    for k, j, place, between in candidates(functions, comments, code, family == "py"):
        if j not in described:
            described[j] = description(comments[j])
        if is_informative(described[j], functions[k].name, min_words) and (w := _cost(functions[k], comments[j], place, between)) is not None:
            if w < costs.get((k, j), REJECT):
                costs[(k, j)], place_of[(k, j)] = w, place
    if not costs:
        return []
    degree: dict[int, int] = {}
    for k, _ in costs:
        degree[k] = degree.get(k, 0) + 1
    source = text.split("\n")
    out = []
    for k, j in sorted(links(costs).items(), key=lambda x: (functions[x[0]].start, x[0])):
        f = functions[k]
        if direct_only and place_of[(k, j)] not in DIRECT:
            continue
        out.append(Pair(f.name, f.start, f.end, described[j], "\n".join(source[f.start : f.end + 1]), place_of[(k, j)], degree[k] - 1))
    return out
