"""Generated, minified, vendored or data-only source files.

Evidence is gathered per chunk and reduced per file: layout statistics (line lengths,
white space, digits, numeric literals, encoded runs), banners at the top of the file and
idioms of known generators.  Thresholds depend on the language.  The reduction happens
once inside each Arrow batch and again as a partial aggregate, so a path that holds a
large part of all rows sends a few rows per task through the shuffle.

Defined results for odd input: rows without a path, posts (``forum/...``) and prose files
never count; NULL and empty texts are no evidence; repeated or overlapping chunks count
as often as they occur (all tests are shares or maxima); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import srcfilter_kernel as kernel
from .common import extension_of, need, spread

#: Limits of a language.  Data: shares of digits, encoded runs, numeric literals (among literals and words), and with a
#: long run of letters and digits.  Minified text: share of white space below ``space`` with a mean or longest line
#: beyond its limit; below ``dense`` the lines need not be long.  ``idioms``: generator idioms per line.
DEFAULT = {
    "digits": 0.25, "encoded": 0.30, "numeric": 0.60, "alnum": 0.93, "run": 60.0, "space": 0.07, "mean_line": 110.0, "line": 500.0, "dense": 0.02, "idioms": 0.20,
}
#: Hand-written C and C++ has few literals and much white space, C# still more; Python demos and scripts are full of numbers.
_C = DEFAULT | {"digits": 0.22, "numeric": 0.45, "space": 0.09, "line": 450.0, "dense": 0.06}
THRESHOLDS: dict[str, dict[str, float]] = {
    "c": _C,
    "h": _C | {"line": 480.0},
    "cpp": _C | {"digits": 0.24, "numeric": 0.55},
    "cs": _C | {"space": 0.14, "line": 120.0},
    "py": DEFAULT | {"digits": 0.24, "dense": 0.06},
    "js": DEFAULT | {"space": 0.09, "mean_line": 90.0, "line": 400.0},
    "css": DEFAULT | {"space": 0.09, "mean_line": 120.0, "line": 400.0, "digits": 0.45},
    "json": DEFAULT | {"digits": 0.50},
    "svg": DEFAULT | {"digits": 0.50},
}
#: Extensions of the same language.
SAME_AS = {"cc": "cpp", "cxx": "cpp", "cu": "cpp", "hpp": "h", "hh": "h", "hxx": "h", "cuh": "h", "mjs": "js", "pyi": "py"}


def file_evidence(chunks: DataFrame, path_col: str = "path", text_col: str = "text", line_col: str = "line") -> DataFrame:
    """One row per source file with the reduced evidence."""
    need(chunks, path_col, text_col, line_col)
    source = spread(
        chunks.select(F.col(path_col).alias("path"), F.col(line_col).cast("int").alias("line"), F.col(text_col).alias("text")).filter(
            F.col("path").isNotNull() & ~F.col("path").startswith("forum/") & ~extension_of("path").isin(*kernel.PROSE)
        )
    )
    names = kernel.SUMS + kernel.MAXES
    schema = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in names)])
    n_sums = len(kernel.SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_path: dict[str, list[int]] = {}
            for path, line, text in zip(*(c.to_pylist() for c in batch.columns)):
                f = kernel.features(text, line)
                have = by_path.get(path)
                if have is None:
                    by_path[path] = list(f)
                else:
                    for k in range(n_sums):
                        have[k] += f[k]
                    for k in range(n_sums, len(f)):
                        have[k] = max(have[k], f[k])
            if by_path:
                columns = list(zip(*by_path.values()))
                yield pa.record_batch([pa.array(list(by_path), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    partial = source.mapInArrow(run, "path string, " + ", ".join(f"{n} bigint" for n in names))
    return partial.groupBy("path").agg(*(F.sum(n).alias(n) for n in kernel.SUMS), *(F.max(n).alias(n) for n in kernel.MAXES))


def _limit(name: str) -> Column:
    value = F.lit(DEFAULT[name])
    for language, own in THRESHOLDS.items():
        if own[name] != DEFAULT[name]:
            value = F.when(F.col("ext").isin(language, *(e for e, same in SAME_AS.items() if same == language)), F.lit(own[name])).otherwise(value)
    return value


def machine_files(chunks: DataFrame, path_col: str = "path", text_col: str = "text", line_col: str = "line") -> DataFrame:
    """(path, reason, layout) of every file that was not written by hand for this project.

    ``layout`` tells whether layout statistics alone show it; copies of foreign code and much
    generated code are laid out as any other, and only statements, names and idioms tell them.
    """
    e = file_evidence(chunks, path_col, text_col, line_col).withColumn("ext", extension_of("path"))
    visible = F.greatest(F.col("n_chars") - F.col("n_space"), F.lit(1))
    chars = F.greatest(F.col("n_chars"), F.lit(1))
    lines = F.greatest(F.col("n_code_lines"), F.lit(1))
    tokens = F.greatest(F.col("n_numeric") + F.col("n_words"), F.lit(1))
    space = F.col("n_space") / chars
    enough = F.col("n_chars") >= 200
    minified = enough & (
        (space < _limit("dense"))
        | (space < _limit("space")) & ((F.col("n_chars") / F.greatest(F.col("n_lines"), F.lit(1)) >= _limit("mean_line")) | (F.col("max_line") >= _limit("line")))
    )
    data = enough & (
        (F.col("n_digit") / visible >= _limit("digits")) | (F.col("n_encoded") / chars >= _limit("encoded"))
        | (F.col("n_numeric") / tokens >= _limit("numeric")) & (F.col("n_digit") / visible >= 0.2)
        | (F.col("n_alnum") / visible >= _limit("alnum")) & (F.col("max_run") >= _limit("run"))
    )
    headed = F.col("top") >= -kernel.HEAD_LINES  # without its top, a file's later comments prove nothing
    foreign = F.col("path").rlike("(?i)" + kernel._FOREIGN_DIR.pattern) | (F.col("banner_foreign") == 1) | headed & (F.col("lead_foreign") > F.col("code"))
    generated = (
        (F.col("banner_generated") == 1) | headed & (F.col("lead_generated") > F.col("code")) | F.col("path").rlike("(?i)" + kernel._GENERATED_NAME.pattern)
        | (F.col("n_idiom") / lines >= _limit("idioms")) & (F.col("n_idiom") >= 3)
    )
    reason = F.when(foreign, "foreign").when(minified, "minified").when(generated, "generated").when(data, "data")
    return e.select("path", reason.alias("reason"), (minified | data).alias("layout")).filter(F.col("reason").isNotNull())
