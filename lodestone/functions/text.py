"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

#: Python-compatible matching: only ``\n`` ends a line, classes are Unicode.
_FLAGS = "(?dU)"


def pattern(body: str, flags: str = "") -> str:
    """A pattern that behaves as in a language whose line end is ``\\n`` and whose classes are Unicode."""
    more = flags.replace("i", "iu")
    return f"(?dU{more})" + body


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, pattern(r"^\s+|\s+\z"), "")


def right_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, pattern(r"\s+\z"), "")


def tokenize(c: Column) -> Column:
    """Lower-case identifiers followed by their snake and camel parts; duplicates stay."""
    runs = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))

    def parts(raw: Column) -> Column:
        whole = F.lower(raw)
        pieces = F.transform(F.split(raw, r"_|(?<=[a-z0-9])(?=[A-Z])"), F.lower)
        return F.concat(F.array(whole), F.filter(pieces, lambda p: (p != "") & (p != whole)))

    return F.flatten(F.transform(runs, parts))


def token_bag(c: Column) -> Column:
    """The tokens of ``tokenize`` in another order: first all runs, then the parts of those that have any.

    Only runs with an underscore or a change of case are taken apart, which are few.
    """
    whole = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    composed = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]*(?:_|[a-z0-9](?=[A-Z]))[A-Za-z0-9_]*"), F.lit(0))
    parts = F.flatten(F.transform(composed, lambda r: F.transform(F.split(r, r"_|(?<=[a-z0-9])(?=[A-Z])"), F.lower)))
    return F.concat(whole, F.array_remove(parts, ""))


def query_identifiers(c: Column) -> Column:
    """Identifiers of a query in order, split at ``::`` and ``.``, lower case."""
    runs = F.regexp_extract_all(c, F.lit(pattern(r"[A-Za-z_][\w:]*")), F.lit(0))
    return F.filter(F.flatten(F.transform(runs, lambda r: F.split(F.lower(r), r"::|\."))), lambda p: p != "")


def symbol_keys(c: Column) -> Column:
    """A symbol and its last part, lower case, without empty keys and duplicates."""
    low = F.lower(F.coalesce(c, F.lit("")))
    keys = F.array(low, F.element_at(F.split(low, r"::|\."), -1))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def looks_like_injection(c: Column) -> Column:
    """Whether a text tries to give instructions to a reader that is a model."""
    return F.coalesce(c.rlike(pattern("|".join(f"(?:{p})" for p in V.INJECTION_PATTERNS), "i")), F.lit(False))


def is_python_chunk(language: Column, path: Column, profile: V.Profile = V.GENERAL) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    found = F.coalesce(language, F.lit("")) == "py"
    for word in profile.python_path_words:
        found = found | low.contains(word)
    return found


def is_forum_chunk(language: Column, source: Column, profile: V.Profile = V.GENERAL) -> Column:
    return (F.coalesce(language, F.lit("")) == "forum") | (F.coalesce(source, F.lit("")) == profile.forum_source)


def is_python_query(query: Column, profile: V.Profile = V.GENERAL) -> Column:
    low = F.lower(query)
    found = low.rlike(pattern(profile.python_query_pattern))
    for word in profile.python_query_words:
        found = found | low.contains(word)
    return found


# ------------------------------------------------------------------ files


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; a leading dot does not count."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    base = basename(path)
    by_extension = F.create_map(*(F.lit(x) for kv in V.LANGUAGE_OF_EXTENSION.items() for x in kv))
    return F.when((base == "CMakeLists.txt") | base.endswith(".cmake"), "cmake").otherwise(
        F.coalesce(F.try_element_at(by_extension, extension(path)), F.lit(""))
    )


def is_wanted_file(path: Column, size: Column | None = None) -> Column:
    base = basename(path)
    skipped = F.lit(False)
    for part in V.SKIPPED_NAME_PARTS:
        skipped = skipped | base.contains(part)
    wanted = ~skipped & (extension(path).isin(*V.WANTED_EXTENSIONS) | base.isin(*V.WANTED_NAMES))
    return wanted if size is None else wanted & F.coalesce(size <= V.MAX_FILE_BYTES, F.lit(False))


def in_skipped_directory(path: Column, profile: V.Profile = V.GENERAL, names: tuple[str, ...] | None = None) -> Column:
    """Whether a directory on the way to the file is left out; the file's own name does not count."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(d) for d in names or profile.skipped_directories)))


# ------------------------------------------------------------------ mail


def normalized_subject(c: Column, profile: V.Profile = V.GENERAL) -> Column:
    for _ in range(3):
        c = F.regexp_replace(c, pattern(V.SUBJECT_PREFIX, "i"), "")
        c = F.regexp_replace(c, pattern(profile.subject_tag, "i"), "")
    return trimmed(c)


def is_install_topic(subject: Column, profile: V.Profile = V.GENERAL) -> Column:
    return normalized_subject(subject, profile).rlike(pattern(profile.install_topic, "i"))


def above_quotation(c: Column) -> Column:
    """The text in front of the first reply header block or attribution line."""
    return right_trimmed(F.regexp_replace(c, pattern(rf"(?:{V.REPLY_HEADER}|{V.ATTRIBUTION})[\s\S]*\z", "im"), ""))


def without_footer(c: Column) -> Column:
    return F.regexp_replace(c, pattern(V.LIST_FOOTER, "is"), "")


def without_emails(c: Column) -> Column:
    return F.regexp_replace(c, V.EMAIL, V.EMAIL_PLACEHOLDER.replace("$", r"\$"))


def without_sender(c: Column, sender: Column) -> Column:
    """Every word of the sender's name that is longer than two characters, replaced one after another."""
    words = F.filter(
        F.transform(F.split(trimmed(F.coalesce(sender, F.lit(""))), pattern(r"\s+")), lambda w: F.regexp_replace(w, r"^['\"]+|['\"]+$", "")),
        lambda w: F.length(F.regexp_replace(w, r"([^A-Za-z0-9_\u0080-￿])", r"\\$1")) > 2,
    )
    return F.reduce(
        words, c, lambda text, w: F.regexp_replace(text, F.concat(F.lit(r"(?U)\b\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b")), F.lit(V.NAME_PLACEHOLDER))
    )


def without_greeting_names(c: Column) -> Column:
    return F.regexp_replace(c, pattern(V.GREETING, "m"), "$1" + V.NAME_PLACEHOLDER)


def scrubbed(c: Column, sender: Column) -> Column:
    return without_greeting_names(without_sender(without_emails(without_footer(above_quotation(c))), sender))


def lines_of(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")


def without_quoted_lines(c: Column) -> Column:
    """Lines that do not start with ``>``; at most two blank lines in a row; trimmed."""
    kept = F.filter(lines_of(c), lambda x: ~x.rlike(pattern(r"^\s*>")))
    return trimmed(F.regexp_replace(F.array_join(kept, "\n"), pattern(r"(\n[^\S\n]*\n[^\S\n]*)(?:\n[^\S\n]*)+(?=\n)"), "$1"))


def sender_name(c: Column) -> Column:
    return F.regexp_replace(trimmed(F.regexp_replace(c, r"<[^>]*>", "")), r'^"+|"+$', "")


def html_to_text(c: Column) -> Column:
    """Tags to spaces; bodies of style and script elements go; entities stay for ``headers.unescape``."""
    no_code = F.regexp_replace(c, r"(?is)<(style|script)\b[^>]*>.*?</\1>", " ")
    return F.regexp_replace(no_code, r"<[^>]+>", " ")


# ------------------------------------------------------------------ versions, headings, numbers


def is_release_ref(ref: Column) -> Column:
    return ref.rlike(r"^v?\d+\.\d+(\.\d+)?$")


def channel_of(ref: Column) -> Column:
    return F.when(is_release_ref(ref), F.regexp_replace(ref, "^v+", "")).otherwise(F.regexp_replace(ref, r"[^A-Za-z0-9._-]+", "-"))


def version_label(version: Column, ref: Column, built_at: Column, profile: V.Profile = V.GENERAL) -> Column:
    """Label of a release, or of a development snapshot with reference and date."""
    short = F.substring_index(version, ".", 2)
    return F.when(is_release_ref(ref), F.concat(F.lit(profile.release_label), short)).otherwise(
        F.concat(F.lit(profile.snapshot_label), ref, F.lit(" snapshot "), built_at, F.lit(" (post-"), short, F.lit(" development)"))
    )


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(F.regexp_replace(line, pattern(r"^\s+"), ""), "^#+", 0))


def clamped_k(k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.least(F.greatest(k, F.lit(1)), F.lit(V.MAX_TOP_K))
