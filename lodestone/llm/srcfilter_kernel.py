"""Pure-Python kernel of the hand-written-source filter: evidence of one chunk of a file.

Layout statistics are additive (sums and maxima), so a file's chunks can be reduced in any
order and partially before a shuffle.  Banners count in the first lines of a file and in
its whole leading comment block, which may go on over several chunks.
"""

from __future__ import annotations

import re

PROSE = frozenset(("md", "markdown", "rst", "txt", "adoc", "tex"))

#: Additive evidence of a chunk, in the order ``features`` returns it.
SUMS = ("n_chars", "n_lines", "n_code_lines", "n_space", "n_alnum", "n_digit", "n_numeric", "n_words", "n_encoded", "n_idiom", "n_long")
MAXES = ("max_line", "max_run", "banner_generated", "banner_foreign", "lead_generated", "lead_foreign", "code", "top")

#: Lines are maxima with their sign changed, so that the first one of a file remains; NEVER: none.
NEVER = -(1 << 40)
HEAD_LINES = 12  # lines at the top of a file in which a banner may stand

_COMMENT_LINE = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|;|%|\"\"\"|'''|@|$)")

#: Statements that a program wrote the file.
_GENERATED = re.compile(
    r"\b(?:(?:file|code|source|header|module|script|parser|lexer|binding|wrapper)s?\s+(?:(?:is|was|were|has been|are)\s+)?(?:auto(?:matically|-)?\s?|machine[- ])?generated\s+(?:by|from|with|using|on)\b"
    r"|(?:auto(?:matically)?[- ]?)generated\s+(?:by|from|with|using|file|code|source|header)\b(?!.{0,30}\bis checked\b)"
    r"|generated\s+(?:automatically\s+)?(?:by|from|with)\s+[\w.+-]+"
    r"|(?:this|the)\s+file\s+(?:was|is|has been)\s+(?:produced|created|written|made|emitted|built|compiled)\s+(?:automatically\s+)?(?:by|from|with)\b"
    r"|machine[- ](?:made|generated|written)\s+(?:output|file|code)\b|output\s+of\s+(?:the\s+)?[\w+-]+\s+v?\d"
    r"|created\s+by:?\s+.{0,40}\bcompiler\b|regenerate\s+(?:with|using|by)\b|(?:all\s+)?(?:manual\s+)?(?:edits|changes|modifications)\s+(?:to this file\s+)?(?:will\s+(?:be\s+)?(?:lost|overwritten|vanish)|vanish|are lost|get lost)"
    r"|automatisch\s+(?:aus|von|durch|mit)\s+.{1,60}\s+(?:erzeugt|generiert|erstellt)|automatisch\s+(?:erzeugt|generiert|erstellt)\s+(?:aus|von|mit|durch)"
    r"|(?:fichier|code)\s+(?:a été\s+)?(?:généré|produit|créé)\s+(?:automatiquement\s+)?(?:par|à partir)|généré\s+automatiquement"
    r"|(?:archivo|código|fichero)\s+(?:fue\s+|ha sido\s+)?generado\s+(?:automáticamente\s+)?(?:por|a partir|con)|generado\s+automáticamente)"
    r"|<auto-?generated\b|(?<![\w.])@generated\b|\bdo\s+not\s+(?:edit|modify|change)(?:\s+(?:this\s+(?:file|code)|by hand|manually|directly))?\s*(?:[.!*\-]|$)", re.I
)
#: Statements that the file is a copy of somebody else's code.
_FOREIGN = re.compile(
    r"\bvendored\s+(?:from|copy)\b|\bcopyright\b.{0,60}\b(?:project|authors|contributors|foundation|inc|ltd|gmbh|corp(?:oration)?|developers|community)\b|\bcopyright\s*(?:\(c\)|©)?\s*(?:19|20)\d\d.{0,60}\ball rights reserved\b"
    r"|\bupstream\s+(?:release|version|copy|commit|tag|sources?)\b|\bsee\s+the\s+[\w-]+\s+home\s?page\b|\bsingle[- ]header\s+library\b|\bpermission\s+(?:to use|is hereby granted)\b|\bno\s+warranty\s+implied\b"
    r"|\b(?:redistribution|use)\s+.{0,40}\b(?:covered by|permitted)\b|\b(?:imported|copied|taken|mirrored)\s+(?:verbatim\s+|unchanged\s+)?from\s+(?:https?:|the\s+[\w-]+\s+(?:project|library|repository|distribution)|upstream)\b"
    r"|\bthird[- ]party\s+(?:code|library|source|copy|software)\b.{0,40}\b(?:do not|unmodified|version|copied)\b|\blocal patches:", re.I
)
#: Directories in which foreign code is kept.
_FOREIGN_DIR = re.compile(
    r"(?:^|/)(?:[\w.]*[_-])?(?:vendor(?:ed|s)?|third[_-]?party|3rd[_-]?party|extern(?:al|als|s)?|deps|dependencies|node_modules|bower_components|site-packages|submodules|contrib[_-]libs|bundled(?:[_-]libs)?)(?:[_-]\w*)?/", re.I
)
#: Output directories and names of files that programs write.
_GENERATED_NAME = re.compile(
    r"(?:\.min\.(?:js|css|mjs)|[._-]bundle\.js|_pb2(?:_grpc)?\.py|\.pb\.(?:h|cc|go)|_generated\.\w+|\.g\.cs|\.designer\.cs|\.tab\.[ch]\w*|\.yy\.[ch]\w*|\.lex\.c|_wrap\.(?:c|cxx|cpp)|(?:^|/)moc_[^/]*\.cpp|(?:^|/)ui_[^/]*\.(?:py|h)|(?:^|/)qrc_[^/]*\.(?:py|cpp))$", re.I
)
#: Idioms no one writes by hand: parser tables, wrapper glue, widget set-up, serialised schemas, meta objects, proxies.
_IDIOM = re.compile(
    r"\byy(?:table|check|defact|pact|stos|r1|r2|translate|lookahead|parse|state|char|errlab|setstate|newstate|default|reduce)\b|\bYY_?[A-Z]+\b|\b_wrap_\w+|\bSWIG\w*|\bWrap_ConvertPtr\b|\bwrap_type_info\b|(?<=\w)INTERN\b"
    r"|\.setObjectName\(|\bretranslateUi\b|\b_serialized_(?:start|end)\b|\bAddSerializedFile\b|\bqt_meta_\w+|\bstaticMetaObject\b|PINVOKE\b|\bExceptionPending\b|\bHandleRef\b|__OVERLOAD_\d"
    r"|^\s*#\s*define\s+[A-Z][A-Z0-9]*_HAS_\w+\s+[01]\s*$", re.M
)
#: Every match of _IDIOM has one of these in it; texts without any are not searched.
_IDIOM_PARTS = (
    "yy", "YY", "_wrap_", "SWIG", "Wrap_ConvertPtr", "wrap_type_info", "INTERN", ".setObjectName(", "retranslateUi", "_serialized_", "AddSerializedFile", "qt_meta_", "staticMetaObject", "PINVOKE",
    "ExceptionPending", "HandleRef", "__OVERLOAD_", "_HAS_",
)
#: A literal begins with a digit or point behind no word; the first character comes first, so that the search can skip to it.
_NUMERIC = re.compile(r"[0-9.](?<![\w.].)(?:(?<=\.)[0-9]+|(?<=0)[xX][0-9a-fA-F]+|(?<=[0-9])[0-9]*(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)[fFuUlL]{0,3}(?![\w.])", re.S)
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{48,}|(?:\\x[0-9a-fA-F]{2}){12,}|(?:0x[0-9a-fA-F]{1,8}, ?){12,}")
_WORDY = re.compile(r"[A-Za-z]{3,}")
_NO_ALNUM = bytes(c for c in range(128) if not chr(c).isalnum())
_NO_DIGITS = bytes(c for c in range(128) if not chr(c).isdigit())


def extension(path: str | None) -> str:
    base = (path or "").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[-1].lower() if "." in base else ""


def in_scope(path: str | None) -> bool:
    return bool(path) and not path.startswith("forum/") and extension(path) not in PROSE


def banners(text: str, line: int | None) -> tuple[int, int]:
    """Whether the comments at the top of the file name a generator or another project."""
    if line is not None and line > HEAD_LINES:
        return 0, 0
    head = []
    inside = False
    for raw in text.split("\n", HEAD_LINES)[:HEAD_LINES]:
        s = raw.strip()
        if inside or _COMMENT_LINE.match(raw):
            head.append(s)
            if "/*" in s:
                inside = True
            if "*/" in s:
                inside = False
        else:
            break
    top = "\n".join(head)
    if not top:
        return 0, 0
    return int(bool(_GENERATED.search(top))), int(bool(_FOREIGN.search(top)))


def leading(text: str, line: int | None) -> tuple[int, int, int]:
    """Signed lines of the first generator and foreign statement in the comments the chunk begins with, and of its first code.

    A statement belongs to the leading block of the file if no chunk has code before it and the top of the file is there.
    """
    at = max(line or 1, 1)
    close = text.find("*/")
    inside = at > 1 and 0 <= close and text.find("/*", 0, close) < 0  # the chunk begins within a comment
    head: list[str] = []
    code = NEVER
    for n, raw in enumerate(text.split("\n")):
        if inside or _COMMENT_LINE.match(raw):
            s = raw.strip()
            head.append(s)
            if "/*" in s:
                inside = True
            if "*/" in s:
                inside = False
        else:
            code = -(at + n)
            break
    top = "\n".join(head)

    def first(pattern: re.Pattern) -> int:
        m = pattern.search(top) if top else None
        return -(at + top.count("\n", 0, m.start())) if m else NEVER

    return first(_GENERATED), first(_FOREIGN), code


def features(text: str | None, line: int | None) -> tuple[int, ...]:
    """Sums, then maxima, of one chunk."""
    if not text:
        return (0,) * (len(SUMS) + len(MAXES) - 4) + (NEVER, NEVER, -max(line or 1, 1), NEVER)  # unseen text may be code
    lines = text.split("\n")
    lengths = [len(x) for x in lines]
    compact = "".join(text.split())
    ascii_only = compact.encode("ascii", "ignore")
    alnum = len(ascii_only.translate(None, _NO_ALNUM))
    digits = len(ascii_only.translate(None, _NO_DIGITS))
    filled = sum(1 for x in lines if x and not x.isspace())
    encoded = run = 0
    if max(lengths) >= 48:
        for m in _ENCODED.finditer(text):
            n = m.end() - m.start()
            if any(c.isdigit() for c in m[0]):
                encoded += n
                run = max(run, n)
    numeric = len(_NUMERIC.findall(text)) if digits else 0
    words = len(_WORDY.findall(text))
    idioms = len(_IDIOM.findall(text)) if any(p in text for p in _IDIOM_PARTS) else 0
    gen, foreign = banners(text, line)
    return (
        len(text), len(lines), filled, len(text) - len(compact), alnum, digits, numeric, words, encoded, idioms, sum(1 for n in lengths if n > 500),
        max(lengths), run, gen, foreign, *leading(text, line), -max(line or 1, 1),
    )
