"""Pure-Python kernel that finds personal data in one text.

Emails, phones, document numbers and addresses are found by shape and label; persons by
the places where texts name them (mail headers, attribution lines, greetings, signatures,
authorship comments, set phrases), by the directory of members, and by repetition of a
name found in the same text.  Everything looks at whole texts.
"""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "person")

# ------------------------------------------------------------------ email

_EMAIL = re.compile(r"(?<![\w.+%@-])[A-Za-z0-9](?:[\w.+%-]*[\w+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![\w@-])")
#: ``K@v.T`` and the like: a matrix product with an attribute, no address.
_PRODUCT = re.compile(r"^[A-Za-z_]\w?@[A-Za-z_]\w?\.(?:T|H|I|A|data|real|imag|flat|shape|size|dtype|inv|copy|dot|sum|mean)$")
_HIDDEN = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*\w)?"
    r"(?:\s?(?:\[at\]|\(at\)|\{at\}|<at>|\[@\]|\(@\))\s?|\s(?:AT|_at_)\s)"
    r"[A-Za-z0-9][\w-]*(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\s?|\s(?:DOT|_dot_)\s)[A-Za-z0-9][\w-]*)+(?!\w)"
)
_HIDDEN_HINT = re.compile(r"\[at\]|\(at\)|\{at\}|<at>|[\[(]@[\])]| AT |_at_", re.I)
_HIDDEN_I = re.compile(_HIDDEN.pattern, re.I)

# ------------------------------------------------------------------ phone

_EXT = r"(?:[ ,;]{0,2}\b(?:ext\.?|extension|x|Durchwahl|DW|poste|int\.?)[ .:]{0,2}\d{1,6})?"
#: The first character comes first, so that the search can skip to it; what may not stand before it is looked up afterwards.
_PHONE = re.compile(
    r"[+(02-9](?<![\w.+/-].)(?<!\d .)(?:"
    r"(?<=\+)\d{1,3}(?:[ ./-]?\(0?\d{1,5}\))?(?:[ ./-]?\d{2,12}){1,6}"  # international
    r"|(?<=0)0\d{1,3}(?: \d{2,12}){2,6}"
    r"|(?<=\()\d{2,5}\)[ ./-]?\d{3,4}[ .-]?\d{3,6}"  # (area) number
    r"|(?<=[2-9])\d{2}([.-])\d{3}\1\d{4}"  # area-exchange-line
    r"|(?<=0)\d{2,5}[ /]\d{3,8}(?:[ -]\d{2,6})?"  # national with trunk zero
    r")" + _EXT + r"(?![\w]|[.-]\d)", re.I | re.S
)

# ------------------------------------------------------------------ numbers of documents

_SSN = re.compile(r"\d(?<![\w-].)\d\d-\d{2}-\d{4}(?![\w-])", re.S)
_NOT_SSN = re.compile(r"\b(?:step|steps|run|frame|element|node|part|build|version|commit|port|line|case|batch|sample|no|nr|key|id of|seed|page)\s*[.:#]?\s*$", re.I)
_LABELLED = re.compile(
    r"\b(?i:passport|reisepass(?:nummer)?|ausweis(?:nummer)?|pasaporte|social security|ssn|sin|nino|"
    r"tax(?:payer)?(?:[ -]?id(?:entification)?)?|tin|steuer-?id(?:entifikationsnummer)?|steuernummer|numéro fiscal|nif|"
    r"driv(?:er|er's|ers|ing)(?:['’]s)? ?licen[cs]e|führerschein(?:nummer)?|permis de conduire|"
    r"student(?:[ -]?id)?|matriculation|matrikel(?:nummer|nr\.?)?|enrol?lment|numéro d'étudiant|"
    r"national(?:[ -]?id(?:entity)?)?|identity card|id card|personalausweis(?:nummer)?|dni|nie|carte d'identité|"
    r"health insurance|versicherungs(?:nummer|nr\.?)|sécurité sociale)"
    r"(?i:\s*(?:no\.?|nr\.?|number|num\.?|nummer|id|n°|numéro|número|card|code|#)(?![a-z]))*\s*(?:is|ist|est|es)?\s*[:=#]?\s*"
    r"([A-Z]{1,3}\d{5,10}|\d{1,4}(?:[ -]\d{2,5}){1,5}|\d{5,14}|[A-Z]\d[A-Z]\d{2}[A-Z]\d{3,6}[A-Z]?|[A-Z]{1,3}-\d{2,4}-\d{2,4}(?:-[A-Z0-9]{1,3})?|\d{5,9}[A-Z])(?![\w])"
)
#: Beginnings of all labels, lower case.
_LABEL_STEMS = (
    "passport", "reisepass", "ausweis", "pasaporte", "social security", "ssn", "sin", "nino", "tax", "tin", "steuer", "numéro fiscal", "nif", "driv", "führerschein", "permis de conduire",
    "student", "matric", "matrik", "enrol", "numéro d'étudiant", "national", "identity card", "id card", "personalausweis", "dni", "nie", "carte d'identité", "health insurance", "versicherungs",
    "sécurité sociale",
)
#: What every number of _LABELLED with its five digits has (labels come in any case, so none is asked for).
_FIVE_DIGITS = re.compile(r"\d(?:[ -]?\d){4}|\d[A-Z]\d{2}[A-Z]\d{3}")
_LICENCE = re.compile(r"(?<![\w-])DL-\d{3}-\d{3}-[A-Z](?![\w-])")

# ------------------------------------------------------------------ address

_CAP = r"[A-ZÀ-ÞŁŚŽČŠ][^\W\d_]*(?:['’\-.][^\W\d_]+)*"
_TOWN = rf"{_CAP}(?:[ -]{_CAP}){{0,2}}"
_NO = r"\d{1,5}(?:[ ]?[a-zA-Z](?![\w])|-[A-Z](?![\w])|[-/]\d{1,4})?"
_UNIT = r"(?:Apt\.?|Apartment|Suite|Ste\.?|Unit|Flat|Room|Floor|Fl\.?|#)\s?\d{1,5}[A-Za-z]?"
_STREET_EN = r"(?:Street|St\.?|Lane|Ln\.?|Avenue|Ave\.?|Road|Rd\.?|Close|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Place|Pl\.?|Square|Sq\.?|Terrace|Way|Crescent|Row|Walk|Gardens|Mews|Parkway|Highway|Hill)"
_POST = r"(?:[A-Z]{1,2}-)?\d{4,5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}"
_TAIL_EN = rf"(?:,? {_UNIT})?(?:, (?:(?:{_POST}) )?{_TOWN}(?:,? [A-Z]{{2}})?(?: (?:{_POST}))?(?![\w]))?"
#: Forms of addresses, each tried only where one of its fixed words occurs.
_ADDRESSES = (
    (("St", "Lane", "Ln", "Ave", "Road", "Rd", "Close", "Dr", "Boulevard", "Blvd", "Court", "Ct", "Pl", "Sq", "Terrace", "Way", "Crescent", "Row", "Walk", "Gardens", "Mews", "Parkway", "Highway", "Hill"), re.compile(rf"(?<![\w.-]){_NO} (?:(?:North|South|East|West|Old|New|N\.?|S\.?|E\.?|W\.?) )?{_CAP}(?: {_CAP}){{0,2}}? {_STREET_EN}(?![\w]){_TAIL_EN}")),
    (("Box ",), re.compile(rf"(?<![\w-])P\. ?O\. ?Box \d{{1,6}}(?:, (?:(?:{_POST}) )?{_TOWN}(?: (?:{_POST}))?(?![\w]))?")),
    (("PO Box", "Postfach", "postale", "BP ", "Apartado", "Casilla"), re.compile(rf"(?<![\w-])(?:PO Box|Postfach|Boîte postale|BP|Apartado(?: de correos)?|Casilla) \d{{1,6}}(?:, (?:(?:{_POST}) )?{_TOWN}(?: (?:{_POST}))?(?![\w]))?")),
    (("rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée", "quai", "route", "cours", "passage", "square"), re.compile(rf"(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours|passage|square)(?: (?:du|de|des|de la|de l['’]|la|le|les|d['’]|l['’]))*[ ]?{_CAP}(?:[ -](?:de |du |des |la |le )?{_CAP}){{0,3}}(?:, (?:(?:{_POST}) )?{_TOWN}(?![\w]))?")),
    (("Calle", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Ronda", "Carrera", "C/"), re.compile(rf"(?<![\w-])(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Carrera|C/)(?: (?:de|del|la|las|los|el))* ?{_CAP}(?: (?:(?:de|del|la|las|los|el) )*{_CAP}){{0,3}},? \d{{1,4}}(?:, \d{{1,2}}[ºª°]\.? ?[A-Z]?(?![\w]))?(?:, (?:(?:{_POST}) )?{_TOWN}(?![\w]))?")),
    (("straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig ", "hof ", "graben "), re.compile(rf"(?<![\w-])[A-ZÄÖÜ][^\W\d_]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|hof|graben)(?: {_NO})(?:, (?:(?:{_POST}) )?{_TOWN}(?![\w]))?")),
    (("ul. ", "ulica ", "al. ", "os. "), re.compile(rf"(?<![\w-])(?:ul\.|ulica|al\.|os\.) {_CAP}(?: {_CAP})? \d{{1,4}}[a-zA-Z]?(?:/\d{{1,4}})?(?:, (?:\d{{2}}-\d{{3}} )?{_TOWN}(?![\w]))?")),
    (("via ", "viale ", "piazza ", "corso "), re.compile(rf"(?<![\w-])(?:via|viale|piazza|corso) (?:(?:del|della|dei|di) )?{_CAP}(?: {_CAP}){{0,2}},? \d{{1,4}}(?:, (?:(?:{_POST}) )?{_TOWN}(?![\w]))?")),
)

# ------------------------------------------------------------------ persons

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪŁŃŇŐŘŚŞŠŤŪŮŰŹŻŽА-ЯЁІЇЄҐ"
_L = r"[^\W\d_]"
#: A capitalised (or all-capital) word of a name; O'Brien and Double-Barrelled included.
_WORD = rf"(?:[OD]['’])?[{_UP}]{_L}+(?:['’]{_L}+)?(?:-(?:[OD]['’])?[{_UP}]{_L}+)*"
_PART = r"(?:van der|van den|van de|van|von der|von dem|von|de la|de las|de los|de|del|della|di|da|dos|du|le|la|ter|ten|zu|zur|bin|al|el|af|av|VAN DER|VAN DEN|VAN DE|VAN|VON DER|VON|DE LA|DE|DEL|DI|DA|DU|TER|TEN)"
_INIT = rf"[{_UP}]\.(?:[ -]?[{_UP}]\.){{0,2}}"
#: First name, initials, particle and surname in any order, or "Surname, First".
_FULL = (
    rf"(?:(?:{_PART} )?{_WORD}, {_WORD}(?: {_INIT})?|{_WORD}, {_INIT}|"
    rf"{_INIT} (?:{_PART} )?{_WORD}(?: {_WORD})?|{_WORD}(?: {_INIT})? (?:{_PART} )?{_WORD}(?: {_WORD})?|{_WORD} {_INIT})"
)
_ANY = rf"(?:{_FULL}|(?:{_PART} )?{_WORD})"
_NO_COMMA = rf"(?:{_INIT} (?:{_PART} )?{_WORD}(?: {_WORD})?|{_WORD}(?: {_INIT})? (?:{_PART} )?{_WORD}(?: {_WORD})?|(?:{_PART} )?{_WORD})"
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Mx|Ing|Dipl\.-Ing|Sr|Sra|Mme|M|Herr|Frau|Doktor|Professor|Señora?|Don|Doña|Madame|Monsieur)\.? )*"

#: Words that greetings address without naming anyone.
_NOBODY = frozenset(
    "all list everyone everybody there team group folks friends colleagues experts developers users community guys people sir madam zusammen alle kollegen "
    "tous toutes todos todas amigos leute miteinander forum members again anyone somebody world".split()
)
#: Capitalised words that may stand directly in front of a name and are no part of it.
_LEADING = frozenset(
    "Hi Hello Hey Hallo Dear Bonjour Bonsoir Salut Hola Moin Servus Ciao Thanks Thank Danke Merci Gracias Saludos Liebe Lieber Liebes Sehr Estimado Estimada Querido Querida Cher Chère Good Guten Buenos Buenas "
    "Quoting Zitat Citando On At Le El Am Il Op Den AM PM Uhr GMT UTC CET CEST Mon Tue Wed Thu Fri Sat Sun Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "Jan Feb Mar Apr May Jun Jul Aug Sep Sept Oct Nov Dec January February March April June July August September October November December "
    "Januar Februar März Mai Juni Juli Oktober Dezember Mo Di Mi Do Fr Sa So From To Cc Von An De Para Author Authors Written By Maintainer Contact As My Ask The Our Dr Prof Mr Mrs Ms Herr Frau Mme "
    "Regards Cheers Kind Best Many Viele Mit Привет Здравствуйте".split()
)
_GREETERS = frozenset(
    "Hi Hello Hey Hallo Dear Bonjour Bonsoir Salut Hola Moin Servus Ciao Thanks Thank Danke Merci Gracias Saludos Liebe Lieber Sehr Estimado Estimada Querido Querida Cher Chère Good Guten Buenos Buenas Привет Здравствуйте Уважаемый Уважаемая".split()
)
_GREET = re.compile(
    rf"(?:Thank you|Sehr geehrte[rs]?|Good (?:morning|day|afternoon|evening)|Guten (?:Tag|Morgen|Abend)|Buenos días|Buenas tardes|{_L}+),? {_TITLE}({_NO_COMMA}) *(?:[,:!;.–—]|-{{1,2}})? *$"
)
_WROTE_WORDS = ("wrote", "writes", "schrieb", "escribió", "écrit", "said", "scritto", "написал", "пишет")
_WROTE = re.compile(rf"(?:^|[ ,])({_ANY}),? *(?:\(?<[^<>]*>?\)? *|<$)?(?:wrote|writes|said|escribió|a écrit|écrit|ha scritto|написала?|пишет)\b")
_SCHRIEB = re.compile(rf"\bschrieb {_TITLE}({_ANY}) *(?:[<(:]|$)")
_OPEN = re.compile(rf"(?:[AP]M|\d\d:\d\d|\d{{4}},?) ({_ANY}) <$")
_QUOTING = re.compile(rf"(?:Quoting|Zitat von|Citando a?) ({_ANY}) *[<:(]")
_HEADER = re.compile(
    rf"\*?(?:From|To|Cc|Bcc|CC|cc|Reply-To|Sender|Von|An|Kopie|De|À|A|Para|Da|Aan|Van|От|Кому|Organizer|Attn) ?:\*? ?\"?{_TITLE}({_ANY})\"? *(?=[<\[(,;]|mailto|$)"
)
_HEADER_WORD = re.compile(r"\*?(?:From|To|Cc|Bcc|CC|cc|Reply-To|Sender|Von|An|Kopie|De|À|A|Para|Da|Aan|Van|От|Кому|Organizer|Attn) ?:")
_BOX = re.compile(r" ?\(?(?:<|\[mailto:)[\w.+-]+@")
_BEFORE_BOX = re.compile(rf"(?<![\w.])({_ANY})$")
_AND = re.compile(rf"(?:, | and | und | et | y | & )({_ANY})")
_CODE_AUTHOR = re.compile(
    rf"(?:[@\\]?\b[Aa]uthors?|\b[Ww]ritten by|\b[Mm]aintain(?:er|ed by)|\b[Cc]ontribut(?:or|ed by)|\bContact:|\b[Dd]eveloped by|\b[Ii]mplemented by|\b[Rr]eviewed by|\b[Rr]eported by|\b[Mm]odified by|\bAutor(?:in)?|\bAuteur)"
    rf"(?: ?[:=] ?| ){_TITLE}({_ANY})((?:(?: and | und | et | y | & ){_ANY})*)"
)
_AUTHOR_WORDS = ("uthor", "ritten by", "aintain", "ontribut", "Contact:", "eveloped by", "mplemented by", "eviewed by", "eported by", "odified by", "Autor", "Auteur")
#: Set phrases that name persons: words of which one must occur, and the pattern.
_PHRASES = tuple(
    (words, re.compile(pattern))
    for words, pattern in (
        (("Dr. ", "Dr ", "Prof. ", "Prof ", "Mr. ", "Mr ", "Mrs. ", "Mrs ", "Ms. ", "Ms ", "Mx. ", "Mx ", "Herr ", "Frau ", "Mme ", "Sr. ", "Sra. ", "Monsieur ", "Madame ", "Señor"), rf"\b(?:Dr|Prof|Mr|Mrs|Ms|Mx|Herr|Frau|Mme|Sra?|Monsieur|Madame|Señora?)\.? ({_NO_COMMA})"),
        ((" pointed", " said", " wrote", " mentioned", " noted", " explained", " suggested", " showed", " told", " proposed", " remarked"), rf"\b[Aa]s {_TITLE}({_ANY}) (?:already |has |had |just |once )*(?:pointed|said|wrote|mentioned|noted|explained|suggested|showed|told|proposed|remarked)\b"),
        (("colleague", "boss", "supervisor", "adviser", "advisor", "student ", "friend ", "friend,", "worker ", "manager ", "assistant ", "neighbour"), rf"\b(?:colleague|boss|supervisor|advis[oe]r|student|friend|co-?worker|manager|assistant|neighbour),? {_TITLE}({_ANY})(?= [a-z]|[.;:)]|$)"),
        (("Ask ", " ask ", "Meet ", " meet ", "Thank ", " thank ", "Ping ", " ping "), rf"\b(?:[Aa]sk|[Mm]eet|[Tt]hank|[Pp]ing) {_TITLE}({_ANY})(?= (?:about|at|on|for|if|when|to|in)\b)"),
        (tuple(f"{w} {p} " for w in ("data", "file", "files", "patch", "code", "result", "results", "script", "model", "mesh", "help", "reply", "answer", "mail", "message", "note", "report", "idea", "fix", "input", "measurement", "measurements") for p in ("from", "by")), rf"\b(?:data|files?|patch|code|results?|script|model|mesh|help|reply|answer|mail|message|note|report|idea|fix|input|measurements?) (?:from|by) {_TITLE}({_FULL})((?: and {_ANY})?)(?= in\b| on\b|[.,;]|$)"),
        (("name ", "name: "), rf"\bname(?: is|:)? {_TITLE}({_FULL})(?=[.,;)]|$)"),
        (("label ", "parcel ", "envelope ", "badge "), rf"\b(?:label|parcel|envelope|badge) (?:must|should|has to|will|may) (?:say|read|name) {_TITLE}({_FULL})(?=[.,;)]|$)"),
        (("Signed", "signed", "attn", "Attn", "c/o", "Attention"), rf"\b(?:[Ss]igned|[Aa]ttn\.?:?|c/o|Attention:?) ?,? {_TITLE}({_FULL})(?=[.,;)]|$)"),
    )
)
_CLOSINGS = frozenset(
    x
    for line in (
        "regards|kind regards|best regards|warm regards|many regards|kindest regards|best wishes|with kind regards|with best regards|all the best|best|cheers|sincerely|yours|yours sincerely|yours truly|yours faithfully",
        "thanks|thanks in advance|thanks again|many thanks|many thanks in advance|thank you|thank you in advance|thx|greetings",
        "mit freundlichen grüßen|mit freundlichem gruß|mit besten grüßen|freundliche grüße|beste grüße|viele grüße|liebe grüße|herzliche grüße|schöne grüße|mfg|vg|lg|gruß|grüße|vielen dank|danke",
        "cordialement|bien cordialement|bien à vous|salutations|merci|merci d'avance|amicalement|saludos|saludos cordiales|un saludo|un cordial saludo|atentamente|gracias|gracias de antemano|muchas gracias|cordiali saluti|grazie",
        "с уважением|спасибо",
    )
    for x in line.split("|")
)
_SIG_RULES = frozenset(("--", "---", "—", "–", "__", "___"))
_ONLY_NAME = re.compile(rf"{_TITLE}({_ANY})$")
_DASH_NAME = re.compile(rf"(?:[~/—–]|--?) ?({_WORD}|{_L}{{3,}})$")
_ORG = re.compile(
    r"\b(?:university|universität|université|universidad|institute?|institut|department|dept|group|team|lab(?:oratory)?|gmbh|inc|ltd|engineer|developer|professor|postdoc|technician|student|phd|list|dynamics|machines|simulation|"
    r"street|lane|avenue|road|notice|confidentiality|legal|example|regards|grüße|subject|date|regarding|edit|update|summary|results?|log|settings|class|page|module|version|solved|question|answer|box|suite|apt)\b", re.I
)
_WORDS_OF = re.compile(rf"{_L}+(?:['’]{_L}+)?")
_CAMEL = re.compile(r"[a-zà-ÿ][A-Z]")
_MIXED_OK = re.compile(r"^(?:Mc|Mac|De|Di|Du|La|Le|Van|O['’]|D['’])[A-Z]")
_ODD_BLANKS = {0xA0: " ", 0x2007: " ", 0x2009: " ", 0x202F: " ", 0x3000: " ", 0x9: " ", 0xD: " "}


def _is_name(s: str) -> bool:
    """Whether a matched string can be the name of a person and not of a class, thing or body."""
    if _ORG.search(s):
        return False
    words = _WORDS_OF.findall(s)
    if not words:
        return False
    for w in words:
        if _CAMEL.search(w) and not _MIXED_OK.match(w):
            return False
    return not (len(words) == 1 and (words[0].lower() in _NOBODY or len(words[0]) < 3 or words[0] in _LEADING))


def _unquote(line: str) -> int:
    """Offset behind the quotation prefixes of a line."""
    i, n = 0, len(line)
    while i < n:
        c = line[i]
        if c in " >|":
            i += 1
        elif c == "&" and line.startswith("&gt;", i):
            i += 4
        elif c.isupper() and line[i + 1 : i + 4].find(">") >= 0 and (j := line.find(">", i, i + 4)) > 0 and line[i:j].isalpha():
            i = j + 1
        else:
            break
    return i


#: Words of which one must occur for a group of patterns to be tried; for labelled numbers, _FIVE_DIGITS.
_GROUPS: tuple[tuple[str, ...], ...] = (
    _AUTHOR_WORDS, (), ("[at]", "(at)", "AT", "{at}", "<at>", "_at_", "(@)", "[@]"), ("DL-",),
    *(words for words, _ in _ADDRESSES), *(words for words, _ in _PHRASES),
)
_AUTHORS, _LABEL, _HIDE, _DL, _FIRST_ADDRESS = 0, 1, 2, 3, 4
_FIRST_PHRASE = _FIRST_ADDRESS + len(_ADDRESSES)

try:
    import ahocorasick
except ImportError:  # the words are then looked for one by one
    ahocorasick = None


def _word_finder():
    """Function from a text to a bit set of the groups of which a word occurs."""

    if ahocorasick is not None:
        stems = ahocorasick.Automaton()
        for w in _LABEL_STEMS:
            stems.add_word(w, len(w))
        stems.make_automaton()

    def numbered(text: str) -> int:
        """Whether a label and a number of enough digits may stand in the text."""
        if not _FIVE_DIGITS.search(text):
            return 0
        low = text.lower() if text.isascii() else text.casefold().replace("ı", "i")  # whatever a pattern without case takes for a letter
        if ahocorasick is None:
            return 1 << _LABEL if any(w in low for w in _LABEL_STEMS) else 0
        for end, n in stems.iter(low):
            before = low[end - n] if end >= n else " "
            if not (before.isalnum() or before == "_"):
                return 1 << _LABEL
        return 0

    if ahocorasick is None:

        def one_by_one(text: str) -> int:
            return numbered(text) | sum(1 << g for g, words in enumerate(_GROUPS) if any(w in text for w in words))

        return one_by_one
    bits: dict[str, int] = {}
    for g, words in enumerate(_GROUPS):
        for w in words:
            bits[w] = bits.get(w, 0) | 1 << g
    automaton = ahocorasick.Automaton()
    for w, b in bits.items():
        automaton.add_word(w, b)
    automaton.make_automaton()

    def at_once(text: str) -> int:
        found = numbered(text)
        for _, b in automaton.iter(text):
            found |= b
        return found

    return at_once


def forms_of(name: str | None) -> set[str]:
    """Spellings under which a full name of a directory is looked for; none for single words and mere initials."""
    d = " ".join(w.title() if w.isupper() and len(w.strip(".,")) > 1 else w for w in (name or "").split())
    if " " not in d or not any(len(w) > 1 for w in re.split(r"[ .,]+", d)):
        return set()
    if "," in d:
        last, first = (x.strip() for x in d.split(",", 1))
        both = {d, f"{first} {last}"}
    else:
        first, rest = d.split(" ", 1)
        both = {d, f"{rest}, {first}"}
    return both | {f.upper() for f in both}


def directory_candidates(text: str, words: set[int]) -> set[str]:
    """All strings of a text that a form of so many words could match, for directories too large to be at hand."""
    if not text.isascii() or "\r" in text or "\t" in text:
        text = text.translate(_ODD_BLANKS)
    found = set()
    for m in _CAPITALISED.finditer(text):
        at = m.start()
        for n in range(1, max(words, default=0) + 1):
            stop = next((e for e in range(at, len(text)) if text[e] == " "), len(text))
            if n in words:
                found.update(text[m.start() : e] for e in range(at + 1, stop + 1) if e == len(text) or not (text[e].isalnum() or text[e] in "_@-"))
            if stop == len(text):
                break
            at = stop + 1
    return found


class Finder:
    """Finds personal data; built once per Python worker.

    ``directory``: display names of known members, of bounded size; a full name of the
    directory is found wherever it stands.
    """

    def __init__(self, directory: list[str] | None = None):
        self.groups = _word_finder()
        self.known: dict[str, set[str]] = {}
        for d in directory or ():
            for form in forms_of(d):
                self.known.setdefault(form.split(" ", 1)[0], set()).add(form)

    # -------------------------------------------------------------- parts

    @staticmethod
    def emails(text: str, groups: int) -> list[tuple[int, int]]:
        out = []
        if "@" in text:
            for m in _EMAIL.finditer(text):
                if not _PRODUCT.match(m[0]):
                    out.append(m.span())
        if groups >> _HIDE & 1:
            out += [m.span() for m in (_HIDDEN_I if "(AT)" in text or "[AT]" in text else _HIDDEN).finditer(text)]
        return out

    @staticmethod
    def phones(text: str) -> list[tuple[int, int]]:
        out = []
        for m in _PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if 8 <= digits <= 22 and "\n" not in m[0]:
                out.append(m.span())
        return out

    @staticmethod
    def numbers(text: str, groups: int) -> list[tuple[int, int]]:
        out = []
        for m in _SSN.finditer(text):
            if not _NOT_SSN.search(text, max(0, m.start() - 24), m.start()):
                out.append(m.span())
        if groups >> _DL & 1:
            out += [m.span() for m in _LICENCE.finditer(text)]
        if groups >> _LABEL & 1:
            for m in _LABELLED.finditer(text):
                if sum(c.isdigit() for c in m[1]) >= 5:
                    out.append(m.span(1))
        return out

    @staticmethod
    def addresses(text: str, groups: int) -> list[tuple[int, int]]:
        out = []
        if groups >> _FIRST_ADDRESS & (1 << len(_ADDRESSES)) - 1:
            for g, (_, pattern) in enumerate(_ADDRESSES, _FIRST_ADDRESS):
                if groups >> g & 1:
                    out += [m.span() for m in pattern.finditer(text)]
        return out

    def persons(self, text: str, post: bool, groups: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []

        def add(start: int, end: int) -> None:
            # words that only lead up to the name are no part of it
            while (b := text.find(" ", start, end)) > 0 and text[start:b].rstrip(",") in _LEADING:
                start = b + 1
            if _is_name(text[start:end]):
                out.append((start, end))

        def more(m: re.Match, g: int, base: int = 0) -> None:
            if m[g]:
                for x in _AND.finditer(m[g]):
                    add(base + m.start(g) + x.start(1), base + m.start(g) + x.end(1))

        for word in _AUTHOR_WORDS if groups >> _AUTHORS & 1 else ():
            at = text.find(word)
            while at >= 0:
                if m := _CODE_AUTHOR.match(text, max(0, text.rfind("\n", 0, at) + 1, at - 2)) or _CODE_AUTHOR.search(text, max(0, at - 2), text.find("\n", at) if text.find("\n", at) > 0 else len(text)):
                    add(*m.span(1))
                    more(m, 2)
                at = text.find(word, at + len(word))
        if groups >> _FIRST_PHRASE:
            for g, (_, pattern) in enumerate(_PHRASES, _FIRST_PHRASE):
                if groups >> g & 1:
                    for m in pattern.finditer(text):
                        add(*m.span(1))
                        if pattern.groups > 1:
                            more(m, 2)
        if "@" in text and ("<" in text or "[mailto:" in text):
            for m in _BOX.finditer(text):
                line = max(text.rfind("\n", 0, m.start()) + 1, m.start() - 70)
                if b := _BEFORE_BOX.search(text[line : m.start()]):
                    add(line + b.start(1), line + b.end(1))
        if post:
            self._by_line(text, add)
        return out

    def _by_line(self, text: str, add) -> None:
        at, blank_before, leader = 0, True, False
        for line in text.split("\n"):
            base = at
            at += len(line) + 1
            s = line.rstrip()
            if not s:
                blank_before, leader = True, False
                continue
            i = _unquote(s)
            prefix, s = i, s[i:]
            if not s:
                blank_before, leader = True, False
                continue
            base += prefix
            first = s.split(" ", 1)[0].rstrip(",")
            was_leader, leader = leader, False
            was_blank, blank_before = blank_before, False
            if first in _GREETERS and len(s) < 80:
                if m := _GREET.match(s):
                    add(base + m.start(1), base + m.end(1))
                    if s.rstrip(" ,.!;:–—-").lower() not in _CLOSINGS:
                        continue
            bare = s.rstrip(" ,.!;:–—-").lower() if len(s) < 40 else ""
            if s in _SIG_RULES or bare in _CLOSINGS:
                leader = True
                continue
            if was_leader or was_blank and not prefix and len(s) < 60:
                if m := _ONLY_NAME.match(s):
                    if was_leader or first not in _GREETERS:
                        add(base + m.start(1), base + m.end(1))
                        continue
            c = s[0]
            if c in "~/-—–":
                if m := _DASH_NAME.match(s):
                    add(base + m.start(1), base + m.end(1))
                    continue
            if ":" in s:
                if _HEADER_WORD.match(s):
                    if m := _HEADER.match(s):
                        add(base + m.start(1), base + m.end(1))
                elif any(w in s for w in _WROTE_WORDS):
                    for m in (_SCHRIEB if "schrieb" in s else _WROTE).finditer(s):
                        add(base + m.start(1), base + m.end(1))
                elif "Quoting" in s or "Zitat" in s or "Citando" in s:
                    if m := _QUOTING.search(s):
                        add(base + m.start(1), base + m.end(1))
            if s.endswith("<"):
                if m := _OPEN.search(s):
                    add(base + m.start(1), base + m.end(1))

    # -------------------------------------------------------------- all

    def spans(self, text: str | None, post: bool = True, names: list[str] | None = None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of every item, ordered, without overlaps; ``names`` are forms of the directory that the text may have."""
        if not text or not text.strip():
            return []
        if not text.isascii() or "\r" in text or "\t" in text:
            text = text.translate(_ODD_BLANKS)  # same length: offsets hold for the original
        found: list[tuple[int, int, str]] = []
        taken = bytearray(len(text))

        def take(spans: list[tuple[int, int]], kind: str) -> None:
            for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])) if len(spans) > 1 else spans:
                if any(taken[a:b]):
                    if kind != "person" or "," not in text[a:b]:
                        continue
                    b = a + text[a:b].index(",")  # "Name, Street 5": the rest is an address
                    if b <= a or any(taken[a:b]):
                        continue
                taken[a:b] = b"\1" * (b - a)
                found.append((a, b, kind))

        groups = self.groups(text)
        take(self.emails(text, groups), "email")
        take(self.numbers(text, groups), "id_number")
        take(self.phones(text), "phone")
        take(self.addresses(text, groups), "address")
        people = self.persons(text, post, groups)
        if people:
            take(people, "person")
            again = []
            for name in {text[a:b] for a, b, k in found if k == "person"}:  # full names again in the same text
                if " " not in name:
                    continue
                at = text.find(name)
                while at >= 0:
                    e = at + len(name)
                    if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_.@-+")) and (e == len(text) or not (text[e].isalnum() or text[e] in "_@-")):
                        again.append((at, e))
                    at = text.find(name, e)
            take(again, "person")
        known = self.known
        if names:
            known = {}
            for form in names:
                known.setdefault(form.split(" ", 1)[0], set()).add(form)
        if known:
            take(self._listed(text, known), "person")
        found.sort()
        return found

    @staticmethod
    def _listed(text: str, known: dict[str, set[str]]) -> list[tuple[int, int]]:
        """Full names of the directory, wherever they stand."""
        out = []
        for m in _CAPITALISED.finditer(text):
            for name in known.get(m[0], ()):
                if text.startswith(name, m.start()):
                    e = m.start() + len(name)
                    if e == len(text) or not (text[e].isalnum() or text[e] in "_@-"):
                        out.append((m.start(), e))
        return out


_CAPITALISED = re.compile(rf"[{_UP}](?<![\w@.].)(?:(?<=[OD])['’][{_UP}])?{_L}+(?:-{_L}+)*,?(?= )", re.S)
