"""Pure-Python kernel that finds the lines of a mail its sender did not newly write.

Line rules for several languages: quotation prefixes, attribution lines, forwarded and
"original message" header blocks, signature delimiters and closing greetings, notes of
mail programs, disclaimers and list footers.  Replies between quotations stay.
"""

from __future__ import annotations

import re

MIN_WRAP_WIDTH = 55  # narrower quoted lines are not taken for wrapped ones
HEADER_LINES = 2  # ``Subject:`` and ``Date:`` in front of every post

# ------------------------------------------------------------------ quotations

#: One level of quotation; ``>>> code`` of an interactive session is no quotation.
_QUOTE = re.compile(r"^[ \t\xa0]{0,4}(?:&gt;|>|\|(?=\s|>|$)|[A-ZÀ-ÞЀ-Я][^\W\d_]{0,2}>)")
_REPL = re.compile(r"^\s*(?:>>>|\.\.\.) (?:import |from |print\b|for |if |while |def |class |with |del |help\(|[A-Za-z_][\w.\[\]]*\s*(?:\(|=|\.)|[A-Za-z_]\w*$|[\[({'\"\d])")
_TABLE = re.compile(r"^\s*\|.*[^\s|].*\|\s*$")
_TABLE_IN_QUOTE = re.compile(r"^\s*\|\s*[>|]")
_SENTENCE_END = re.compile(r"[.?!:;)\]>\"'»”]\s*$")


def _is_quote(line: str) -> bool:
    if not _QUOTE.match(line):
        return False
    s = line.lstrip(" \t\xa0")
    if s.startswith(">>>") and _REPL.match(line):
        return False
    if s.startswith("|") and _TABLE.match(line) and not _TABLE_IN_QUOTE.match(line):
        return False
    return True


# ------------------------------------------------------------------ introductions of quotations

_MAIL = r"[^\s<>()\[\]]+@[^\s<>()\[\]]+"
_WROTE = (
    r"(?:wrote|writes|said|schrieb(?:en)?|a écrit|écrivait|écrit|escribió|escribe|ha scritto|scrive|schreef|skrev|escreveu|napisał\(?a?\)?|писал\(?а?\)?|пишет|написал\(?а?\)?)"
)
_INTRO = re.compile(
    rf"^\s*(?:"
    rf"(?:On|At|Le|El|Am|Il|Em|Op|Den|Dnia|Am)\s.{{2,160}}\b{_WROTE}\b[^\n]{{0,60}}:\s*$"
    rf"|.{{1,120}}\b{_WROTE}(?:\s+(?:on|am|le|el)\s.{{3,40}})?\s*:\s*$"
    rf"|(?:Quoting|Zitat von|Citando a?|Citando)\s.{{2,120}}:\s*$"
    rf"|\*\s+.{{2,80}}<{_MAIL}>\s*\[[^\]]{{4,40}}\]\s*:\s*$"
    rf"|.{{0,60}}<{_MAIL}>\s+{_WROTE}\b[^\n]{{0,40}}:\s*$"
    rf"|\[?[\d/.\- :,]{{6,30}}\]?\s*,?\s+.{{2,60}}<{_MAIL}>\s*:\s*$"
    rf")", re.I
)
#: What an introduction must show besides the verb, so that "the solver wrote:" is none.
_INTRO_SUBJECT = re.compile(rf"{_MAIL}|\d{{1,4}}[-/.:]\d{{1,2}}|\b(?:19|20)\d\d\b")
_INTRO_NAME_ONLY = re.compile(
    rf"^\s*(?:(?:[A-ZÀ-ÞЀ-Я][^\W\d_]*(?:['’.\-][^\W\d_]+)*\.?|van|von|der|den|de|la|le|du|di|da|dos|ten|ter|zu|bin|al|el),?\s+){{1,5}}{_WROTE}\s*:\s*$"
)
_INTRO_OPEN = re.compile(
    r"^\s*(?:(?:On|At|Le|El|Am|Il|Em|Op|Den)\s+(?:[A-Za-zÀ-ÿ]{2,10}\.?,?\s+)?(?:\d|[A-Za-zÀ-ÿ]{3,9}\.?\s+\d)).{0,120}(?:[<(,]|\d|[A-Za-zÀ-ÿ])\s*$"
)

# ------------------------------------------------------------------ header blocks

_HEAD_FROM = re.compile(r"^\s*\*?(?:From|Von|De|Da|Van|Från|Od|От)\s?:\*?\s+\S", re.I)
_HEAD_NEXT = re.compile(
    r"^\s*\*?(?:Sent|Date|To|Cc|Bcc|Subject|Reply-To|Gesendet|Datum|An|Betreff|Kopie|Envoyé(?: le)?|À|A|Objet|Date d'envoi|Enviado(?: el)?|Fecha|Para|Asunto|Inviato|Oggetto|"
    r"Verzonden|Aan|Onderwerp|Дата|Кому|Тема|From|Von|De)\s?:\*?(?:\s|$)", re.I
)
_RULED = re.compile(
    r"^\s*[-_=*]{3,}\s*(?:Original Message|Original-?Nachricht|Ursprüngliche Nachricht|Message d'origine|Message original|Mensaje original|Forwarded message|Forwarded by.*|"
    r"Weitergeleitete Nachricht|Message transféré|Mensaje reenviado|Begin forwarded message|Messaggio originale|Oorspronkelijk bericht)\s*:?\s*[-_=*]*\s*$"
    r"|^\s*(?:Begin forwarded message|Anfang der weitergeleiteten (?:E-Mail|Nachricht)|Début du message transféré|Inicio del mensaje reenviado)\s*:\s*$", re.I
)
_RULE = re.compile(r"^\s*(?:_{5,}|-{5,}|={5,}|\*{5,}|~{5,}|#{5,})\s*$")

# ------------------------------------------------------------------ signatures

_SIG_RULE = re.compile(r"^(?:--\s?|---|—|–|__|_{3}|-- {0,2}|\*{3}|~~+)\s*$")
_CLOSING = re.compile(
    r"^\s*(?:(?:(?:with\s+)?(?:kind|best|warm|warmest|many|kindest)\s+(?:regards|wishes|greetings)|all the best|best|regards|cheers|sincerely|yours(?: sincerely| truly| faithfully)?|"
    r"thanks(?: in advance| again| a lot| and regards)?|many thanks(?: in advance)?|thank you(?: in advance| very much)?|thx|greetings|"
    r"(?:mit\s+)?(?:freundliche[nm]?|beste[nm]?|viele[nm]?|liebe[nm]?|herzliche[nm]?|schöne[nm]?)\s+(?:grüße[n]?|grüssen?|gruß|gruss)|mfg|vg|lg|gruß|grüße|danke(?: im voraus)?|vielen dank(?: im voraus)?|"
    r"(?:bien\s+)?cordialement|bien à vous|salutations|(?:meilleures|sincères) salutations|merci(?: d'avance| beaucoup)?|amicalement|à bientôt|"
    r"saludos(?: cordiales)?|un saludo|un cordial saludo|atentamente|gracias(?: de antemano)?|muchas gracias|"
    r"cordiali saluti|distinti saluti|grazie|met vriendelijke groet(?:en)?|groeten|atenciosamente|obrigad[oa]|"
    r"с уважением|спасибо|с наилучшими пожеланиями)\s*[,.!:;\-–—]*)\s*$", re.I
)
_LETTERS = r"[^\W\d_]"
_NAME_WORD = rf"(?:(?:O|D|L|d|l)['’])?{_LETTERS}+(?:[-'’]{_LETTERS}+)*"
_NAME_LINE = re.compile(
    rf"^\s*(?:(?:Dr|Prof|Mr|Mrs|Ms|Dipl\.-Ing|Ing|Mme|M|Herr|Frau)\.?\s+)?[A-ZÀ-ÞЀ-Я]{_LETTERS}*\.?(?:['’]{_LETTERS}+)?(?:-{_LETTERS}+)*,?"
    rf"(?:\s+(?:[A-ZÀ-ÞЀ-Я]\.|van|von|der|den|de|la|le|du|di|da|dos|ten|ter|zu|al|bin|(?:O|D)['’]{_LETTERS}+|[A-ZÀ-ÞЀ-Я]{_LETTERS}*(?:['’]{_LETTERS}+)?(?:-{_LETTERS}+)*),?){{0,5}}\s*$"
)
_DASH_NAME = re.compile(rf"^\s*(?:[-~/—–]|--)\s?{_NAME_WORD}\.?\s*$")
_CONTACT = re.compile(
    rf"{_MAIL}|^\s*(?:tel|phone|mobil[e]?|mob|fax|t|f|m|p|e|w|e-?mail|web|www|office|telefon|tél|cell|skype|icq)\b\s*[.:]?:?\s*[+(\d\w]|^[☎✆📞]|\+\d|\d{{3}}[ .\-/)]\s?\d{{3}}|https?://|www\.", re.I
)
_PLACE = re.compile(
    r"\b(?:Street|St\.|Lane|Ave\.?|Avenue|Road|Rd\.?|Close|Drive|Blvd|Suite|Apt\.?|P\.?\s?O\.?\s?Box|Postfach|rue|Calle|Avenida|Platz|Allee)\b|(?:straße|strasse|weg|gasse|platz|allee)\s+\d|\b\d{4,5}\s+[A-ZÀ-Þ]", re.I
)
_ROLE = re.compile(
    r"\b(?:engineer|developer|professor|postdoc|student|technician|manager|scientist|researcher|director|lecturer|head of|consultant|analyst|assistant|fellow|university|institute|"
    r"department|dept|group|team|laboratory|lab|faculty|school of|college|gmbh|inc|ltd|company|corp|division|universität|institut|abteilung|fakultät|université|laboratoire|universidad)\b", re.I
)
_GREETING = re.compile(
    r"^\s*(?:hi|hello|hey|hallo|dear|bonjour|salut|hola|moin|servus|ciao|good (?:morning|day|evening|afternoon)|guten (?:tag|morgen|abend)|liebe[rs]?|sehr geehrte[rs]?|"
    r"estimad[oa]s?|cher|chère|buenos días|buenas|thanks|thank you|danke|merci|gracias|privet|привет|здравствуйте)\b", re.I
)

# ------------------------------------------------------------------ notes of mail programs, disclaimers, footers

_NOTE = re.compile(
    r"^\s*(?:(?:sent|written|typed)\s+(?:from|via|with|using|by)\s+(?:my\b|a\b|an\b|the\b|mail\b|outlook|iphone|ipad|android|thunderbird|gmail|yahoo|blackberry|samsung).{0,80}|"
    r"get\s+(?:the\s+)?(?:outlook|mail|gmail|app|.{1,20}\bapp)\b.{0,50}|(?:von|gesendet\s+(?:von|mit|über))\s+(?:meinem|meiner|mein|dem|der|outlook|mail|iphone).{0,60}|"
    r"envoyé\s+(?:de|depuis|à partir de)\s+(?:mon|ma|mes|un|une|outlook|mon).{0,60}|enviado\s+(?:desde|de)\s+(?:mi|un|una|meu|outlook).{0,60}|inviato\s+da(?:l)?\s.{0,60}|verzonden\s+(?:vanaf|met|via)\s.{0,60}|"
    r"отправлено\s+(?:с|из)\s.{0,60})\s*$", re.I
)
_DISCLAIMER_HEAD = re.compile(
    r"^\s*(?:[*_=\-]*\s*)?(?:confidentiality(?: notice)?|legal (?:notice|disclaimer)|disclaimer|notice|rechtlicher hinweis|haftungsausschluss|vertraulichkeitshinweis|avis de confidentialité|"
    r"mention légale|aviso (?:legal|de confidencialidad))\s*:?\s*(?:[*_=\-]*)\s*$", re.I
)
_DISCLAIMER = re.compile(
    r"\b(?:may be confidential|is confidential|are confidential|protected by law|privileged|intended (?:only |solely )?for (?:the )?(?:addressee|use|recipient)|meant only for the addressee|"
    r"got this mail by mistake|received this (?:e-?mail|message|mail) (?:in error|by mistake)|delete it and tell|liability is taken|no liability|caused by viruses|without consent is forbidden|"
    r"views given here|views expressed|not of the company|copying or passing on|unauthori[sz]ed (?:use|copying|disclosure)|"
    r"vertraulich|nicht der adressat|löschen sie bitte|weitergabe ist nicht gestattet|irrtümlich erhalten|"
    r"est confidentiel|sans accord préalable|seule personne nommée|destinataire|diffusion .{0,30}interdite|reçu ce message par erreur|"
    r"es confidencial|confidencial|uso exclusivo|destinatario|sin autorización|recibido este (?:mensaje|correo) por error)\b", re.I
)
_TARGET = rf"(?:group|list|forum|gruppe|liste|groupe|grupo|lista|newsletter|subscription|digest|{_MAIL}|https?://|www\.)"
_FOOTER = re.compile(
    rf"^\s*(?:(?:you (?:get|got|received|are receiving) this (?:mail|message|e-?mail)|diese e-?mail kam|sie erhalten diese (?:e-?mail|nachricht)|vous recevez ce(?:t)? (?:message|e-?mail|courriel)|recibe este (?:mensaje|correo))\b.*"
    rf"|(?:your |change )?(?:membership|subscription|list|mailing) (?:settings|options|preferences)\b.*"
    rf"|(?:to|um|pour|para)\s+(?:(?:leave|unsubscribe|quitter|salir|abandonar)\b|se désabonner\b|darse de baja\b|sich\b|die\b|diese\b).{{0,40}}{_TARGET}.*"
    rf"|(?:unsubscribe|abmelden|se désabonner|darse de baja)\s*(?::|here\b|at\b|from\b.{{0,30}}{_TARGET}|{_MAIL}|<?https?://).*"
    rf"|(?:visit|view|see) (?:this|the) (?:group|discussion|list|topic)(?: (?:at|on|page|archives?)\b.*|\s*:.*)"
    rf"|for more options\b.{{0,60}}{_TARGET}.*"
    rf"|[-~_=\s]*[\w.+-]+\s+(?:discussion group|mailing list)\s*(?:[-~_=|:–—]+[^.]*)?"
    rf"|.{{0,12}}--~.*|list (?:archive|info|help)\s*:.*|.{{0,60}}\blistinfo/.*)\s*$", re.I
)


def _plain(line: str) -> str:
    return line.replace("\xa0", " ").rstrip("\r")


def cut_lines(text: str | None) -> list[int]:
    """1-based numbers of the lines to remove, in ascending order; blank lines never count."""
    if not text or not text.strip():
        return []
    raw = text.split("\n")
    lines = [_plain(x) for x in raw]
    n = len(lines)
    blank = [not x.strip() for x in lines]
    gone = [False] * n
    start = min(HEADER_LINES, n)

    quote = [i >= start and not blank[i] and _is_quote(lines[i]) for i in range(n)]

    # forwarded or original message: from its rule or header block to the end
    end = n
    for i in range(start, n):
        if blank[i] or quote[i]:
            continue
        if _RULED.match(lines[i]):
            end = i
        elif _HEAD_FROM.match(lines[i]):
            following = [j for j in range(i + 1, min(i + 6, n))]
            hits = 0
            for j in following:
                if blank[j] or not _HEAD_NEXT.match(lines[j]):
                    break
                hits += 1
            if hits >= 2:
                end = i
                k = i - 1
                if k >= start and _RULE.match(lines[k]):
                    end = k
        if end < n:
            break
    for i in range(end, n):
        gone[i] = True

    # quotations, their wrapped ends and their introductions
    i = start
    while i < end:
        if not quote[i]:
            i += 1
            continue
        gone[i] = True
        j = i + 1
        # the end of a quoted line that wrapped without the prefix
        if j < end and not quote[j] and not blank[j] and _wrapped_tail(lines, quote, blank, i, j, end):
            gone[j] = True
            j += 1
        i = j
    i = start
    while i < end:
        if quote[i] or blank[i] or gone[i]:
            i += 1
            continue
        span = _introduction(lines, blank, quote, i, end)
        if span:
            for k in range(i, i + span):
                gone[k] = True
            i += span
        else:
            i += 1

    # notes, disclaimers, footers: by paragraph, outside quotations
    closing: set[int] = set()  # lines taken for a disclaimer or footer; true only where no own text follows
    for a, b in _paragraphs(blank, start, end):
        own = [k for k in range(a, b) if not gone[k]]
        if not own:
            continue
        for k in own:
            if _NOTE.match(lines[k]):
                gone[k] = True
            elif _FOOTER.match(lines[k]):
                closing.add(k)
        if any(_DISCLAIMER.search(lines[k]) for k in own):
            first = next(k for k in own if _DISCLAIMER.search(lines[k]) or _DISCLAIMER_HEAD.match(lines[k]))
            while first - 1 >= a and (_RULE.match(lines[first - 1]) or _DISCLAIMER_HEAD.match(lines[first - 1])) and not gone[first - 1]:
                first -= 1
            closing.update(k for k in own if k >= first)
        for k in closing:
            gone[k] = True
        for k in own:  # a rule or heading that leads a removed line
            if (_RULE.match(lines[k]) or _DISCLAIMER_HEAD.match(lines[k])) and not gone[k]:
                nxt = next((x for x in range(k + 1, end) if not blank[x]), None)
                if nxt is None or gone[nxt] and not quote[nxt]:
                    gone[k] = True
                    closing.add(k)

    # signature
    for a, b in _paragraphs(blank, start, end):
        own = [k for k in range(a, b) if not gone[k]]
        if not own:
            continue
        at = _signature_start(lines, own, a, start)
        if at is not None:
            for k in own:
                if k >= at:
                    gone[k] = True
            # a signature may go on after a blank line under its own delimiter
            nxt = next((x for x in range(b, end) if not blank[x]), None)
            if nxt is not None and not gone[nxt] and _SIG_RULE.match(lines[own[-1]]):
                e = nxt
                while e < end and not blank[e] and not gone[e]:
                    gone[e] = True
                    e += 1

    # what the sender wrote below a seeming disclaimer or footer shows that it is none
    if closing:
        last = max((k for k in range(start, end) if not gone[k] and not blank[k]), default=-1)
        for k in closing:
            if k < last:
                gone[k] = False
    return [i + 1 for i in range(start, n) if gone[i] and not blank[i]]


def _paragraphs(blank: list[bool], start: int, end: int):
    i = start
    while i < end:
        if blank[i]:
            i += 1
            continue
        j = i
        while j < end and not blank[j]:
            j += 1
        yield i, j
        i = j


def _unquoted(line: str) -> str:
    s = line
    while (m := _QUOTE.match(s)) is not None:
        s = s[m.end() :]
    return s.strip()


def _wrapped_tail(lines: list[str], quote: list[bool], blank: list[bool], i: int, j: int, end: int) -> bool:
    """Whether line j is the wrapped rest of the quoted line i above it."""
    body = _unquoted(lines[i])
    tail = lines[j]
    if not body or _SENTENCE_END.search(body) or _INTRO.match(tail) or _INTRO_OPEN.match(tail):
        return False
    if tail.startswith((" ", "\t", "|")) or _REPL.match(tail) or _SIG_RULE.match(tail) or _CLOSING.match(tail):
        return False
    words = tail.split()
    first = words[0][:1]
    # the tail's first word would not have fitted on the line, and the line was prose
    if len(lines[i]) + 1 + len(words[0]) < MIN_WRAP_WIDTH or "@" in body.rsplit(None, 1)[-1]:
        return False
    # a sentence that goes on: lower case, digit or an opening sign; a capital only before more quotation
    return first.islower() or not first.isalpha() or (j + 1 < end and quote[j + 1])


def _introduction(lines: list[str], blank: list[bool], quote: list[bool], i: int, end: int) -> int:
    """Number of lines of an introduction of a quotation that begins at line i, else 0."""

    def quoted_after(k: int) -> bool:
        skipped = 0
        while k < end and blank[k] and skipped < 2:
            k += 1
            skipped += 1
        return k < end and quote[k]

    one = lines[i]
    if _INTRO.match(one) and (_INTRO_SUBJECT.search(one) or _INTRO_NAME_ONLY.match(one) and quoted_after(i + 1)):
        return 1
    if _INTRO_NAME_ONLY.match(one) and quoted_after(i + 1):
        return 1
    for span in (2, 3):
        if i + span > end or any(blank[k] or quote[k] for k in range(i, i + span)):
            break
        if not _INTRO_OPEN.match(one):
            break
        joined = " ".join(x.strip() for x in lines[i : i + span])
        if _INTRO.match(joined) and _INTRO_SUBJECT.search(joined):
            return span
    return 0


def _signature_start(lines: list[str], own: list[int], a: int, start: int) -> int | None:
    first_paragraph = a <= start + 1
    for pos, k in enumerate(own):
        line = lines[k]
        rest = [lines[x] for x in own[pos + 1 :]]
        if _SIG_RULE.match(line):
            return k
        if _CLOSING.match(line):
            # "Thanks" in front of a text is a greeting; a closing is followed by name lines only
            if all(_sig_like(x) for x in rest):
                return k
            continue
        if _DASH_NAME.match(line) and all(_sig_like(x) for x in rest) and len(rest) <= 6:
            return k
        if pos == 0 and _name_line(line) and all(_sig_like(x) for x in rest) and not _GREETING.match(line):
            if rest or not first_paragraph:
                return k
    return None


def _name_line(line: str) -> bool:
    return bool(_NAME_LINE.match(line)) and len(line.split()) <= 6 and not line.rstrip().endswith((".", ":", "?", "!")) and not _ROLE.search(line)


def _sig_like(line: str) -> bool:
    return bool(
        _name_line(line) or _CONTACT.search(line) or _PLACE.search(line) or _ROLE.search(line) and len(line.split()) <= 9 and not line.rstrip().endswith(("?", "!", "."))
        or _NOTE.match(line) or _DASH_NAME.match(line) or _SIG_RULE.match(line)
    )


def keep_text(text: str | None, cut: list[int] | None = None) -> str | None:
    """The post without the removed lines; runs of blank lines left behind become one."""
    if text is None:
        return None
    gone = set(cut_lines(text) if cut is None else cut)
    kept: list[str] = []
    for i, line in enumerate(text.split("\n"), 1):
        if i in gone or not line.strip() and kept and not kept[-1].strip() and i > HEADER_LINES:
            continue
        kept.append(line)
    while kept and not kept[-1].strip() and len(kept) > HEADER_LINES:
        kept.pop()
    return "\n".join(kept)
