"""Keyed surrogates of personal data that keep type, script, gender ending and format.

An item is taken apart into units: words of names, mail addresses and streets, subscriber
numbers of phones, document numbers, other numbers.  Every unit is replaced by a keyed
permutation of all units of its shape, so different units get different surrogates by
construction, and the same unit gets the same one in every item: full names, first names,
initials and mail addresses of a person stay in step, and so do the forms of a phone number.
A surrogate that is itself a unit of the texts is moved to another variant (``pii.settle``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping
from functools import lru_cache

#: Placeholders by type.
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

WORD, PHONE, NUMBER = "word", "phone", "id_number"  # kinds of units that are checked against the texts

_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\W\d_]+")
_WORD_OR_DIGITS = re.compile(r"[^\W\d_]+|[0-9]+")

#: Letters that stand for each other: a word keeps its pattern of vowels and consonants and its script.
_CLASSES = (
    "bcdfghjklmnpqrstvwxz", "aeiouy", "бвгджзклмнпрстфхцчшщ", "аеиоуыэюя", "äöüáéíóúàèìòùâêîôûëï", "ßçñšžčćłńřťďľśźż",
)
_CLASS_OF = {c: letters for letters in _CLASSES for c in letters}
#: Last letters that show a grammatical gender; they stay.
_ENDINGS = frozenset("aeiouyаеиоуыэюя")
_PARTICLES = frozenset("van von der den dem de la las los le du di da del della dos do zu zur ter ten al el bin af av".split())


def placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


# ------------------------------------------------------------------ keyed permutations


def permuted(value: int, size: int, key: str, tweak: str) -> int:
    """Image of a number below ``size`` under a keyed permutation (a Feistel network, walked until it falls into the range)."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    while True:
        left, right = value >> half, value & mask
        for n in range(8):
            f = hashlib.blake2b(f"{tweak}/{size}/{n}/{right}".encode(), digest_size=16, key=secret).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _replaced(chars: str, alphabets: list[str], key: str, tweak: str) -> str:
    """Characters moved within their alphabets, all of them at once."""
    value, size = 0, 1
    for c, a in zip(chars, alphabets):
        value, size = value * len(a) + a.index(c), size * len(a)
    value = permuted(value, size, key, tweak)
    out = []
    for a in reversed(alphabets):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


@lru_cache(200_000)
def word(low: str, key: str, variant: int) -> str:
    """Surrogate of a lower-case word.

    Its first letter depends on the first letter only, so that initials fit; letters of other
    scripts stay; later variants of a word are a letter longer, so that there are always more.
    """
    first = _CLASS_OF.get(low[0])
    start = _replaced(low[0], [first], key, "first letter") if first else low[0]
    if len(low) == 1:
        return start
    end = low[-1] if low[-1] in _ENDINGS else ""
    body = low[1 : len(low) - len(end)]
    moved = [i for i, c in enumerate(body) if c in _CLASS_OF]
    fixed = "".join(c if c not in _CLASS_OF else "." for c in body)
    new = list(body)
    if moved:
        tweak = f"word/{low[0]}/{end}/{fixed}/{''.join(str(_CLASSES.index(_CLASS_OF[body[i]])) for i in moved)}/{variant}"
        for i, c in zip(moved, _replaced("".join(body[i] for i in moved), [_CLASS_OF[body[i]] for i in moved], key, tweak)):
            new[i] = c
    more = ""
    if variant:
        letters = _CLASSES[2] if first in _CLASSES[2:4] else _CLASSES[0]
        more = "".join(letters[permuted((variant + n) % len(letters), len(letters), key, f"more/{low}/{n}")] for n in range((variant + 2) // 3))
    return start + "".join(new) + more + end


@lru_cache(100_000)
def phone(digits: str, key: str, variant: int) -> str:
    """Surrogate of a subscriber number; later variants start from another permutation."""
    return _replaced(digits, [_DIGITS] * len(digits), key, f"phone/{variant}")


@lru_cache(100_000)
def number(chars: str, key: str, variant: int) -> str:
    """Surrogate of a document number without its separators, lower case."""
    shape = "".join("9" if c in _DIGITS else "a" if c in _LETTERS else c for c in chars)
    alphabets = [_DIGITS if c == "9" else _LETTERS if c == "a" else c for c in shape]
    return _replaced(chars, alphabets, key, f"number/{shape}/{variant}")


MAKERS: dict[str, Callable[[str, str, int], str]] = {WORD: word, PHONE: phone, NUMBER: number}

# ------------------------------------------------------------------ items and their units

SUBSCRIBER = 7  # last digits of a phone number that all of its forms share, whatever stands in front
_EXTENSION = re.compile(r"[ ,;]{0,2}\b(?:ext\.?|extension|x|Durchwahl|DW|poste|int\.?)[ .:]{0,2}\d{1,6}$", re.I)
_LICENCE = re.compile(r"^DL(?=-)")
_AT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+_?at_?\s+", re.I)
_DOT = re.compile(r"\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+_?dot_?\s+|\.", re.I)
#: Words that make an address one, and endings of street names; they stay.
_ADDRESS_WORDS = frozenset(
    "street st lane ln avenue ave road rd close drive dr boulevard blvd court ct place pl square sq terrace way crescent row walk gardens mews parkway highway hill west east north south old new "
    "apt apartment suite ste unit flat room floor fl box po p o postfach boîte postale bp apartado correos casilla rue chemin impasse allée quai route cours passage du de des la le les l d bis ter "
    "calle avenida avda plaza paseo camino ronda carrera via viale piazza corso ul ulica al os n s e w".split()
)
_ADDRESS_TAILS = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig", "hof", "graben")


def _cased(like: str, low: str) -> str:
    if like.isupper() and len(like) > 1:
        return low.upper()
    return low[:1].upper() + low[1:] if like[:1].isupper() else low


class Writer:
    """Writes items anew; ``variants`` has the units that were moved, by kind and value."""

    def __init__(self, key: str, variants: Mapping[tuple[str, str], int] | None = None):
        self.key, self.variants = key, variants or {}
        self.used: list[tuple[str, str]] | None = None  # units met, if wanted

    def _unit(self, kind: str, value: str) -> str:
        if self.used is not None:
            self.used.append((kind, value))
        return MAKERS[kind](value, self.key, self.variants.get((kind, value), 0))

    def _word(self, w: str) -> str:
        low = w.lower()
        return _cased(w, self._unit(WORD, low)) if len(low) > 1 else _cased(w, word(low, self.key, 0))

    def _digits(self, d: str, use: str) -> str:
        return _replaced(d, [_DIGITS] * len(d), self.key, f"{use}/digits")

    def _words_and_digits(self, s: str, use: str) -> str:
        return _WORD_OR_DIGITS.sub(lambda m: self._digits(m[0], use) if m[0][0] in _DIGITS else self._word(m[0]), s)

    def person(self, value: str) -> str:
        return _WORD.sub(lambda m: m[0] if m[0].lower() in _PARTICLES else self._word(m[0]), value)

    def email(self, value: str) -> str:
        """Every word and number of the address anew, under a top domain that no one can own."""
        at = re.search(r"@", value) or _AT.search(value)
        if not at:
            return self._words_and_digits(value, "mail")
        dots = _DOT.findall(value, at.end())
        dot = dots[-1] if dots else "."
        parts = _DOT.split(value[at.end() :])
        domain = "".join(self._words_and_digits(p, "mail") + d for p, d in zip(parts, [*dots, ""]))
        return self._words_and_digits(value[: at.start()], "mail") + at[0] + domain + dot + ("EXAMPLE" if value.isupper() else "example")

    def phone(self, value: str) -> str:
        """Country and area stay, and with them the format; the subscriber's number and the extension are new."""
        tail = _EXTENSION.search(value)
        main = value[: tail.start()] if tail else value
        digits = "".join(c for c in main if c in _DIGITS)
        fresh = iter(digits[:-SUBSCRIBER] + self._unit(PHONE, digits[-SUBSCRIBER:]))
        out = "".join(next(fresh) if c in _DIGITS else c for c in main)
        return out + (re.sub(r"[0-9]+", lambda m: self._digits(m[0], "extension"), tail[0]) if tail else "")

    def id_number(self, value: str) -> str:
        kept = m[0] if (m := _LICENCE.match(value)) else ""
        rest = value[len(kept) :]
        plain = "".join(c for c in rest if c in _DIGITS or c.lower() in _LETTERS)
        fresh = iter(self._unit(NUMBER, plain.lower()) if plain else "")
        return kept + "".join((next(fresh).upper() if c.isupper() else next(fresh)) if c in _DIGITS or c.lower() in _LETTERS else c for c in rest)

    def address(self, value: str) -> str:
        def one(m: re.Match) -> str:
            w = m[0]
            if w[0] in _DIGITS:
                return self._digits(w, "address")
            if len(w) < 3 or not w[:1].isupper() or w.lower() in _ADDRESS_WORDS:
                return w
            tail = next((t for t in _ADDRESS_TAILS if w.lower().endswith(t) and len(w) > len(t) + 2), "")
            return self._word(w[: len(w) - len(tail)]) + w[len(w) - len(tail) :]

        return _WORD_OR_DIGITS.sub(one, value)

    def item(self, kind: str, value: str) -> str:
        return getattr(self, kind)(value)

    def text(self, text: str, items: list[tuple[int, int, str]]) -> str:
        """A text with its items (start, end, kind) written anew."""
        out, at = [], 0
        for a, b, kind in sorted(items):
            if a >= at:
                out += [text[at:a], self.item(kind, text[a:b])]
                at = b
        return "".join(out) + text[at:]


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """The units of an item that are checked against the texts."""
    writer = Writer("")
    writer.used = []
    writer.item(kind, value)
    return writer.used
