"""Kernel that cuts one oversized text into pieces at natural boundaries.

All greedy cuts are derived at once by pointer doubling: every boundary is joined to its
farthest legal successor (the overlap included), the successor table is squared until it
spans the text, and the cuts are the boundaries reached from the beginning.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Natural pauses from strongest to weakest; a boundary lies behind the match.
_PAUSES = (
    re.compile(r"\n[ \t\r]*\n+\s*(?=\S)"),  # paragraph
    re.compile(r"\n"),  # line
    re.compile(r"[.!?…。！？][\"'»”)\]]*\s+(?=\S)"),  # sentence
    re.compile(r"[,;:]\s+|\s+(?=\S)"),  # clause or word
)


def boundaries(text: str, char_token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token positions at which the text may be cut, ascending, and the strength of each pause.

    ``char_token``: token position of every character boundary, -1 inside a token.
    """
    n_tokens = int(char_token[-1])
    strength = np.zeros(n_tokens + 1, np.int8)
    at = char_token[char_token >= 0]
    strength[at] = 1  # between tokens, at a whole character
    for level, pattern in zip((5, 4, 3, 2), _PAUSES):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        if len(ends):
            t = char_token[ends]
            t = t[t >= 0]
            strength[t] = np.maximum(strength[t], level)
    strength[0] = strength[n_tokens] = 6
    places = np.nonzero(strength)[0]
    return places, strength[places]


def successors(places: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Index of the farthest legal successor of every boundary.

    A piece that ends at e is followed by one that starts ``overlap`` tokens before e (at
    the last whole boundary at or before that) and ends at most ``limit`` tokens later.
    Among the legal ends in the second half of what can be added the strongest kind of
    pause wins, and of that kind the farthest; the end of the text wins always.
    """
    start_at = np.searchsorted(places, np.maximum(places - overlap, 0), side="right") - 1
    start = places[start_at]
    start[0] = 0
    reach = start + limit
    far = np.searchsorted(places, reach, side="right") - 1
    index = np.arange(len(places))
    far = np.maximum(far, np.minimum(index + 1, len(places) - 1))  # a token longer than the limit stays whole
    half = np.searchsorted(places, places + (places[far] - places + 1) // 2, side="left")
    half = np.clip(half, np.minimum(index + 1, far), far)
    best = far.copy()
    settled = far == len(places) - 1
    for level in (5, 4, 3, 2):
        # last boundary of at least this strength at or before each index
        last = np.maximum.accumulate(np.where(strength >= level, index, -1))[far]
        ok = ~settled & (last >= half) & (last > index)
        best[ok] = last[ok]
        settled |= ok
    best[-1] = len(places) - 1
    return best


def reached(succ: np.ndarray) -> np.ndarray:
    """Boundaries on the path from the first to the last one, by squaring the table."""
    on = np.zeros(len(succ), bool)
    on[0] = True
    table = succ
    span = 1
    while True:
        on[table[on]] = True
        if span >= len(succ):
            break
        table = table[table]
        span *= 2
        if (table == len(succ) - 1).all():
            on[table[on]] = True
            # every remaining cut lies on a shorter jump already applied or is the end
            break
    return np.nonzero(on)[0]


def cut(text: str, char_token: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) token positions of the pieces."""
    n_tokens = int(char_token[-1])
    if n_tokens <= limit:
        return [(0, n_tokens)]
    places, strength = boundaries(text, char_token)
    succ = successors(places, strength, limit, overlap)
    path = reached(succ)
    pieces = []
    for a, b in zip(path[:-1], path[1:]):
        end = int(places[b])
        s = 0 if a == 0 else int(places[np.searchsorted(places, max(places[a] - overlap, 0), side="right") - 1])
        if end - s > limit:  # a long token leaves no room for the whole overlap
            s = min(int(places[np.searchsorted(places, end - limit)]), int(places[a]))
        pieces.append((s, end))
    return pieces


def byte_positions(text: str) -> np.ndarray:
    """UTF-8 offset of every character boundary."""
    if text.isascii():
        return np.arange(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    return np.concatenate([[0], np.cumsum(size)])


def char_tokens(text: str, lengths: np.ndarray | None) -> np.ndarray:
    """Token position of every character boundary, -1 where a token spans it.

    ``lengths``: UTF-8 length of every token in order; None for one token per byte.
    """
    at = byte_positions(text)
    if lengths is None:
        return at
    ends = np.concatenate([[0], np.cumsum(lengths)])
    i = np.searchsorted(ends, at)
    i = np.minimum(i, len(ends) - 1)
    return np.where(ends[i] == at, i, -1)


LEAST_LIMIT = 4  # a character has at most four bytes and so at most four tokens


def split_text(text: str, limit: int, overlap: int, token_lengths: Callable[[str], np.ndarray] | None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces, in characters; every piece has at most ``limit`` tokens by itself.

    Consecutive pieces share ``overlap`` tokens, counted inside the text and rounded up to a
    whole character; they share fewer only where a character of several tokens leaves no room.
    Cut out of its surroundings a piece can have a few tokens more than the same stretch had
    inside the text; then the text is cut again a little shorter, until every piece fits (down
    to single characters, which always do).
    """
    if limit < LEAST_LIMIT or not 0 <= overlap < limit:
        raise ValueError(f"a limit of {limit} tokens and an overlap of {overlap} cannot be kept")
    lengths = token_lengths(text) if token_lengths else None
    where = char_tokens(text, lengths)
    total = int(where[-1])
    if total <= limit:
        return [(0, len(text), total)]
    chars = np.nonzero(where >= 0)[0]
    char_of = dict(zip(where[chars].tolist(), chars.tolist()))
    room = limit
    while True:
        pieces = []
        worst = 0
        for s, e in cut(text, where, room, min(overlap, room - 1)):
            a, b = char_of[s], char_of[e]
            n = len(token_lengths(text[a:b])) if token_lengths else e - s
            worst = max(worst, n - limit)
            pieces.append((a, b, n))
        if worst <= 0 or room == 1:
            return pieces
        room = max(1, room - worst if worst < room // 4 else room * 3 // 4)
