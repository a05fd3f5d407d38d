"""Kernel of bounded-space online packing into windows of fixed capacity."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from typing import Any

Window = tuple[int, list[Any]]  # used size, items


class Packer:
    """Keeps at most ``open_windows`` windows; best fit, and the fullest leaves when none fits.

    The open windows are kept ordered by free room, so that best fit is a binary search.
    """

    def __init__(self, capacity: int, open_windows: int = 64):
        self.capacity, self.most = capacity, open_windows
        self.room: list[int] = []  # ascending
        self.held: list[list[Any]] = []

    def put(self, size: int, items: list[Any]) -> Window | None:
        """Place items of a total size; the window that had to leave, if any."""
        if size > self.capacity:
            raise ValueError("an item exceeds the capacity")
        i = bisect.bisect_left(self.room, size)
        left: Window | None = None
        if i < len(self.room):  # tightest window that still has room
            room, held = self.room.pop(i) - size, self.held.pop(i)
            held.extend(items)
        else:
            if len(self.room) >= self.most:
                left = (self.capacity - self.room.pop(0), self.held.pop(0))
            room, held = self.capacity - size, list(items)
        if room == 0:
            if left is None:
                return (self.capacity, held)
            # both are due: keep the full one open, it is the next to leave
        j = bisect.bisect_left(self.room, room)
        self.room.insert(j, room)
        self.held.insert(j, held)
        return left

    def rest(self) -> Iterator[Window]:
        while self.room:
            yield self.capacity - self.room.pop(0), self.held.pop(0)


def merge(capacity: int, windows: Iterable[Window]) -> Iterator[Window]:
    """Join partly filled windows, largest first, without splitting any; best fit with no bound on open ones."""
    packer = Packer(capacity, 1 << 60)
    for size, items in sorted(windows, key=lambda w: (-w[0], w[1][0])):
        if (done := packer.put(size, items)) is not None:
            yield done
    yield from packer.rest()
