"""Pieces of texts and what they encode to: a piece met before is not encoded again.

Where single blanks and line breaks part the words of a text, tokenizers whose tokens never reach over the start of such a
run give for the whole text what they give for its pieces one after the other. A piece begins with the blank or line break
before its word; other texts are left whole.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Callable

import numpy as np


# White space other than blanks and line breaks; texts that have any are left whole.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def cut(text: str) -> list[str] | None:
    """The words of a text, those after a line break with it in front; None unless single blanks and line breaks, and no
    other white space, part the words."""
    words = text.replace("\n", " \n").split(" ")
    if "" in words or "\n" in words or any(c in text for c in _OTHER):
        return None
    return words


class Runs:
    """Runs of numbers, kept one after the other in arrays that grow by doubling."""

    def __init__(self, kind: type):
        self.flat = np.empty(1 << 16, dtype=kind)
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.sizes = np.empty(1 << 14, dtype=np.int64)
        self.used = self.count = 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        """Append runs that stand one after the other in ``flat``."""
        total, count = len(flat), len(size)
        self.flat = _room(self.flat, self.used, total)
        self.starts = _room(self.starts, self.count, count)
        self.sizes = _room(self.sizes, self.count, count)
        self.flat[self.used : self.used + total] = flat
        self.starts[self.count : self.count + count] = self.used + np.cumsum(size) - size
        self.sizes[self.count : self.count + count] = size
        self.used += total
        self.count += count

    def joined(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of some codes one after the other, and where each ends."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(total)], ends


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    out = np.empty(max(2 * len(array), used + more), dtype=array.dtype)
    out[:used] = array[:used]
    return out


def laid_out(runs: list[list[int]], kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as one array and their sizes."""
    sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    return np.fromiter(itertools.chain.from_iterable(runs), dtype=kind, count=int(sizes.sum())), sizes


class Codes:
    """A number for every piece, and the runs of numbers an encoder gives for it, one run a side.

    ``encode`` takes new pieces and gives for each side their runs, laid out, with their sizes. ``limit`` bounds what is
    remembered: once it is passed, the next call starts anew, so frequent pieces are soon known again and rare ones do not
    fill the memory.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[tuple[np.ndarray, np.ndarray], ...]], sides: int = 1, kind: type = np.uint32, limit: int = 600_000):
        self.encode, self.sides, self.kind, self.limit = encode, sides, kind, limit
        self._clear()

    def _clear(self) -> None:
        # A piece that is looked up for the first time takes the next number.
        self.codes: dict[str, int] = collections.defaultdict(itertools.count().__next__)
        self.runs = [Runs(self.kind) for _ in range(self.sides)]

    def forget(self) -> None:
        """Start anew if the limit is passed; codes given out before do not hold any more."""
        if len(self.codes) > self.limit:
            self._clear()

    def of(self, pieces: list[str]) -> np.ndarray:
        known = len(self.codes)
        found = np.fromiter(map(self.codes.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if len(self.codes) > known:
            new = list(itertools.islice(reversed(self.codes), len(self.codes) - known))[::-1]
            for runs, own in zip(self.runs, self.encode(new), strict=True):
                runs.add(*own)
        return found
