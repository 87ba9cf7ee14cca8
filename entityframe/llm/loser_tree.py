"""Merging sorted runs of byte strings with a loser tree that knows common prefixes.

Every string carries the length of the prefix it shares with the last string that was output. Of two such strings the
one that shares more comes first, without a look at its bytes; only on a tie are bytes compared, and then from the
shared length on. Known prefixes are never compared again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from dataclasses import dataclass


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that the first ``known`` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return known + (n - known) - (x.bit_length() + 7) // 8


@dataclass
class Head:
    """The first string left of a run, and what it shares with the last output."""

    run: int
    at: int
    text: bytes
    shared: int


def _beats(a: Head | None, b: Head | None) -> tuple[bool, int]:
    """Whether a comes before b (ties by run), and what the later of the two shares with the earlier."""
    if a is None or b is None:
        return b is None, 0
    if a.shared != b.shared:
        return a.shared > b.shared, min(a.shared, b.shared)
    n = common_prefix(a.text, b.text, a.shared)
    if n == len(a.text) or n == len(b.text):
        first = len(a.text) < len(b.text) or (len(a.text) == len(b.text) and a.run < b.run)
    else:
        first = a.text[n] < b.text[n]
    return first, n


class LoserTree:
    """``runs``: sorted strings of each run, with the prefix each shares with the one before it in its run."""

    def __init__(self, runs: Sequence[tuple[Sequence[bytes], Sequence[int]]]):
        self.runs = runs
        self.width = 1
        while self.width < max(1, len(runs)):
            self.width *= 2
        heads: list[Head | None] = [Head(r, 0, texts[0], 0) if len(texts) else None for r, (texts, _) in enumerate(runs)]
        heads += [None] * (self.width - len(heads))
        self.losers: list[Head | None] = [None] * self.width
        self.winner = self._fill(1, heads)

    def _fill(self, node: int, heads: list[Head | None]) -> Head | None:
        if node >= self.width:
            return heads[node - self.width]
        return self._play(node, self._fill(2 * node, heads), self._fill(2 * node + 1, heads))

    def _play(self, node: int, a: Head | None, b: Head | None) -> Head | None:
        """Leave the later one at the node and return the earlier one.

        What the later one shares with the earlier replaces what it shares with the last output: it will be looked at
        again only once the earlier one has been output.
        """
        first, n = _beats(a, b)
        best, other = (a, b) if first else (b, a)
        if other is not None:
            other.shared = n
        self.losers[node] = other
        return best

    def merge(self) -> Iterator[tuple[int, int, int]]:
        """``(run, position in the run, prefix shared with the output before)`` in sorted order."""
        while (best := self.winner) is not None:
            yield best.run, best.at, best.shared
            texts, shares = self.runs[best.run]
            at = best.at + 1
            head = Head(best.run, at, texts[at], int(shares[at])) if at < len(texts) else None
            node = (self.width + best.run) // 2
            while node:
                head = self._play(node, head, self.losers[node])
                node //= 2
            self.winner = head
