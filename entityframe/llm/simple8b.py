"""Simple-8b: whole numbers packed into 64-bit words, as many to a word as fit at one width.

The top four bits of a word select how many values it holds and at which width. Selector 0 is an escape: the next word is
one value of over 60 bits as it is. The last word of a stream may hold padding; readers know the number of values.
"""

from __future__ import annotations

import numpy as np

# Selector: (values, bits each). Fixed values of the format; selector 0 is the escape, selector 1 a run of zeros.
MODES = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([c for c, _ in MODES], dtype=np.int64)
_SHORT = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < 1 << 16:
        return _SHORT[values.astype(np.uint16)]
    out = np.zeros(len(values), dtype=np.uint8)
    rest = values.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        large = rest >> np.uint64(shift) != 0
        out[large] += np.uint8(shift)
        rest[large] >>= np.uint64(shift)
    return out + (rest != 0).astype(np.uint8)


def _selectors(values: np.ndarray) -> np.ndarray:
    """At each position, the selector that takes the most values from there on.

    A selector fits where the widest of its next values does. Those maxima over more and more values come from shorter
    ones; what lies behind the end counts as no bits, so a short tail is padded.
    """
    n, most = len(values), max(c for c, _ in MODES)
    best = np.zeros(n, dtype=np.uint8)
    widest = np.zeros(n + most, dtype=np.uint8)
    widest[:n] = _bit_lengths(values)
    reach = 1
    for s in range(len(MODES) - 1, 0, -1):
        count, bits = MODES[s]
        while reach < count:
            step = min(reach, count - reach)
            widest[: len(widest) - step] = np.maximum(widest[: len(widest) - step], widest[step:])
            reach += step
        best[widest[:n] <= bits] = s
    return best


def encode(values: np.ndarray) -> np.ndarray:
    """Words for unsigned 64-bit values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    chosen = _selectors(values)
    step = _COUNTS[chosen].tolist()
    starts, i = [], 0
    note = starts.append
    while i < n:
        note(i)
        i += step[i]
    first = np.array(starts, dtype=np.int64)
    modes = chosen[first] if n else chosen
    size = np.where(modes == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(120, dtype=np.uint64)])
    for s in np.unique(modes).tolist():
        own, at = first[modes == s], place[modes == s]
        if s == 0:
            words[at + 1] = values[own]
            continue
        count, bits = MODES[s]
        word = np.full(len(own), s << 60, dtype=np.uint64)
        for j in range(count if bits else 0):
            word |= padded[own + j] << np.uint64(j * bits)
        words[at] = word
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of a stream."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    modes = (words >> np.uint64(60)).astype(np.int64)
    lead = np.ones(len(words), dtype=bool)
    if (modes == 0).any():  # the word after an escape is a value, whatever its top bits
        i, heads = 0, []
        kinds = modes.tolist()
        while i < len(kinds):
            heads.append(i)
            i += 2 if kinds[i] == 0 else 1
        lead[:] = False
        lead[heads] = True
    index = np.flatnonzero(lead)
    modes = modes[index]
    counts = _COUNTS[modes]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(modes).tolist():
        at, own = place[modes == s], index[modes == s]
        if s == 0:
            out[at] = words[own + 1]
            continue
        count, bits = MODES[s]
        for j in range(count if bits else 0):
            out[at + j] = (words[own] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    return out[:n]
