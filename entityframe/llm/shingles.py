"""Word shingles of whole texts as sorted 64-bit hashes, computed in batches with numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BATCH_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """``base`` to the powers 0 … n-1, modulo 2^64."""
    out = np.ones(n, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def batches(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of the list that hold about ``limit`` bytes, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and the number of words of each text.

    A word is a run of bytes other than ASCII white space. Its hash is a polynomial over random byte codes, taken for all
    words at once from running sums, then mixed.
    """
    buffer = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    power = powers(len(buffer) + 1, _ODD)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[buffer] * power[:-1], out=sums[1:])
    # Scale every word to the same power, so that equal words hash alike wherever they stand.
    hashes = mix((sums[ends] - sums[starts]) * powers(len(buffer) + 1, _inverse(_ODD))[starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.diff(np.searchsorted(starts, bounds + 1))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        own = words[at : at + n]
        at += n
        m = min(n, width)
        if n == 0:
            out.append(own)
            continue
        total = np.zeros(n - m + 1, dtype=np.uint64)
        for j in range(m):
            total = mix(total + own[j : n - m + 1 + j] + np.uint64((j + 1) * int(_ODD) % (1 << 64)))
        out.append(np.unique(total if n >= width else mix(total + np.uint64(n))))
    return out


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
