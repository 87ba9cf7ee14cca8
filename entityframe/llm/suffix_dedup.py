"""Exact removal of repeated byte strings with a sparse suffix array, sorted by a distributed merge.

Every string of ``LENGTH`` bytes has a minimiser: the 40-byte gram in it with the smallest hash. Equal strings have equal
minimisers at equal places, so suffixes need to be sorted only where a gram is the minimiser of some string around it
(about one byte in 31), and of those only where the gram's hash occurs twice in the corpus.

1. Documents are written once as blocks of some megabytes; a block is the unit of all later work.
2. Each block sends the hashes of its minimisers, one row per hash; hashes that occur twice are sent back.
3. Each block sorts the suffixes that start at those, cut to the bytes a string can reach, and front-codes them into
   runs, one for each slice of the hash range. What repeats within the block in full is settled there and not sent.
4. Each slice merges its runs with a loser tree that never compares a known prefix again. Neighbours that share the
   gram form a group; all strings around the gram are compared within it, and all but the first are marked.
5. Each block gets its marked strings back as intervals and cuts them out.

A gram that a third of all documents share costs a slice one entry per block and different surrounding, not one per
document. Strings are compared by 64-bit hashes within a group of equal grams.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityframe.llm import shingles as S
from entityframe.llm import ship
from entityframe.llm.loser_tree import LoserTree
from entityframe.session import stage

LENGTH = 100
GRAM = 40
LEFT = LENGTH - GRAM
BLOCK_BYTES = 8 << 20
_BATCH = 2 << 20
_ODD = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.iinfo(np.uint64).max
_NO_ID = (1 << 63) - 1
_ROWS = 16_384


# --- blocks -----------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """Documents of a block, one after another: ``order`` ranks them (rows without an id come last)."""

    order: np.ndarray
    missing: np.ndarray
    ends: np.ndarray
    bytes: bytes

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def dump(self) -> bytes:
        n = len(self.order)
        raw = b"".join([struct.pack("<q", n), self.order.astype("<i8").tobytes(), self.missing.astype("u1").tobytes(), self.ends.astype("<i8").tobytes(), self.bytes])
        return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def load(blob: bytes) -> Block:
        raw = pa.decompress(blob[8:], decompressed_size=struct.unpack("<q", blob[:8])[0], codec="zstd", asbytes=True)
        n = struct.unpack("<q", raw[:8])[0]
        order, missing = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "u1", n, 8 + 8 * n).astype(bool)
        return Block(order, missing, np.frombuffer(raw, "<i8", n, 8 + 9 * n), raw[8 + 17 * n :])


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, docs``: blocks of about ``block_bytes``, named by where they were made; to be staged at once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 33, 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def made() -> pd.DataFrame:
            order = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)
            block = Block(order, np.array([i is None for i in ids], dtype=bool), np.cumsum([len(t) for t in texts]), b"".join(texts))
            return pd.DataFrame({"block": [base + number], "docs": [block.dump()]})

        for part in parts:
            for i, t in zip(part["doc_id"], part["text"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield made()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield made()

    return docs.mapInPandas(run, "block long, docs binary")


# --- minimisers -------------------------------------------------------------------------------------------------------


def _windows_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of pieces of that length."""
    n = len(values)
    padded = np.full(-(-n // width) * width, _NONE, dtype=np.uint64)
    padded[:n] = values
    pieces = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(pieces, axis=1).ravel()
    back = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


@dataclass
class Anchors:
    """Minimisers: place, hash of the gram, and the least and most bytes before it in a string that it stands for."""

    at: np.ndarray
    hash: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _anchors_of(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Anchors:
    n = len(buffer)
    windows = n - LENGTH + 1
    if windows <= 0:
        return Anchors(*[np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64)])
    power = S.powers(n + 1, _ODD)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(S._BYTE_CODES[buffer] * power[:n], out=sums[1:])
    grams = S.mix((sums[GRAM:] - sums[:-GRAM]) * S.powers(n - GRAM + 1, S._inverse(_ODD)))
    least = _windows_least(grams, LEFT + 1)
    # A string lies in one document.
    inside = np.zeros(windows + 1, dtype=np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:windows]) > 0
    # Where the minimiser changes from one string to the next, and which gram it is.
    held = np.flatnonzero(valid)
    if not len(held):
        return Anchors(*[np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64)])
    marked = np.where(valid, least, np.uint64(0))
    padded = np.concatenate([np.zeros(LEFT, np.uint64), marked, np.zeros(LEFT, np.uint64)])
    most_around = ~_windows_least(~padded, LEFT + 1)
    at = np.flatnonzero(most_around == grams)
    around = at[:, None] - np.arange(LEFT + 1)[None, :]  # starts of strings, by bytes before the gram
    inside_window = (around >= 0) & (around < windows)
    stands = inside_window & (marked[np.clip(around, 0, windows - 1)] == grams[at][:, None])
    any_ = stands.any(axis=1)
    at, stands = at[any_], stands[any_]
    return Anchors(at, grams[at], stands.argmax(axis=1), LEFT - stands[:, ::-1].argmax(axis=1))


def anchors(block: Block) -> Anchors:
    """Minimisers of all documents of a block, places counted in the block."""
    buffer, starts, out = np.frombuffer(block.bytes, np.uint8), block.starts, []
    lengths = (block.ends - starts).tolist()
    i = 0
    while i < len(lengths):
        j, size = i, 0
        while j < len(lengths) and (j == i or size + lengths[j] <= _BATCH):
            size += lengths[j]
            j += 1
        low, high = int(starts[i]), int(block.ends[j - 1])
        own = _anchors_of(buffer[low:high], starts[i:j] - low, block.ends[i:j] - low)
        own.at = own.at + low
        out.append(own)
        i = j
    if not out:
        return _anchors_of(buffer[:0], starts, block.ends)
    return Anchors(*[np.concatenate([getattr(a, f) for a in out]) for f in ("at", "hash", "least", "most")])


def repeated_grams(blocks: DataFrame) -> DataFrame:
    """``block, hash`` of every gram hash that occurs twice in the corpus, for each block that has it."""

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, blob in zip(part["block"], part["docs"], strict=True):
                hashes, counts = np.unique(anchors(Block.load(blob)).hash, return_counts=True)
                for at in range(0, len(hashes), 1 << 17):
                    own = slice(at, at + (1 << 17))
                    yield pd.DataFrame({"hash": hashes[own].view(np.int64), "block": name, "many": counts[own] > 1})

    def twice(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for part in parts:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            hashes = rows["hash"].to_numpy()
            same = hashes[1:] == hashes[:-1]
            keep = rows["many"].to_numpy(dtype=bool).copy()
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= hashes[0] == last
            # The last row waits: the next one may share its hash.
            yield rows.loc[keep, ["block", "hash"]].iloc[: -1 if keep[-1] else None]
            held = rows.iloc[-1:].assign(many=bool(keep[-1]))
            last = hashes[-1]
        if held is not None and bool(held["many"].iloc[0]):
            yield held[["block", "hash"]]

    rows = blocks.mapInPandas(found, "hash long, block long, many boolean")
    return rows.repartition("hash").sortWithinPartitions("hash").mapInPandas(twice, "block long, hash long")


# --- runs -------------------------------------------------------------------------------------------------------------


@dataclass
class Run:
    """Sorted suffixes of a block: bytes from the gram on, bytes before it, and where they stand."""

    right: np.ndarray  # n × LENGTH, zeros beyond ``reach``
    reach: np.ndarray
    left: np.ndarray  # n × LEFT, aligned to the gram
    least: np.ndarray
    most: np.ndarray
    order: np.ndarray
    doc: np.ndarray
    at: np.ndarray

    _plain = (("reach", "u1"), ("least", "u1"), ("most", "u1"), ("order", "<i8"), ("doc", "<i4"), ("at", "<i8"))

    def __len__(self) -> int:
        return len(self.at)

    def take(self, rows: np.ndarray) -> Run:
        return Run(*[getattr(self, f)[rows] for f in ("right", "reach", "left", "least", "most", "order", "doc", "at")])

    def shares(self) -> np.ndarray:
        """Prefix each suffix shares with the one before."""
        out = np.zeros(len(self), dtype=np.int64)
        if len(self) > 1:
            differ = self.right[1:] != self.right[:-1]
            common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
            out[1:] = np.minimum(common, np.minimum(self.reach[1:], self.reach[:-1]))
        return out

    def dump(self) -> bytes:
        """Front-coded: of each suffix only what follows the prefix it shares with the one before."""
        shares, column = self.shares(), np.arange(LENGTH)
        tails = self.right[(column >= shares[:, None]) & (column < self.reach[:, None])]
        lefts = self.left[np.arange(LEFT) >= LEFT - self.most[:, None]]
        raw = b"".join(
            [struct.pack("<qqq", len(self), len(tails), len(lefts)), shares.astype("u1").tobytes()]
            + [getattr(self, f).astype(t).tobytes() for f, t in self._plain]
            + [tails.tobytes(), lefts.tobytes()]
        )
        return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def load(blob: bytes) -> tuple[Run, np.ndarray]:
        raw = pa.decompress(blob[8:], decompressed_size=struct.unpack("<q", blob[:8])[0], codec="zstd", asbytes=True)
        n, tails_n, lefts_n = struct.unpack("<qqq", raw[:24])
        at = 24
        shares = np.frombuffer(raw, "u1", n, at).astype(np.int64)
        at += n
        own = {}
        for f, t in Run._plain:
            own[f] = np.frombuffer(raw, t, n, at).astype(np.int64)
            at += n * np.dtype(t).itemsize
        tails, lefts = np.frombuffer(raw, np.uint8, tails_n, at), np.frombuffer(raw, np.uint8, lefts_n, at + tails_n)
        column = np.arange(LENGTH)
        new = (column >= shares[:, None]) & (column < own["reach"][:, None])
        right = np.zeros((n, LENGTH), dtype=np.uint8)
        right[new] = tails
        # A byte that is not new is that of the nearest row above whose shared prefix ends before it.
        source = np.maximum.accumulate(np.where(column >= shares[:, None], np.arange(n)[:, None], 0), axis=0)
        right = np.take_along_axis(right, source, axis=0)
        right[column >= own["reach"][:, None]] = 0
        left = np.zeros((n, LEFT), dtype=np.uint8)
        left[np.arange(LEFT) >= LEFT - own["most"][:, None]] = lefts
        return Run(right, own["reach"], left, own["least"], own["most"], own["order"], own["doc"], own["at"]), shares


def _around(buffer: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    index = places[:, None] + np.arange(width)[None, :]
    return np.where((index >= 0) & (index < len(buffer)), buffer[np.clip(index, 0, max(0, len(buffer) - 1))], 0).astype(np.uint8)


def block_suffixes(block: Block, wanted: np.ndarray) -> tuple[Run, np.ndarray]:
    """Suffixes at the minimisers whose hash is wanted, with the hashes, by rank of the document and place in it."""
    own = anchors(block)
    keep = np.isin(own.hash, wanted)
    at, hashes, least, most = own.at[keep], own.hash[keep], own.least[keep], own.most[keep]
    doc = np.searchsorted(block.ends, at, side="right")
    inner = at - block.starts[doc]
    order = np.lexsort((inner, block.order[doc]))
    at, hashes, least, most, doc, inner = (x[order] for x in (at, hashes, least, most, doc, inner))
    buffer = np.frombuffer(block.bytes, np.uint8)
    reach = LENGTH - least
    right = _around(buffer, at, LENGTH)
    right[np.arange(LENGTH) >= reach[:, None]] = 0
    left = _around(buffer, at - LEFT, LEFT)
    left[np.arange(LEFT) < LEFT - most[:, None]] = 0
    return Run(right, reach, left, least, most, block.order[doc], doc, inner), hashes


def settle(suffixes: Run) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes repeat an earlier document position's surrounding in full, and which are to be sent."""
    n = len(suffixes)
    code = S.powers(LENGTH + LEFT, _ODD) * np.uint64(3)
    digest = np.zeros(n, dtype=np.uint64)
    for a in range(0, n, _ROWS):
        rows = np.concatenate([suffixes.left[a : a + _ROWS], suffixes.right[a : a + _ROWS]], axis=1)
        digest[a : a + _ROWS] = (S._BYTE_CODES[rows] * code).sum(axis=1, dtype=np.uint64)
    digest = S.mix(digest + (suffixes.least * 128 + suffixes.most).astype(np.uint64))
    _, first, group = np.unique(digest, return_index=True, return_inverse=True)
    at_first = first[group]
    is_first = at_first == np.arange(n)
    # Rows with one id at one place are the same document twice: neither is earlier.
    twin = (suffixes.order == suffixes.order[at_first]) & (suffixes.at == suffixes.at[at_first])
    return ~is_first & ~twin, is_first | twin


# --- intervals --------------------------------------------------------------------------------------------------------


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals by document, those that touch or overlap made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, start, end
    codes = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    lift = np.int64(end.max() + 1)
    reach = np.maximum.accumulate(end + codes * lift) - codes * lift
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(head)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def later_strings(run: Run, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all strings around grams: the rows and starts of those that an earlier one in the same group equals.

    ``group`` numbers the rows' grams, ascending.
    """
    rows_out, starts_out = [], []
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.array([0])
    power, inverse = S.powers(LEFT + LENGTH, _ODD), S.powers(LEFT + 1, S._inverse(_ODD))
    a = 0
    while a < len(bounds) - 1:
        b = a + 1
        while b < len(bounds) - 1 and bounds[b + 1] - bounds[a] <= _ROWS:
            b += 1
        rows = np.arange(bounds[a], bounds[b])
        key, row, start, order = [], [], [], []
        for c in range(0, len(rows), _ROWS):
            own = rows[c : c + _ROWS]
            text = np.concatenate([run.left[own], run.right[own]], axis=1)
            sums = np.zeros((len(own), LEFT + LENGTH + 1), dtype=np.uint64)
            np.cumsum(S._BYTE_CODES[text] * power, axis=1, out=sums[:, 1:])
            before = np.arange(LEFT + 1)
            from_ = LEFT - before
            hashes = (sums[:, from_ + LENGTH] - sums[:, from_]) * inverse[from_]
            i, j = np.nonzero((before >= run.least[own][:, None]) & (before <= run.most[own][:, None]))
            key.append(S.mix(S.mix(hashes[i, j]) + group[own][i].astype(np.uint64) * _ODD))
            row.append(own[i])
            start.append(run.at[own][i] - before[j])
            order.append(run.order[own][i])
        keys, row_, start_, order_ = (np.concatenate(x) for x in (key, row, start, order))
        by = np.lexsort((start_, order_, keys))
        keys, row_, start_, order_ = keys[by], row_[by], start_[by], order_[by]
        head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (order_ != order_[first]) | (start_ != start_[first])
        rows_out.append(row_[later])
        starts_out.append(start_[later])
        a = b
    return (np.concatenate(rows_out), np.concatenate(starts_out)) if rows_out else (np.empty(0, np.int64), np.empty(0, np.int64))


def merge_runs(runs: list[tuple[Run, np.ndarray]]) -> tuple[Run, np.ndarray, np.ndarray]:
    """All suffixes in sorted order, the number of each one's gram, and the run it came from; lone grams are left out."""
    tree = LoserTree([([row[:r].tobytes() for row, r in zip(run.right, run.reach.tolist(), strict=True)], shares.tolist()) for run, shares in runs])
    merged = np.array(list(tree.merge()), dtype=np.int64).reshape(-1, 3)
    offsets = np.cumsum([0, *[len(run) for run, _ in runs]])
    place = offsets[merged[:, 0]] + merged[:, 1]
    group = np.cumsum(merged[:, 2] < GRAM)
    pair = np.zeros(len(group), dtype=bool)
    pair[1:] |= group[1:] == group[:-1]
    pair[:-1] |= group[1:] == group[:-1]
    whole = Run(*[np.concatenate([getattr(run, f) for run, _ in runs]) for f in ("right", "reach", "left", "least", "most", "order", "doc", "at")])
    return whole.take(place[pair]), group[pair], merged[pair, 0]


# --- the operator -----------------------------------------------------------------------------------------------------

_MESSAGE = "slice long, block long, kind int, payload binary"


def _dump_intervals(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return pa.compress(np.stack([doc, start, end]).astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _load_intervals(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=size * 24, codec="zstd", asbytes=True), "<i8").reshape(3, -1)


def marked(blocks: DataFrame, grams: DataFrame, slices: int) -> DataFrame:
    """``block, n, intervals``: what to cut, as intervals within the documents of a block."""

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, blob in zip(left["block"], left["docs"], strict=True):
            wanted = np.unique(right["hash"].to_numpy(dtype=np.int64).view(np.uint64))
            if not len(wanted):
                continue
            suffixes, hashes = block_suffixes(Block.load(blob), wanted)
            gone, sent = settle(suffixes)
            part = (hashes % np.uint64(slices)).astype(np.int64)
            if gone.any():
                found = joined(suffixes.doc[gone], (suffixes.at - suffixes.most)[gone], (suffixes.at - suffixes.least)[gone] + LENGTH)
                out.append((int(name) % slices, int(name), len(found[0]), _dump_intervals(*found)))
            rows = np.flatnonzero(sent)
            text = np.ascontiguousarray(suffixes.right[rows]).view(f"S{LENGTH}").ravel()
            rows = rows[np.lexsort((suffixes.reach[rows], text, part[rows]))]
            cuts = np.flatnonzero(np.concatenate([[True], part[rows][1:] != part[rows][:-1], [True]])) if len(rows) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((int(part[rows[a]]), int(name), -1, suffixes.take(rows[a:b]).dump()))
        return pd.DataFrame(out, columns=["slice", "block", "kind", "payload"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        settled = part["kind"] >= 0
        out = list(part.loc[settled, ["block", "kind", "payload"]].itertuples(index=False, name=None))
        sent = part[~settled]
        if len(sent):
            runs = [Run.load(blob) for blob in sent["payload"]]
            names = sent["block"].to_numpy()
            suffixes, group, run = merge_runs(runs)
            rows, starts = later_strings(suffixes, group)
            owner, docs = names[run[rows]] if len(rows) else np.empty(0, np.int64), suffixes.doc[rows]
            for name in np.unique(owner).tolist():
                own = owner == name
                found = joined(docs[own], starts[own], starts[own] + LENGTH)
                out.append((name, len(found[0]), _dump_intervals(*found)))
        return pd.DataFrame(out, columns=["block", "n", "intervals"])

    sent = blocks.groupBy("block").cogroup(grams.groupBy("block")).applyInPandas(send, _MESSAGE)
    return sent.groupBy("slice").applyInPandas(merge, "block long, n int, intervals binary")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the remaining bytes as ``kept``.

    A byte goes if it is covered by a 100-byte string that also starts earlier, in a document of smaller id or earlier in
    its own; strings are judged on the input. Null and empty texts have no bytes. Rows without an id come after all
    others and, like rows that share an id, do not count as earlier than each other at the same place; all rows come
    back. Only the two columns named are read.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // (2 * block_bytes)))
    blocks = stage(to_blocks(own, block_bytes), "byte-blocks", "uncompressed")
    cuts = marked(blocks, repeated_grams(blocks), slices)

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [_load_intervals(blob, n) for blob, n in zip(right["intervals"], right["n"], strict=True)]
        doc, start, end = joined(*np.concatenate(found, axis=1)) if found else [np.empty(0, np.int64)] * 3
        out = []
        for blob in left["docs"]:
            block = Block.load(blob)
            bounds = np.searchsorted(doc, np.arange(len(block.order) + 1))
            for i, (order, missing, low, high) in enumerate(zip(block.order.tolist(), block.missing.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True)):
                a, b = bounds[i], bounds[i + 1]
                edges = [0, *np.stack([start[a:b], end[a:b]], axis=1).ravel().tolist(), high - low]
                kept = b"".join(block.bytes[low + x : low + y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                row = (None if missing else order, high - low, high - low - len(kept), int(b - a), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if keep_text else row)
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    names = [c.split()[0] for c in schema.split(", ")]
    return blocks.groupBy("block").cogroup(cuts.groupBy("block")).applyInPandas(apply, schema)
