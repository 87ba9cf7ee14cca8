"""Alignment of two tokenizers over the same texts: groups of tokens that cover the same bytes, links between ids.

Tokens of both sides are laid over the bytes of a text. Offsets where tokens of both end cut the text into groups; an A and
a B token whose byte ranges overlap are linked. All documents of a slice are merged in lockstep: one vector holds a pointer
into the A tokens and one into the B tokens for every lane, and each step links the tokens pointed at, advances the side
that ends first (both at a cut) and drops finished lanes. A long document takes several lanes, which start at every
``LANE``-th A token with the B token over the same byte.

How often an id pair is linked in the corpus is counted block by block and summed by Spark. Every block then asks for the
totals of its own pairs by a join, so nothing that grows with the corpus is broadcast or collected. A block is stored as a
row per document and a row per pair in small row groups, and workers get few texts at a time, so what an executor holds
does not grow with the partitions of the input either.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityframe.llm import ship
from entityframe.llm.pieces import Codes, cut, laid_out
from entityframe.session import settings, stage

LANE = 256
BLOCK_CHARS = 2 << 20
SLICE_CHARS = 1 << 19  # texts of a block that are encoded and merged at once
REMEMBERED = 300_000  # pieces a worker keeps; their ids on both sides take some 100 MB
ENCODED = 4096  # pieces encoded at once: what the encoders return is many times the ids
_SHIFT = 32

# Texts that a worker gets at once, and row groups of few blocks.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.max": "256"}

# A row of a document has no ``at``; a row of a pair has only ``block`` and the last three.
_ROWS = pa.schema([
    *((c, pa.int64()) for c in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("links", pa.binary()),
    ("at", pa.int32()), ("pair", pa.int64()), ("n", pa.int64()),
])
BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, at int, pair long, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass(frozen=True)
class Tokens:
    """Tokens of the aligned texts of a batch, text after text: ids and where each token ends, in bytes of the batch."""

    ids: np.ndarray
    ends: np.ndarray
    texts: np.ndarray  # ends of each text's tokens


def merge(a_ends: np.ndarray, b_ends: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as A and B positions in order, and which A and B tokens end a group.

    Both sides end at the same bytes wherever a text ends, so a lane may start at any A token: the other pointer stands on
    the first B token that ends after the A token's start.
    """
    starts = np.arange(0, len(a_ends), lane)
    at_byte = np.concatenate([[0], a_ends])[starts]
    a, b = starts.copy(), np.searchsorted(b_ends, at_byte, side="right")
    stop = np.minimum(starts + lane, len(a_ends))
    lanes = np.arange(len(starts))
    a_cut, b_cut = np.zeros(len(a_ends), dtype=bool), np.zeros(len(b_ends), dtype=bool)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(a):
        steps.append((lanes, a, b))
        first, second = a_ends[a], b_ends[b]
        a_done, b_done = first <= second, second <= first
        both = a_done & b_done
        a_cut[a[both]] = True
        b_cut[b[both]] = True
        a, b = a + a_done, b + b_done
        alive = a < stop
        if not alive.all():
            a, b, stop, lanes = a[alive], b[alive], stop[alive], lanes[alive]
    if not steps:
        return a, b, a_cut, b_cut
    # Lanes hold consecutive links, and each lane's come in order.
    order = np.argsort(np.concatenate([s[0] for s in steps]), kind="stable")
    return np.concatenate([s[1] for s in steps])[order], np.concatenate([s[2] for s in steps])[order], a_cut, b_cut


class Pair:
    """The two tokenizers, and what they gave for pieces met before."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = _byte_level(self.a)
        self.b_bytes = _piece_bytes(self.b)
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.codes = Codes(self._pieces, sides=3, limit=REMEMBERED)
        names = [[str(i) for i in range(len(sizes))] for sizes in (self.a_sizes, self.b_sizes)]
        self.spelled = [x + mark for side, marks in zip(names, (",|", ",;"), strict=True) for mark in marks for x in side]

    def _a_texts(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """A's ids, B's ids, and whether both spell the piece, a bounded number of pieces at once."""
        parts = [self._encoded(pieces[at : at + ENCODED]) for at in range(0, len(pieces), ENCODED)]
        return tuple((np.concatenate([flat for flat, _ in side]), np.concatenate([size for _, size in side])) for side in zip(*parts, strict=True))

    def _encoded(self, pieces: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """What ``_pieces`` gives, for a few pieces.

        B puts a blank before what it is given, which is right but for a piece after a line break: the blank's token is
        taken off again.
        """
        spelled = [p if p[0] == "\n" else " " + p for p in pieces]
        a, b = self._a_texts(spelled), self.b.encode(pieces, num_threads=1)
        b = [ids[1:] if p[0] == "\n" else ids for p, ids in zip(pieces, b, strict=True)]
        return laid_out(a), laid_out(b), laid_out([[self._spells(*x)] for x in zip(spelled, a, b, strict=True)])

    def _spells(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode("utf-8", "surrogatepass")
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, Tokens, Tokens]:
        """Which texts have tokens, and the tokens of those on both sides."""
        words = [cut(t) if t else None for t in texts]
        self.codes.forget()
        codes = self.codes.of([w for own in words if own for w in own])
        bounds = np.cumsum([0, *(len(own) if own else 0 for own in words)])
        runs = [r.joined(codes) for r in self.codes.runs]
        right = np.concatenate([[0], np.cumsum(runs[2][0] == 0)])[bounds]
        aligned = np.diff(right) == 0
        sides = []
        edges = [np.concatenate([[0], ends])[bounds] for _, ends in runs[:2]]
        own: list[list] = [[], []]
        for i, t in enumerate(texts):
            if t and words[i] is None:
                whole = self._a_texts([" " + t])[0], self.b.encode([t], num_threads=1)[0]
                aligned[i] = self._spells(" " + t, *whole)
                tokens = [np.array(x, dtype=np.uint32) for x in whole]
            else:
                aligned[i] = aligned[i] and bool(t)
                tokens = [runs[s][0][edges[s][i] : edges[s][i + 1]] for s in (0, 1)]
            if aligned[i]:
                own[0].append(tokens[0])
                own[1].append(tokens[1])
        for runs_of, sizes in zip(own, (self.a_sizes, self.b_sizes), strict=True):
            ids = np.concatenate(runs_of).astype(np.int64) if runs_of else np.empty(0, dtype=np.int64)
            sides.append(Tokens(ids, np.cumsum(sizes[ids]), np.cumsum([len(x) for x in runs_of], dtype=np.int64)))
        return aligned, sides[0], sides[1]

    def digests(self, a: Tokens, b: Tokens, a_cut: np.ndarray, b_cut: np.ndarray) -> list[str]:
        """Per text, the digest of its groups as text: ids of a side apart by commas, sides by a bar, groups by semicolons."""
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        groups = int(a_cut.sum())
        a_total, b_total = np.cumsum(np.bincount(a_group, minlength=groups)), np.cumsum(np.bincount(b_group, minlength=groups))
        spelled = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        n_a, n_b = len(self.a_sizes), len(self.b_sizes)
        spelled[np.arange(len(a.ids)) + np.concatenate([[0], b_total])[a_group]] = a.ids + n_a * a_cut
        spelled[np.arange(len(b.ids)) + a_total[b_group]] = 2 * n_a + b.ids + n_b * b_cut
        out, at, names = [], 0, self.spelled
        for end in (a.texts + b.texts).tolist():
            text = "".join([names[i] for i in spelled[at:end].tolist()])
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest())
            at = end
        return out

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Sizes of each text's alignment (A tokens, B tokens, groups, links), its digest, and the id pairs of all links in order."""
        aligned, a, b = self.encode(texts)
        a_at, b_at, a_cut, b_cut = merge(a.ends, b.ends)
        counted = np.zeros((4, len(texts)), dtype=np.int64)
        link_ends = np.searchsorted(a_at, a.texts, side="left")
        cut_ends = np.concatenate([[0], np.cumsum(a_cut)])[a.texts]
        for row, ends in enumerate((a.texts, b.texts, cut_ends, link_ends)):
            counted[row, aligned] = np.diff(ends, prepend=0)
        digests = np.full(len(texts), "", dtype=object)
        digests[aligned] = self.digests(a, b, a_cut, b_cut)
        return counted, digests.tolist(), a.ids[a_at] << _SHIFT | b.ids[b_at]

    def block(self, number: int, ids: list[int | None], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        """The rows of a block: its documents, with their links as numbers of its own pairs, and its pairs."""
        slices = np.cumsum([len(t) if t else 0 for t in texts]) // SLICE_CHARS
        edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(texts)]
        parts = [self.align(texts[start:stop]) for start, stop in itertools.pairwise(edges)]
        counted, groups = np.concatenate([c for c, _, _ in parts], axis=1), [x for _, own, _ in parts for x in own]
        pairs, links, counts = np.unique(np.concatenate([x for _, _, x in parts]), return_inverse=True, return_counts=True)
        # The commonest pairs take the smallest numbers, which compress best.
        rank = np.argsort(-counts, kind="stable")
        place = np.empty(len(rank), dtype=np.uint32)
        place[rank] = np.arange(len(rank), dtype=np.uint32)
        links = [_narrow(x) for x in np.split(place[links.reshape(-1)], np.cumsum(counted[3])[:-1])]
        yield _rows({
            "block": np.full(len(ids), number), "doc_id": ids, "n_a": counted[0], "n_b": counted[1], "n_groups": counted[2], "n_links": counted[3],
            "groups": groups, "links": links,
        })
        yield _rows({"block": np.full(len(rank), number), "at": np.arange(len(rank), dtype=np.int32), "pair": pairs[rank], "n": counts[rank]})


def _rows(columns: dict) -> pa.RecordBatch:
    """Rows of a block, null in the columns not given."""
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)


def _narrow(numbers: np.ndarray) -> bytes:
    """Low halves of all numbers, then the high halves, which are mostly zero."""
    numbers = numbers.astype("<u4")
    return (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()


def _widen(raw: bytes) -> np.ndarray:
    halves = np.frombuffer(raw, dtype="<u2").astype(np.int64)
    n = len(halves) // 2
    return halves[:n] | halves[n:] << 16


def _byte_level(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary. Printable bytes stand for themselves, the others in order for the
    code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(shown)]
    back = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(hidden)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        known = all(c in back for c in token)
        out[i] = bytes(back[c] for c in token) if known else token.encode()
    return out


def _piece_bytes(model) -> list[bytes]:
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]


@functools.cache
def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    """One pair for each worker process, so that what it remembers outlives a task."""
    return Pair(a_path, b_path)


def blocks(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of documents: a row per document with its counts, digest and links, a row per pair of the block with its count.

    A block ends once its texts have ``block_chars`` characters, so a longer text stands alone in its own. The rows are
    written to the shared folder, which fixes the blocks' numbers.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        number = TaskContext.get().partitionId() << 32
        both = tokenizer_pair(a_path, b_path)
        ids: list[int | None] = []
        texts: list[str | None] = []
        chars = 0
        for part in parts:
            for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                size = len(t) if t else 0
                if texts and chars + size > block_chars:
                    yield from both.block(number, ids, texts)
                    number, ids, texts, chars = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                chars += size + 1
        if texts:
            yield from both.block(number, ids, texts)

    with settings(docs.sparkSession, SMALL_BATCHES):
        return stage(rows.mapInArrow(run, BLOCKS), "token-blocks", "zstd", SMALL_GROUPS)


def _pairs(done: DataFrame) -> DataFrame:
    """``(block, at, pair, n)``: the pairs of each block by their number in it."""
    return done.filter(F.col("at").isNotNull()).select("block", "at", "pair", "n")


def pair_counts(done: DataFrame) -> DataFrame:
    """``(pair, a_id, b_id, count, best)`` for every linked id pair of the corpus.

    ``best`` marks the pairs of a B id that are linked most often, ties included. There are at most as many B ids as the
    vocabulary has, so the highest counts by B id have a fixed bound and are broadcast.
    """
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    total = stage(_pairs(done).groupBy("pair").agg(F.sum("n").alias("count")).select("pair", F.shiftright("pair", _SHIFT).alias("a_id"), b_id.alias("b_id"), "count"), "pair-counts")
    most = total.groupBy("b_id").agg(F.max("count").alias("most"))
    return total.join(F.broadcast(most), "b_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row: sizes of its alignment, ``n_best`` and ``count_sum`` over its links, digest of its groups.

    A is a byte-level tokenizer that gets the text with a blank before it, B a sentence-piece model that adds the blank
    itself. Texts that are null or empty, or that the tokens of either side do not spell byte for byte, have no tokens:
    zeros and an empty digest. Repeated rows and rows without an id count like any other; other columns are not read.
    """
    done = blocks(docs, a_path, b_path, doc_id, text, block_chars)
    totals = pair_counts(done).select("pair", "count", "best")
    asked = _pairs(done).join(totals, "pair").select(F.col("block").alias("asking"), "at", "count", "best")

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        count = np.zeros(answers.num_rows, dtype=np.int64)
        best = np.zeros(answers.num_rows, dtype=np.int64)
        at = answers["at"].to_numpy()
        count[at] = answers["count"].to_numpy()
        best[at] = answers["best"].to_numpy()
        links = np.concatenate([_widen(x) for x in block["links"].to_pylist()])
        ends = np.cumsum(block["n_links"].to_numpy())
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends], prepend=0) for x in (best, count)]
        same = {c: block[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table({**same, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": block["groups"]})

    kept = done.filter(F.col("at").isNull()).drop("at", "pair", "n")
    return kept.groupBy("block").cogroup(asked.groupBy("asking")).applyInArrow(run, RESULT)
