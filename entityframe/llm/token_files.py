"""Token ids of documents in a binary file format: Simple-8b words with offsets for reading by block.

Documents are range-sorted by id; each partition becomes one part of the file set, a sequence of blocks of bounded
size. A block carries its document ids, their lengths and their ids, each as a stream, and for every ``SKIP`` ids the
word at which decoding can start, so a reader can decode any stretch, and all of it, with a few array operations.
Parts are Parquet tables of such blocks, written by Spark's committer: a lost task leaves nothing behind.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.llm import ship, simple8b
from entityframe.llm.pieces import Codes, cut, laid_out
from entityframe.session import staging_path

MAGIC = b"ID8B"
BLOCK_IDS = 1 << 16
SKIP = 1 << 14
END_ID = 2
REMEMBERED = 1_200_000  # words a worker keeps, in some 250 MB
_HEADER = struct.Struct("<4sIQQQQ")  # magic, skip, documents, ids, words of lengths, words of ids
_NO_ID = -(1 << 63)


class Encoder:
    """Encodes texts with a byte-level tokenizer, each piece once as long as it is remembered.

    Tokens of such a tokenizer never reach over the blank or line break before a word, so all new words of a batch are
    encoded as one text, and its ids are cut where a token begins with either.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(names.values()) + 1, dtype=bool)
        self.begins[[i for name, i in names.items() if name[0] in _BEFORE_WORDS]] = True
        self.codes = Codes(self._pieces, limit=REMEMBERED)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[tuple[np.ndarray, np.ndarray]]:
        """Ids of words with a blank before them, or with the line break they bring; where the first has a blank in front,
        of words as they stand."""
        if pieces[0][0] == " ":
            return (laid_out(self._ids([p[1:] for p in pieces])),)
        words = [p if p[0] == "\n" else " " + p for p in pieces]
        ids = np.array(self._ids(["".join(words)])[0], dtype=np.uint32)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):
            return (laid_out(self._ids(words)),)
        return ((ids, np.diff(starts, append=len(ids))),)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [cut(t) if t else None for t in texts]
        self.codes.forget()
        sizes = np.fromiter((len(own) if own else 0 for own in words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        # A text's first word has no blank before it.
        codes = np.empty(int(sizes.sum()), dtype=np.int64)
        first = np.zeros(len(codes), dtype=bool)
        first[(ends - sizes)[sizes > 0]] = True
        codes[first] = self.codes.of([" " + own[0] for own in words if own])
        codes[~first] = self.codes.of([w for own in words if own for w in own[1:]])
        flat, token_ends = self.codes.runs[0].joined(codes)
        bounds = np.concatenate([[0], token_ends])[np.concatenate([[0], ends])]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        whole = [i for i, own in enumerate(words) if own is None and texts[i]]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = np.array(ids, dtype=np.uint32)
        return out


# How byte-level vocabularies write a blank and a line break.
_BEFORE_WORDS = ("\u0120", "\u010a")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that what it remembers outlives a task."""
    return Encoder(path)


def pack_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: header, document ids, offsets, lengths, ids. Streams of ids start anew every ``SKIP`` ids."""
    sizes = simple8b.encode(lengths)
    runs = [simple8b.encode(ids[at : at + SKIP]) for at in range(0, len(ids), SKIP)]
    offsets = np.cumsum([0, *map(len, runs)]).astype("<u4")
    words = np.concatenate(runs) if runs else np.empty(0, np.uint64)
    head = _HEADER.pack(MAGIC, SKIP, len(doc_ids), len(ids), len(sizes), len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), offsets.tobytes(), sizes.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a block."""
    magic, skip, docs, n, size_words, words_n = _HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEADER.size
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    at += 8 * docs
    offsets = np.frombuffer(block, "<u4", -(-n // skip) + 1, at)
    at += 4 * len(offsets)
    lengths = simple8b.decode(np.frombuffer(block, "<u8", size_words, at), docs)
    words = np.frombuffer(block, "<u8", words_n, at + 8 * size_words)
    runs = [simple8b.decode(words[a:b], min(skip, n - i * skip)) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
    return doc_ids, lengths.astype(np.int64), np.concatenate(runs) if runs else np.empty(0, np.uint64)


def write(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, append the end id, and write blocks in ascending order of the document id.

    Null texts count as empty: the end id alone. Rows without an id come first; rows with equal ids in the order of a hash
    of their text. A text longer than a block makes a longer block.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for rows in parts:
            names = rows["doc_id"].fillna(_NO_ID).astype("int64").to_numpy() if rows["doc_id"].isna().any() else rows["doc_id"].to_numpy(dtype=np.int64)
            texts = rows["text"].tolist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= 3 * BLOCK_IDS):
                    chars += len(texts[end]) + 1
                    end += 1
                ids = [np.append(x, np.uint32(end_id)) for x in encoder(tokenizer).encode(texts[start:end])]
                lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                n = int(lengths.sum())
                block = pack_block(names[start:end], lengths, np.concatenate(ids))
                yield pd.DataFrame({"part": [part], "block": [number], "before": [before], "n_docs": [end - start], "n_ids": [n], "bytes": [block]})
                number, before, start = number + 1, before + n, end

    blocks = ordered.mapInPandas(run, "part int, block long, before long, n_docs long, n_ids long, bytes binary")
    blocks.write.option("compression", "zstd").mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    ship(spark)
    blocks = spark.read.parquet(path)
    # One row per part, and a part is a task of the writer: a few bytes for each file written.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for row in totals:
        offsets.append((row["part"], total))
        total += row["n"]
    at = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    placed = blocks.select("part", "before", "bytes").join(at, "part").select((F.col("offset") + F.col("before")).alias("first"), "bytes")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first, block in zip(part["first"], part["bytes"], strict=True):
                names, lengths, ids = unpack_block(block)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                found = pd.Series(names, dtype="Int64").mask(names == _NO_ID)
                yield pd.DataFrame({"doc_id": found, "start": int(first) + ends - lengths, "n_tokens": lengths, "ids_crc32": sums})

    return placed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the file set to the shared folder and read it back."""
    path = staging_path(docs.sparkSession, "token-ids")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
