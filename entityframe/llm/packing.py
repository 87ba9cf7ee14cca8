"""Best-fit packing of documents into training sequences, with conflicts.

A bin is one sequence of at most ``capacity`` tokens. It carries a bitmap of the sources and one of the duplicate
clusters it holds; a piece fits only where neither its source nor its cluster is present. Bins are kept in order of
what is left in them: the search starts at the first bin with room enough and goes on to the next larger one until it
finds a compatible bin, which is then the tightest one. Pieces come longest first.

Pieces are dealt by a hash (or by a column given) into shards of a bounded number of pieces, each packed on its own, so
no source or cluster ever meets in one task; a shard costs its last few bins at most.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityframe.llm import ship
from entityframe.llm.text import long_size, words
from entityframe.session import stage

CAPACITY = 2048
SHARD_PIECES = 2048
_BINS_LOG = 20


class Shard:
    """The open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_residual: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> int:
        """Bin of a piece whose source and cluster are single bits (0: no conflict possible)."""
        for at in range(bisect_left(self.by_residual, (size, -1)), len(self.by_residual)):
            residual, number = self.by_residual[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.by_residual[at]
                break
        else:
            residual, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if residual > size:
            insort(self.by_residual, (residual - size, number))
        return number


def bits(values: pd.Series) -> list[int]:
    """A bit for each value that several rows share; a value that occurs once cannot conflict, nor can null."""
    shared = values.map(values.value_counts()).fillna(0) > 1
    codes = pd.factorize(values.where(shared))[0]
    return [0 if c < 0 else 1 << int(c) for c in codes]


def pack_shard(pieces: pd.DataFrame, capacity: int) -> list[int]:
    """Bin numbers of a shard's pieces, in the order of the rows."""
    order = pieces.assign(_row=range(len(pieces))).sort_values(["n_tokens", "doc_id", "cluster", "piece"], ascending=[False, True, True, True], kind="stable")
    shard, out = Shard(capacity), [0] * len(pieces)
    for row, size, source, cluster in zip(order["_row"], order["n_tokens"], bits(order["source"]), bits(order["cluster"]), strict=True):
        out[row] = shard.put(int(size), source, cluster)
    return out


def pack(
    docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    cluster: Column | None = None, length: Column | None = None, order: Column | None = None, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, n_tokens, source, cluster, bin_id``.

    A document longer than ``capacity`` is cut into full pieces and a rest; ``start`` is the piece's first token. Tokens
    are words unless ``length`` says otherwise. ``cluster`` names a document's duplicates (default: equal texts).
    ``order`` is a number that grows with the documents' place in a mix: neighbours are then packed together; without it
    the shard is a hash. Documents without tokens (null and empty texts) get one row with no tokens and a null bin.
    Null sources conflict with nothing. Rows with null or repeated ids are packed like any other.
    """
    ship(docs.sparkSession)
    size = long_size(words(F.col(text))) if length is None else length.cast("long")
    group = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if cluster is None else cluster.cast("long")
    named = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), group.alias("cluster"),
        size.alias("size"), (F.lit(None) if order is None else order).cast("double").alias("place"),
    )
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("long")
    cut = named.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).withColumn("start", F.col("piece") * capacity)
    pieces = stage(cut.withColumn("n_tokens", F.least(F.col("size") - F.col("start"), F.lit(capacity))).drop("size"), "pieces", "zstd")

    filled = pieces.filter("n_tokens > 0")
    total, top = filled.agg(F.count("*"), F.max("place")).first()
    shards = max(1, -(-total // shard_pieces))
    by_hash = F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards))
    if top is not None:
        # Stretches of the order, each with its share of the pieces up to the unevenness of the order; cut again by hash,
        # so that a stretch that holds more than a shard's worth is split.
        stretch = F.least(F.floor(F.col("place") * (shards / (top + 1.0))), F.lit(shards - 1))
        per = filled.groupBy(stretch.alias("stretch")).agg(F.ceil(F.count("*") / shard_pieces).alias("parts"))
        dealt = filled.withColumn("stretch", stretch).join(per, "stretch")
        part = F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.col("parts"))
        dealt = dealt.withColumn("shard", F.col("stretch") * F.lit(1 << 20) + part).drop("stretch", "parts")
    else:
        dealt = filled.withColumn("shard", by_hash)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        found = [shard * (1 << _BINS_LOG) + b for b in pack_shard(part, capacity)]
        return part[["doc_id", "piece", "start", "n_tokens", "source", "cluster"]].assign(bin_id=found)

    schema = "doc_id long, piece long, start long, n_tokens long, source string, cluster long, bin_id long"
    packed = dealt.drop("place").groupBy("shard").applyInPandas(run, schema)
    empty = pieces.filter("n_tokens <= 0").select("doc_id", "piece", "start", "n_tokens", "source", "cluster", F.lit(None).cast("long").alias("bin_id"))
    return packed.union(empty)
