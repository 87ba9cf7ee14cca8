"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes is evaluated once and gives two signature values, its minimum and its maximum,
so a signature of 2k values costs k evaluations. Values are banded; documents meet in a bucket when all values of a band
agree. The number of bands follows from the similarity wanted and the chance allowed to miss a pair.

Meeting in a bucket only proposes a link; every link is confirmed on the full shingle sets. Within a bucket no list of
all pairs is made: documents with equal sets count once, the rest are held against the smallest id of the bucket first,
which joins true copies into one component. Only buckets that still hold several components go on, cut into blocks of
bounded size; each pair of blocks is one task, which counts common shingles of all its pairs at once and returns no
more than a spanning set of links. No pair is skipped, however large the bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityframe.llm import shingles as S
from entityframe.llm import ship
from entityframe.llm.components import components
from entityframe.session import stage

BAND_VALUES = 6  # three permutations, two values each
MISS = 1e-6
BLOCK = 256
_ROWS = 2048


def band_count(percent: int, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold shares none of them with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** BAND_VALUES))


def permutations(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_11))
    n = bands * BAND_VALUES // 2
    odd = rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, size=n, dtype=np.uint64)


def min_max(shingles: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of the set under every permutation."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(odd), dtype=np.uint64)
    for at in range(0, len(shingles), _ROWS):
        values = shingles[at : at + _ROWS, None] * odd + shift
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, bands: int) -> np.ndarray:
    values = np.concatenate([low.reshape(bands, -1), high.reshape(bands, -1)], axis=1)
    key = S.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for column in values.T:
        key = S.mix(key + column)
    return key.view(np.int64)


def similar(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def sketch(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document ``n_shingles``, a hash of its text, a digest of its shingle set (null if empty) and its band keys."""
    bands = band_count(percent)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd, shift = permutations(bands)
        for part in parts:
            texts = [S.lowered(t) for t in part["text"]]
            for start, end in S.batches(texts):
                sets = S.shingle_sets(texts[start:end], width)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].iloc[start:end].array,
                        "n_shingles": [len(s) for s in sets],
                        "mark": part["mark"].iloc[start:end].array,
                        "digest": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                        "bands": [band_keys(*min_max(s, odd, shift), bands) if len(s) else None for s in sets],
                    }
                )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return rows.mapInPandas(run, "doc_id long, n_shingles long, mark long, digest binary, bands array<long>")


def _confirm(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs with both texts, those that are similar on their full sets."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            hubs: dict[int, np.ndarray] = {}
            keep = []
            for a, x, y in zip(part["a"], part["a_text"], part["b_text"], strict=True):
                if a not in hubs:
                    hubs = {a: S.shingle_sets([S.lowered(x)], width)[0]}
                own, other = hubs[a], S.shingle_sets([S.lowered(y)], width)[0]
                inter = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(similar(inter, len(own), len(other), percent))
            yield part.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def block_links(ids: np.ndarray, groups: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different groups among the rows of one or two blocks, a spanning set of them.

    ``sides`` numbers the two blocks; with two, only pairs across them are looked at.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, times = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    common = times[token] > 1
    owner, token = owner[common], token[common]
    _, token = np.unique(token, return_inverse=True)
    inter = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = max(1, (32 << 20) // max(1, 4 * len(sets)))
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    tokens = int(token[-1]) + 1 if len(token) else 0
    for at in range(0, tokens, step):
        lo, hi = np.searchsorted(token, [at, at + step])
        has = np.zeros((len(sets), min(step, tokens - at)), dtype=np.float32)
        has[owner[lo:hi], token[lo:hi] - at] = 1
        inter += has @ has.T
    linked = 100 * inter.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - inter.astype(np.int64))
    linked &= groups[:, None] != groups[None, :]
    if len(set(sides.tolist())) > 1:
        linked &= sides[:, None] != sides[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = root(int(groups[i])), root(int(groups[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _links_in_blocks(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components that still share a bucket; ``members`` has ``key, rep, component``."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = sizes.filter("low < high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "rep", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sets = S.shingle_sets([S.lowered(t) for t in part["text"]], width)
        found = block_links(part["rep"].to_numpy(), part["component"].to_numpy(), part["block"].to_numpy(), sets, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.join(texts, "rep").groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 · |A ∩ B| ≥ ``percent`` · |A ∪ B| holds for their sets of ``width``-word shingles (A-Z in
    lower case); the component is everything reachable over links and named by its smallest id; ``kept`` marks the
    document that names it. Null and empty texts have an empty set and no link. A row without an id takes no part: its
    component is null and it is kept. Repeated rows come back as often as they came. Where an id has several texts, each of
    them has the links of its own set; a component that holds any of them may be named by the id.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = stage(sketch(docs, width, percent), "sketch", "zstd")
    known = sketches.filter("doc_id is not null and digest is not null")
    # A class is all documents with one set. It is a node of the links under a number of its own, whatever their ids.
    least = F.min(F.struct("doc_id", "mark"))
    classes = known.groupBy("digest").agg(least.alias("first"), F.first("bands").alias("bands"))
    classes = stage(classes.select("digest", F.xxhash64("digest").alias("rep"), "first", "bands"), "classes", "zstd")

    rows = classes.select("rep", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = stage(rows.join(hubs, "key"), "members", "zstd")
    wanted = classes.select("rep", "first").join(members.select("rep").distinct(), "rep")
    wanted = wanted.select("rep", F.col("first.doc_id").alias("__id"), F.col("first.mark").alias("__mark"))
    own = docs.join(wanted, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__mark")))
    texts = stage(own.groupBy("rep").agg(F.min("text").alias("text")), "texts", "zstd")

    pairs = members.filter("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    first = texts.select(F.col("rep").alias("a"), F.col("text").alias("a_text"))
    second = texts.select(F.col("rep").alias("b"), F.col("text").alias("b_text"))
    links = stage(_confirm(pairs.join(second, "b").join(first, "a"), width, percent), "links")

    first_round = components(links).withColumnRenamed("id", "rep")
    # Every member of a bucket was held against its hub.
    placed = members.filter("rep <> hub").select("key", "rep").join(first_round, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = stage(placed, "placed", "zstd")
    more = _links_in_blocks(placed, texts, width, percent)
    reached = components(links.union(more)).withColumnRenamed("id", "rep")

    placed = classes.select("digest", "rep", F.col("first.doc_id").alias("id")).join(reached, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    names = placed.groupBy("component").agg(F.min("id").alias("of_class"))
    named = placed.join(names, "component").select("digest", "of_class")
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
