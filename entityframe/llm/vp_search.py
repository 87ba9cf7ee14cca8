"""Approximate nearest neighbours by inner product: vantage-point trees per shard of the candidates, one per norm band.

Largest inner product becomes nearest Euclidean point by one extra coordinate: a candidate x is lifted to
(x, √(M² - |x|²)) with M the largest norm of the tree, a query q is scaled to length M and gets 0 there. A tree has up to 32
vantage points, chosen far apart, and keeps the distances of all its points to them. A node splits its points at the
median distance from the vantage point they spread widest from, and knows the least and largest distance to each.

By the triangle inequality a query's and a point's distances to a vantage point differ by no more than the two are apart,
and so does the root mean square of those differences over all vantage points. A node, and at a leaf a point, is left out
when ``factor`` times that bound exceeds the distance of the k-th neighbour found so far. Factor 1 is the exact search, larger
factors leave out more. How much larger the distance of near pairs is than their bound depends on the vectors, so without a
given factor each tree measures it: a few queries of a block see all points, and the factor is the largest that would
leave in ``KEEP`` of their neighbours. All queries of a block walk a tree together. Every vector is indexed. The norms in a tree differ by a factor of two at most, so a few long vectors neither flatten the distances of
the others nor coarsen their scores.

Scores are exact double sums, the same way for every pair, so that equal vectors tie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityframe.llm import ship

K = 20
KEEP = 0.8  # of the neighbours of the queries that see all points; the search keeps more, as its reach shrinks on the way
MEASURED = 8  # such queries of a block and tree, at the least
SHARD_ROWS = 8192
QUERY_ROWS = 2048
LEAF = 64
VANTAGES = 32
SAMPLE = 512  # points of a tree among which vantage points are chosen
_PAIRS = 1 << 16


@dataclass
class Node:
    points: np.ndarray  # positions, ascending
    low: np.ndarray  # least and largest distance of the points to every vantage point
    high: np.ndarray
    vantage: int = -1
    middle: float = 0.0
    near: Node | None = None
    far: Node | None = None


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """Places of ``count`` points, each as far as can be from those before it. Equal points are taken once."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def build(distance: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Node:
    """A tree over some positions, from the distances of all points to the vantage points."""
    own = distance[points]
    node = Node(points, own.min(axis=0), own.max(axis=0))
    if len(points) <= leaf:
        return node
    vantage = int(np.argmax(own.var(axis=0)))
    middle = float(np.median(own[:, vantage]))
    inside = own[:, vantage] <= middle
    if inside.all():
        inside = own[:, vantage] < middle
    if inside.any():
        node.vantage, node.middle = vantage, middle
        node.near, node.far = build(distance, points[inside], leaf), build(distance, points[~inside], leaf)
    return node


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths; squares of very short or very long vectors would leave the range of doubles."""
    most = np.abs(vectors).max(axis=1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


class Search:
    """The k best candidates of every query of a block, by score and then by the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.query_ids, self.queries = query_ids, queries
        self.k, self.factor = k, factor
        self.lengths, self.norms = lengths_of(self.vectors), lengths_of(queries)
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), len(ids), dtype=np.int64)
        self.scored = 0  # pairs whose score was worked out

    def run(self) -> Search:
        # Counted from the longest, so that vectors of one length but for rounding are in one band.
        band = np.floor(np.log2(self.lengths.max()) - np.log2(self.lengths))
        for one in np.unique(band):
            self._search(np.flatnonzero(band == one))
        return self

    def _search(self, points: np.ndarray) -> None:
        """All queries against the candidates of one norm band, in units of its largest norm."""
        self.largest = float(self.lengths[points].max())
        own = self.vectors[points] / self.largest
        rest = np.sqrt(np.maximum(1.0 - (self.lengths[points] / self.largest) ** 2, 0.0))
        lifted = np.concatenate([own, rest[:, None]], axis=1)
        unit = self.queries / np.abs(self.queries).max(axis=1)[:, None]
        unit /= lengths_of(unit)[:, None]
        aimed = np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)
        every = np.arange(len(self.queries))
        sample = np.linspace(0, len(points) - 1, min(len(points), SAMPLE)).astype(np.int64)
        vantages = sample[far_apart(lifted[sample], VANTAGES)] if len(points) > 2 * LEAF else np.empty(0, np.int64)
        if not len(vantages):
            self._leaf(points, every)
            return
        # Vantage points stand at distance 0 from themselves, which bounds nothing but themselves: all queries see them.
        self._leaf(points[vantages], every)
        self.points = points
        self.away = _distances(lifted, lifted[vantages])
        self.aim = _distances(aimed, lifted[vantages])
        rest = np.setdiff1d(np.arange(len(points)), vantages)
        self.relaxed = self.factor or 1.0
        if self.factor is None:
            some = every[:: -(-len(every) // max(MEASURED, len(every) // 64))]
            self._leaf(points[rest], some)
            self.relaxed = self._measured(some, aimed[some], lifted[rest], rest)
            every = np.setdiff1d(every, some)
        self._visit(build(self.away, rest), every)

    def _measured(self, some: np.ndarray, aimed: np.ndarray, lifted: np.ndarray, rest: np.ndarray) -> float:
        """The factor that leaves in most of the neighbours of queries that have seen all points."""
        reach = self._reach(some)[:, None]
        near = _distances(aimed, lifted) <= reach
        bound = _distances(self.aim[some], self.away[rest]) / np.sqrt(self.aim.shape[1]) / reach
        if not near.any() or not np.isfinite(bound[near]).all():
            return 1.0
        return max(1.0, 1.0 / max(float(np.quantile(bound[near], KEEP)), 1e-9))

    def _reach(self, who: np.ndarray) -> np.ndarray:
        """Lifted distance of the k-th neighbour so far, with room for rounding."""
        worst = self.scores[who, -1]
        with np.errstate(invalid="ignore", over="ignore"):
            square = 2.0 - 2.0 * (worst / self.norms[who]) / self.largest
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(square, 0.0)) + 1e-7)

    def _visit(self, node: Node, who: np.ndarray) -> None:
        gap = np.maximum(np.maximum(node.low - self.aim[who], self.aim[who] - node.high), 0.0)
        who = who[self.relaxed * np.sqrt((gap**2).mean(axis=1)) <= self._reach(who)]
        if not len(who):
            return
        if node.near is None or node.far is None:
            self._points(node.points, who)
            return
        inside = self.aim[who, node.vantage] <= node.middle
        self._visit(node.near, who[inside])
        self._visit(node.far, who)
        self._visit(node.near, who[~inside])

    def _points(self, points: np.ndarray, who: np.ndarray) -> None:
        """A leaf: the points whose own bound lets them be among the k best."""
        for at in range(0, len(points), 4 * LEAF):
            own = points[at : at + 4 * LEAF]
            bound = _distances(self.aim[who], self.away[own]) / np.sqrt(self.aim.shape[1])
            self._score(self.points[own], who, self.relaxed * bound <= self._reach(who)[:, None])

    def _leaf(self, points: np.ndarray, who: np.ndarray) -> None:
        """Points that all queries see."""
        for at in range(0, len(points), 4 * LEAF):
            own = points[at : at + 4 * LEAF]
            self._score(own, who, np.ones((len(who), len(own)), dtype=bool))

    def _score(self, points: np.ndarray, who: np.ndarray, wanted: np.ndarray) -> None:
        wanted &= self.query_ids[who][:, None] != self.ids[points][None, :]
        query, place = np.nonzero(wanted)
        self.scored += len(query)
        scores = np.full(wanted.shape, -np.inf)
        for at in range(0, len(query), _PAIRS):
            q, p = query[at : at + _PAIRS], place[at : at + _PAIRS]
            scores[q, p] = self._exact(who[q], points[p])
        # A score level with the k-th may still win by its id.
        kept = scores.max(axis=1, initial=-np.inf) >= self.scores[who, -1]
        kept &= wanted.any(axis=1)
        if kept.any():
            self._merge(points, who[kept], scores[kept])

    def _exact(self, query: np.ndarray, point: np.ndarray) -> np.ndarray:
        return (self.queries[query] * self.vectors[point]).sum(axis=1)

    def _merge(self, points: np.ndarray, who: np.ndarray, scores: np.ndarray) -> None:
        all_scores = np.concatenate([self.scores[who], scores], axis=1)
        all_found = np.concatenate([self.found[who], np.broadcast_to(points, scores.shape)], axis=1)
        by_id = np.argsort(all_found, axis=1, kind="stable")
        all_scores, all_found = np.take_along_axis(all_scores, by_id, 1), np.take_along_axis(all_found, by_id, 1)
        best = np.argsort(-all_scores, axis=1, kind="stable")[:, : self.k]
        self.scores[who], self.found[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_found, best, 1)

    def rows(self) -> pd.DataFrame:
        query, place = np.nonzero(np.isfinite(self.scores))
        return pd.DataFrame({"query_id": self.query_ids[query], "vec_id": self.ids[self.found[query, place]], "score": self.scores[query, place]})


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def nearest(
    vectors: DataFrame, every: int = 20, k: int = K, factor: float | None = None, vec_id: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors
    only meet vectors of their own length. Of rows that share an id the smallest vector counts. Ties go to the smaller
    id. With fewer candidates than ``k``, all are returned; an empty table gives no rows.
    """
    spark = ship(vectors.sparkSession)
    v = F.col("v")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & sound)
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    count, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    if not count or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, blocks = -(-count // shard_rows), -(-asked // query_rows)

    def everywhere(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    places = F.xxhash64("id")
    candidates = rows.select("id", "v", "dim", F.pmod(places, F.lit(shards)).cast("int").alias("shard"), everywhere(blocks, "block"))
    queries = rows.filter(is_query).select("id", "v", "dim", F.pmod(places, F.lit(blocks)).cast("int").alias("block"), everywhere(shards, "shard"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        grids = [np.stack(side["v"].to_list()).astype(np.float64) for side in (left, right)]
        return Search(left["id"].to_numpy(), grids[0], right["id"].to_numpy(), grids[1], k, factor).run().rows()

    keys = ["dim", "shard", "block"]
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
