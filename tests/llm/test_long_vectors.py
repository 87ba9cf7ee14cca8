"""One long vector among even ones does not spoil the search."""

import collections

import numpy as np
import pytest

from entityframe.llm import vp_search


@pytest.mark.parametrize(("factor", "times"), [(1.0, 1e6), (None, 1e6), (1.0, 1e3)])
def test_one_vector_much_longer(spark, factor, times):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(3000, 12))
    base /= np.sqrt((base**2).sum(axis=1))[:, None]
    base[501:560] = base[500]  # ties
    base[1234] *= times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in vp_search.nearest(df, factor=factor, shard_rows=1000).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    common = 0
    for q in range(0, 3000, 20):
        scores = (base[q] * base).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        own = [got[q][k][0] for k in range(1, 21)]
        assert all(got[q][k][1] == scores[got[q][k][0]] for k in range(1, 21))
        assert factor is None or own == want
        common += len(set(own) & set(want))
    assert common >= 0.9 * 20 * 150


@pytest.mark.parametrize("kind", ["even", "flat", "groups"])
def test_recall_and_share(kind):
    """Vectors without structure, on a plane, and in tight groups: at most half of the pairs scored at a recall of 0.9; factor 1 is exact."""
    rng = np.random.default_rng(3)
    base = {"even": lambda: rng.normal(size=(4000, 64)), "flat": lambda: rng.normal(size=(4000, 2)) @ rng.normal(size=(2, 64)), "groups": lambda: rng.normal(size=(80, 64))[rng.integers(0, 80, 4000)] + 0.2 * rng.normal(size=(4000, 64))}[kind]()
    base /= np.sqrt((base**2).sum(axis=1))[:, None]
    ids = np.arange(4000)
    asked = ids % 20 == 0
    scores = base[asked] @ base.T
    scores[np.arange(200), ids[asked]] = -9
    kth = np.sort(scores, axis=1)[:, -20]
    search = vp_search.Search(ids, base, ids[asked], base[asked], 20).run()
    assert (search.scores >= kth[:, None] - 1e-12).mean() >= 0.9 and search.scored <= 0.5 * 200 * 3999
    exact = vp_search.Search(ids, base, ids[asked], base[asked], 20, 1.0).run()
    assert np.allclose(exact.scores[:, -1], kth, atol=1e-12)


def test_very_short_and_very_long_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 8))
    base[40] *= 1e-170
    base[41] *= 1e150
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in vp_search.nearest(df, factor=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 400, 20):
        scores = (base[q] * base).sum(axis=1)
        assert got[q] == [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:20]
