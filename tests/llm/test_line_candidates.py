"""Which lines of a crowded bucket are compared."""

import itertools
import random

import pytest

from entityframe.llm import line_dedup


def similar(a, b):
    return 180 * len(a & b) >= 80 * (len(a) + len(b))


def crowd(rng, n, size=200):
    """Sets about one base: most lose a fifth of it and more, so that they are alike but not similar; some have a twin."""
    base, own = list(range(size)), itertools.count(size)
    sets = []
    for k in range(n):
        cut = rng.sample(base, round(size * (0.75 + 0.1 * rng.random())))
        sets.append({*cut, *(next(own) for _ in range(size - len(cut) + rng.randrange(40)))})
        if k % 10 == 0:
            sets.append({*rng.sample(sorted(sets[-1]), len(sets[-1]) - 8), *(next(own) for _ in range(4))})
    return sets


def candidates_of(spark, sets, component):
    rows = [(k, component[k], sorted(s)) for k, s in enumerate(sets)]
    return {(r.a, r.b) for r in line_dedup.candidates(spark.createDataFrame(rows, "key long, component long, hashes array<long>")).collect()}


@pytest.mark.parametrize("block", [4, 256])
@pytest.mark.parametrize("joined", [1, 3])
def test_no_similar_pair_is_left_out(spark, monkeypatch, block, joined):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(joined)
    sets = [*crowd(rng, 60), *(set(rng.sample(range(30), rng.randint(1, 30))) for _ in range(80))]
    component = [k if k % joined == 0 else 0 for k in range(len(sets))]
    got = candidates_of(spark, sets, component)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if component[a] != component[b] and similar(sets[a], sets[b])}
    assert want and want <= got and all(a < b and component[a] != component[b] for a, b in got)


def test_a_crowd_is_not_compared_pair_by_pair(spark):
    made = {n: len(candidates_of(spark, sets, range(len(sets)))) for n in (100, 400) for sets in [crowd(random.Random(n), n)]}
    assert made[100] <= 5 * 100 and made[400] <= 5 * 400
