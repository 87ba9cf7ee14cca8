"""How many pairs of similar lines share a band, by the size of their sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityframe.llm import line_dedup

PAIRS = 2000


def keys_of(spark, sets):
    """The bands of sets of shingle hashes, by number."""
    df = spark.createDataFrame(list(enumerate(sets)), "key long, hs array<long>").select("key", F.explode("hs").alias("h"))
    return {r[0]: set(r[1:]) for r in line_dedup.bands(df).collect()}


@pytest.mark.parametrize("union", [10, 15, 20, 30, 50, 65, 75, 85, 100, 150, 300, 1000])
def test_recall_at_the_threshold(spark, union):
    rng = np.random.default_rng(union)
    common = -(-union * 4 // 5)  # Jaccard 0.8, or the least above it
    sets = []
    for n in range(PAIRS):
        h = [int(x) for x in rng.integers(-(2**63), 2**63, union)]
        own = common + (union - common) * (n % 3) // 2  # all differences on one side, or shared out
        sets += [h[:own], h[:common] + h[own:]]
    keys = keys_of(spark, sets)
    met = sum(bool(keys[2 * n] & keys[2 * n + 1]) for n in range(PAIRS))
    print(f"union {union}: {PAIRS - met} of {PAIRS} missed")
    assert met >= 0.99 * PAIRS


def test_only_equal_sets_share_all_bands(spark):
    rng = np.random.default_rng(0)
    sets = [[int(x) for x in rng.integers(-(2**63), 2**63, n)] for n in [*range(1, 90), 300, 300]]
    keys = keys_of(spark, [*sets, [*sets[20], *sets[20]]])
    assert keys.pop(len(sets)) == keys[20]
    assert all(len(k) == 12 for k in keys.values()) and len(set.union(*keys.values())) == 12 * len(sets)


@pytest.mark.parametrize("union", [30, 60, 200])
def test_recall_in_bins(spark, union):
    """Long lines keep one hash a bin instead of going through every permutation, and meet as often."""
    rng = np.random.default_rng(union)
    common = -(-union * 4 // 5)
    sets = []
    for n in range(PAIRS):
        h = [int(x) for x in rng.integers(-(2**63), 2**63, union)]
        own = common + (union - common) * (n % 3) // 2
        sets += [h[:own], h[:common] + h[own:]]
    df = spark.createDataFrame(list(enumerate(sets)), "key long, hs array<long>").select("key", F.explode("hs").alias("h"))
    keys = {r.key: set(r[1:13]) - {None} for r in line_dedup.binned_bands(df).collect()}
    met = sum(bool(keys[2 * n] & keys[2 * n + 1]) for n in range(PAIRS))
    print(f"union {union}: {PAIRS - met} of {PAIRS} missed")
    assert met >= PAIRS - 2


def test_sets_that_leave_bins_empty_are_named(spark):
    rng = np.random.default_rng(5)
    sets = [[int(x) for x in rng.integers(-(2**63), 2**63, n)] * k for n, k in [(1, 900), (12, 50), (29, 20), (35, 1), (900, 1)]]
    df = spark.createDataFrame(list(enumerate(sets)), "key long, hs array<long>").select("key", F.explode("hs").alias("h"))
    got = {r.key: r for r in line_dedup.binned_bands(df).collect()}
    assert [got[n].full for n in range(5)] == [False] * 4 + [True]
    assert None in got[0][1:13] and None not in got[4][1:13]


def test_lines_meet_on_both_sides_of_the_border(make):
    """Similar lines just under and over ``LONG`` shingles, and a long line that repeats the few shingles of a short one."""
    rng = random.Random(1)
    lines = []
    for n in range(60):
        base = "".join(rng.choice("abcdefghijklmnop") for _ in range(line_dedup.LONG + 11 - 1 - n % 4))
        lines += [base, base + "x" * (n % 4 + 1)]
    for n in range(60):
        word = "".join(rng.choice("abcdefghijklmnop") for _ in range(14 + n % 6))
        lines += [(word * 5)[: 11 + len(word)], word * (3 + n)]
    got = line_dedup.dedup_lines(make(list(enumerate(lines))), whole=True).collect()
    assert {r.doc_id for r in got if not r.n_removed} == set(range(0, 240, 2))
