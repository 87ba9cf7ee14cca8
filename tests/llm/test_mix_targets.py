"""Mixing keeps to the targets themselves over the whole schedule."""

import collections

from pyspark.sql import functions as F

from entityframe.llm import mixing


def off_targets(rows, targets, block_docs):
    """Most blocks by which any source with a target is ahead or behind when one of its blocks runs."""
    total = sum(targets.values())
    places = {(r.source, r.block, r.slot) for r in rows if targets.get(r.source)}
    assert len({slot for _, _, slot in places}) == len(places)
    return max(abs(block - slot * targets[s] / total) for s, block, slot in places)


def docs_of(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, n long")
    return rows.select("source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(F.xxhash64("source", "i").alias("doc_id"), "source")


def test_hot_source(spark):
    sizes = {f"s{i}": 1000 + 13 * i for i in range(19)} | {"hot": 10_600}
    rows = mixing.schedule(docs_of(spark, sizes), block_docs=2).collect()
    assert collections.Counter(r.source for r in rows) == sizes
    assert off_targets(rows, mixing.tempered(sizes), 2) < 2
    third = {s: 1 / 3 if s == "hot" else 2 / 57 for s in sizes}
    rows = mixing.schedule(docs_of(spark, sizes), third, block_docs=2).collect()
    assert off_targets(rows, third, 2) < 2 and all(r.release <= r.slot < r.deadline for r in rows)


def test_more_sources_than_slots_in_a_period(spark):
    sizes = {f"s{i}": 40 + i % 7 for i in range(300)}
    targets = {s: 1.0 + n * n for n, s in enumerate(sizes)}
    rows = mixing.schedule(docs_of(spark, sizes), targets, block_docs=1).collect()
    assert collections.Counter(r.source for r in rows) == sizes and off_targets(rows, targets, 1) < 2


def test_sources_without_a_target_come_last(spark):
    sizes = {"a": 90, "b": 30, "zero": 50, "left out": 20}
    rows = mixing.schedule(docs_of(spark, sizes), {"a": 0.6, "b": 0.4, "zero": 0.0}, block_docs=1).collect()
    assert collections.Counter(r.source for r in rows) == sizes
    assert max(r.slot for r in rows if r.source in "ab") < min(r.slot for r in rows if r.source not in "ab")
    assert {r.source for r in mixing.schedule(docs_of(spark, sizes), {"a": 0.0}).collect()} == set(sizes)


def test_counts_of_periods_stay_by_the_targets():
    for targets in ({"a": 1, "b": 1, "c": 1}, {f"s{i}": 1.37**i for i in range(40)}, {f"s{i}": 1 + i % 5 for i in range(700)}):
        units, had = mixing.shares(targets), collections.Counter()
        for j, counts in enumerate(mixing.period_counts(units, 64, 300), 1):
            assert min(counts.values()) >= 0 and sum(counts.values()) == 64
            had.update(counts)
            assert all(abs(had[s] * mixing.UNITS - j * 64 * u) < mixing.UNITS for s, u in units.items())
