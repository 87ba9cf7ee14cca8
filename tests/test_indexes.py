"""Digest trees, mergeable profiles, page indexes and tables by id: same results, and only what is needed is read."""

import random

import pytest
from pyspark.sql import functions as F

from entityframe.operators import digests, listing, ordinal, schemas, versions
from entityframe.session import settings
from entityframe.sources import colocated
from helpers import bags, column


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_changed_entities_are_opened(spark):
    rows = [(f"e{i}", f"p.{i}", {"n": i, "deep": {"x": [i, None]}}) for i in range(300)]
    base = bags(spark, "E", rows)
    changed = [(i, p, {**v, "n": -1} if i in ("e5", "e77") else v) for i, p, v in rows if i != "e9"] + [("new", "p", {"k": "v"})]
    newer = bags(spark, "E", changed)
    old, new = (digests.Digests(x, buckets=64) for x in (base, newer))
    assert shown(old.changed(new)) == [("e5",), ("e77",), ("e9",), ("new",)]
    assert old.unequal_buckets(new).count() <= 4
    assert shown(old.diff(new)) == shown(versions.diff(base, newer, ["id"]))
    assert old.diff(digests.Digests(base, buckets=64)).count() == 0
    assert digests.Digests(base.limit(0), buckets=64).diff(old).filter("change <> 'added'").count() == 0
    with pytest.raises(ValueError):
        old.changed(digests.Digests(base, buckets=8))


def test_the_envelope_can_count(spark):
    a, b = bags(spark, "E", [("1", "p", {"n": 1})]), bags(spark, "E", [("1", "q", {"n": 1})])
    assert digests.Digests(a).changed(digests.Digests(b)).count() == 0
    assert digests.Digests(a, envelope=True).changed(digests.Digests(b, envelope=True)).count() == 1


def test_profiles_merge(spark, tmp_path):
    rng = random.Random(1)
    cells = ["", " ", "1", "2.5", "x", "true", "2024-01-02", "0", None]
    make = lambda n, columns: spark.createDataFrame([[rng.choice(cells[(i * 7) % 9 :] + cells[:2]) for i, _ in enumerate(columns)] for _ in range(n)], ", ".join(f"{c} string" for c in columns))
    log = schemas.ProfileLog(spark, str(tmp_path / "states"))
    files = {"one": make(40, ["a", "b", "c"]).cache(), "two": make(30, ["A", "b", "d"]).cache(), "three": make(1, ["b", "e"]).cache()}
    for name, df in files.items():
        log.append(name, df, df.columns)
        log.append(name, df, df.columns)  # again: replaces its own
    every = ["a", "b", "c", "d", "e"]
    named = [df.select(*[F.col(c).alias(c.lower()) for c in df.columns]) for df in files.values()]
    whole = named[0].unionByName(named[1], True).unionByName(named[2], True).select(*every)
    assert shown(log.profile()) == shown(schemas.profile(whole, every))
    assert shown(schemas.inferred(log.profile())) == shown(schemas.infer(whole, every))


def test_pages_of_one_index(spark):
    rows = list(range(1000))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(x, x // 7) for x in rows], "v long, w long").repartition(5)
    order = [F.col("w").desc(), F.col("v").asc()]
    want = sorted(rows, key=lambda x: (-(x // 7), x))
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        index = ordinal.PageIndex(df, order)
    assert index.total == 1000 and len(index.ranges) > 1
    for limit, offset in ((10, 0), (10, 495), (10, 995), (400, 300), (1, 999), (5, 1000), (2000, 0)):
        page = index.page(limit, offset)
        assert column(page, "v") == want[offset : offset + limit]
        if limit == 10:
            assert len(page.inputFiles()) <= 2
    assert ordinal.PageIndex(df.limit(0), order).page(10).count() == 0


def test_a_table_by_id_stays_where_it_is(spark):
    store = bags(spark, "E", [(f"e{i}", None, {"n": i}) for i in range(200)])
    wanted = spark.createDataFrame([(n, f"e{n * n % 230}") for n in range(120)] + [(500, None)], "pos long, id string")
    table = colocated.save_by_id(store, buckets=3)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
        other = colocated.save_by_id(store, buckets=3)
        assert "Exchange" not in plan_of(table.read(spark).join(other.read(spark).select("id"), "id"))
        plan = plan_of(colocated.matching(table, wanted))
        # Exchanges are the request's alone: none between the join and the table's scan.
        assert "SelectedBucketsCount: 3 out of 3" in plan and "Exchange" not in plan[: plan.index("SelectedBucketsCount")]
    got = colocated.lookup(table, wanted).select("pos", "requested_id", "id").collect()
    assert got == listing.by_ids(store, wanted).select("pos", "requested_id", "id").collect() and len(got) == 121
