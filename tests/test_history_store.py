"""Late, repeated and reordered changes in batches give what one ordered batch gives; files follow the batches."""

import random

import pytest
from pyspark.sql import functions as F

from entityframe.operators import versions
from entityframe.streaming.state import LOST, HistoryStore
from helpers import bags

FIELDS = "seq long, op string, id string, v string, at long"


def changes(spark, rows):
    df = spark.createDataFrame(rows, FIELDS)
    return df.select(
        "seq", "op", "id", F.lit("org").alias("organization_id"), F.lit("s").alias("schema_id"), F.lit("U").alias("entity_type"),
        F.lit(None).cast("string").alias("path"), F.parse_json("v").alias("properties"), F.timestamp_seconds("at").alias("changed_at"), F.lit(None).cast("string").alias("reason"),
    )


def shown(df, *extra):
    key = "entity_id" if "entity_id" in df.columns else "id"
    cols = [key, "version", F.to_json("properties"), F.unix_timestamp("created_at"), F.unix_timestamp("updated_at"), *extra]
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def some_changes(n, seed):
    rng = random.Random(seed)
    ops = ["INSERT", "UPDATE", "UPSERT", "DELETE", "UPDATE", "UPSERT", "BOGUS"]
    return [(s, rng.choice(ops), rng.choice(["hot", "hot", *(f"e{i}" for i in range(12))]), f'{{"v":{s}}}', 10_000 + s) for s in range(1, n + 1)]


def start_of(spark):
    return bags(spark, "U", [(f"e{i}", None, {"v": -i}) for i in range(0, 12, 2)] + [("still", None, {"v": 0})])


def check(spark, store, rows, start):
    whole = versions.apply_changes(start, changes(spark, rows))
    assert shown(store.current()) == shown(whole.current)
    assert shown(store.history(), "change_type", "reason") == shown(whole.archived, "change_type", "reason")
    assert sorted(map(tuple, store.refused().select("seq", "id", "op", "reason").collect())) == sorted(map(tuple, whole.refused.collect()))


@pytest.mark.parametrize("late", [False, True])
def test_any_order_of_arrival(spark, tmp_path, late):
    rows, start = some_changes(90, 3), start_of(spark)
    arriving = list(rows)
    if late:
        random.Random(5).shuffle(arriving)
    store = HistoryStore(spark, str(tmp_path / "out"), fan=2)
    store.create(start, ranges=3)
    for n, at in enumerate(range(0, 90, 30)):
        repeated = arriving[max(0, at - 5) : at] if late else []
        store.apply(changes(spark, [*arriving[at : at + 30], *repeated, *arriving[at : at + 2]]), n)
    check(spark, store, rows, start)


def test_a_batch_runs_again_and_shows_whole_or_not_at_all(spark, tmp_path):
    rows, start = some_changes(40, 8), start_of(spark)
    store = HistoryStore(spark, str(tmp_path / "out"))
    store.create(start, ranges=4)
    store.apply(changes(spark, rows[:20]), 0)
    write, store._write_commit = store._write_commit, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.apply(changes(spark, rows[20:]), 1)
    check(spark, HistoryStore(spark, str(tmp_path / "out")), rows[:20], start)
    store._write_commit = write
    store.create(start)  # does nothing
    for _ in range(2):
        store.apply(changes(spark, rows[20:]), 1)
        check(spark, store, rows, start)
    store.apply(changes(spark, rows).limit(0), 2)
    check(spark, store, rows, start)


def test_writes_follow_the_batch_and_ranges_are_merged(spark, tmp_path):
    out = tmp_path / "out"
    start = bags(spark, "U", [(f"e{i}", None, {"v": i}) for i in range(400)])
    store = HistoryStore(spark, str(out), fan=2, share=0.5)
    store.create(start, ranges=4)
    for n in range(5):
        store.apply(changes(spark, [(n + 1, "UPDATE", f"e{i}", "{}", 9) for i in (n, n + 50)]), n)
    rows = lambda path: spark.read.parquet(str(path)).count()
    assert rows(out / "deltas/4-0") == 2 and rows(out / "base/-1") == 400
    assert [p.name for p in out.glob("base/*")] == ["-1"]
    commit = store._commit()
    assert [d["name"] for d in commit["deltas"]] == ["3-2", "4-0"] and sum(r[3] for r in commit["ranges"].values()) == 10
    store.apply(changes(spark, [(10 + i, "UPDATE", f"e{i}", "{}", 9) for i in range(300)]), 5)
    assert all(r[0] == 5 and r[3] == 0 for r in store._commit()["ranges"].values())
    before = shown(store.current())
    store.vacuum(keep_log_from=3)
    assert sorted(p.name for p in out.glob("base/*/range=*")) == sorted(f"range={b}" for b in range(4)) and not list(out.glob("deltas/*"))
    assert [p.name for p in out.glob("commits/*")] == ["5"]
    assert shown(store.current()) == before and len(before) == 400
    # The log of e0's first change is gone: a late change of it is refused, one of e60 is not.
    store.apply(changes(spark, [(0, "DELETE", "e0", "{}", 9), (0, "UPDATE", "e60", "{}", 9)]), 6)
    assert [tuple(r) for r in store.refused().collect()] == [(0, "e0", "DELETE", LOST)]
    assert {r[0]: r[1] for r in shown(store.current())}["e60"] == 3


def test_only_the_touched_ranges_are_read(spark, tmp_path):
    start = bags(spark, "U", [(f"e{i}", None, {"v": i}) for i in range(50)])
    store = HistoryStore(spark, str(tmp_path / "out"))
    store.create(start, ranges=8)
    files = store._state(store._commit(), [2, 5]).inputFiles()
    assert {f.split("range=")[1][0] for f in files} <= {"2", "5"}


@pytest.mark.parametrize("longest", [25, 60])
def test_only_long_chains_are_cut(spark, monkeypatch, longest):
    """However far apart the numbers lie, entities with few changes stay out of the slices."""
    monkeypatch.setattr(versions.ordinal, "ROWS_PER_CHUNK", longest)
    cut, in_slices = [], versions._long_chains
    monkeypatch.setattr(versions, "_long_chains", lambda rows, sliced: cut.append({r["id"] for r in rows.select("id").distinct().collect()}) or in_slices(rows, sliced))
    rows = [(s * 100_000, op, "hot" if s % 2 else i, v, at) for s, op, i, v, at in some_changes(90, 4)]
    start = start_of(spark)
    got = versions.apply_changes(start, changes(spark, rows))
    assert cut == ([{"hot"}] if longest == 25 else [])
    want = versions.apply_changes(start, changes(spark, rows), rows_per_chunk=10**12)
    assert len(cut) == (longest == 25)
    assert shown(got.current) == shown(want.current)
    assert shown(got.archived, "change_type", "reason") == shown(want.archived, "change_type", "reason")
    assert sorted(map(tuple, got.refused.collect())) == sorted(map(tuple, want.refused.collect()))
