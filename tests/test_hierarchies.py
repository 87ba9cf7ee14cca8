"""The full hierarchy of many anchors."""

import collections

import pytest
from pyspark.sql import functions as F

from helpers import bags

from entityframe.operators import ordinal, tree

PATHS = ["1", "1.1", "1.2", "1.1.A", "10", "1.10"]


def test_hierarchies_agree_with_one_anchor(spark):
    nodes = bags(spark, "Node", [(f"n{p}", p, {}) for p in PATHS])
    found = tree.hierarchies(nodes, nodes)
    got = sorted((r.anchor_path, r.path, r.relation) for r in found.collect())
    assert got == sorted((p, r.path, r.relation) for p in PATHS for r in tree.hierarchy_of(nodes, p).collect())
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_a_crowded_parent_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tree, "CELL", 8, raising=False)
    monkeypatch.setattr(tree, "PAIRS_PER_TASK", 500, raising=False)
    rows = [("up", "1", {}), ("none", None, {}), ("twin", "1.7", {}), *((f"n{i}", f"1.{i}", {}) for i in range(90))]
    nodes = bags(spark, "Node", rows)
    found = tree.siblings(nodes, nodes).withColumn("task", F.spark_partition_id()).select("anchor_id", "id", "task").collect()
    below = [(i, p) for i, p, _ in rows if p and "." in p]
    assert sorted((r.anchor_id, r.id) for r in found) == sorted((a, i) for a, at in below for i, p in below if p != at)
    per_task = collections.Counter(r.task for r in found)
    assert len(per_task) > 8 and max(per_task.values()) < len(found) / 4
    assert tree.siblings(nodes, nodes.limit(0)).count() == 0


@pytest.mark.parametrize("top", [1, 2_000])
def test_pages_by_path_make_each_key_once(spark, monkeypatch, top):
    if top == 1:
        monkeypatch.setattr(ordinal, "TOP_ROWS", 1)
    every = [f"{n % 7}.{n}" for n in range(2000)] + ["3", "3"]
    df = spark.createDataFrame([(p,) for p in every] + [(None,)], "path string")
    found = tree.page_by_path(df, 300, 1200)
    want = sorted(every, key=lambda p: [int(x) for x in p.split(".")])
    assert [r.path for r in found.collect()] == [None, *want][1200:1500]
    plan = found._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line or "TakeOrdered" in line]
    assert sorts and not any("split(" in line for line in sorts)
    # A page that ends within the first rows sorts no whole table.
    assert top == 1 or ("TakeOrdered" in plan and "rangepartitioning" not in plan)
