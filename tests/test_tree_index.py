"""Descendants by pre-order numbers against path comparison, and the closure of links against a walk."""

import collections
import random

import pytest

from entityframe import EntitySchema, Field
from entityframe.operators import links, tree
from helpers import bags, store, typed


def below(path, of):
    return path == of or path.startswith(of + ".")


@pytest.mark.parametrize("span", [2, 1024])
def test_descendants_of_any_tree(spark, monkeypatch, span):
    monkeypatch.setattr(tree, "SPAN", span)
    rng = random.Random(7)
    labels = ["a", "b-c", "a b", "B", "10", "2", "é", "a!"]
    paths = {"a"}
    for _ in range(120):
        paths.add(".".join([*rng.choice(sorted(paths)).split("."), rng.choice(labels)][:9]))
    paths |= {"x.y.z", "x.y.w.v", ""}  # x, x.y and x.y.w are no entities
    rows = [(f"e{n}", p, {}) for n, p in enumerate(sorted(paths))] + [("twin", "a", {}), ("none", None, {})]
    nodes = bags(spark, "N", rows)
    anchors = bags(spark, "N", [*rows[:60:2], ("twin", "a", {}), ("between", "x.y", {}), ("gone", "q", {}), ("none", None, {})])
    got = sorted((r.anchor_id, r.id) for r in tree.descendants(nodes, anchors).select("anchor_id", "id").collect())
    asked = [(i, p) for i, p, _ in [*rows[:60:2], ("twin", "a", {}), ("between", "x.y", {})]]
    assert got == sorted((a, i) for a, at in asked for i, p, _ in rows if p is not None and below(p, at))
    sizes = {r.path: r.n_below for r in tree.TreeIndex(nodes).sizes().collect()}
    assert sizes == {p: sum(below(q, p) and q != p for q in paths) for p in paths}


def test_organizations_have_trees_of_their_own(spark):
    rows = [("1", "a", {}), ("2", "a.b", {})]
    nodes = bags(spark, "N", rows, "one").unionByName(bags(spark, "N", [("3", "a.b", {}), ("4", "a.b.c", {})], "two"))
    got = {(r.anchor_id, r.id) for r in tree.descendants(nodes, nodes).collect()}
    assert got == {("1", "1"), ("1", "2"), ("2", "2"), ("3", "3"), ("3", "4"), ("4", "4")}


def test_an_index_answers_without_opening_paths(spark):
    nodes = bags(spark, "N", [("1", "a", {}), ("2", "a.b", {})])
    plan = tree.TreeIndex(nodes).descendants(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert tree.descendants(nodes.limit(0), nodes).count() == 0


def test_closure_is_the_shortest_distance(spark):
    rng = random.Random(2)
    n = 60
    links_of = {f"n:{i}": [f"n:{rng.randrange(n)}" for _ in range((i < 2) + rng.choice([0, 1, 2]))] for i in range(n)}
    starts = ["n:0", "n:1"]
    shape = EntitySchema("Start", (Field("to", "ENTITY_REFERENCE_ARRAY"),)), EntitySchema("Other", (Field("to", "ENTITY_REFERENCE_ARRAY"),))
    frames = {s.name: typed(spark, s.name, "to array<string>", [(i, t) for i, t in links_of.items() if (i in starts) == (s.name == "Start")]) for s in shape}
    s = store(frames, shape)
    distance, queue = {i: 1 for i in starts}, collections.deque(starts)
    while queue:
        at = queue.popleft()
        for to in links_of[at]:
            if to not in distance:
                distance[to] = distance[at] + 1
                queue.append(to)
    want = sorted((p, c, distance[p]) for p in distance for c in set(links_of[p]))
    norm = lambda c: c
    got = sorted(tuple(r) for r in links.closure(s, ["Start"], id_norm=norm).select("parent_id", "child_id", "hop").collect())
    assert got == want and max(distance.values()) > 3
    near = links.closure(s, ["Start"], max_hops=2, id_norm=norm).select("parent_id", "child_id", "hop").collect()
    assert sorted(map(tuple, near)) == [x for x in want if x[2] <= 2]
