import json

import pytest
from pyspark.sql import functions as F

from entityframe import EntitySchema, EntityStore, Field, PropertyFilter
from entityframe.functions import coerce, paths, values
from entityframe.functions.props import Bag
from entityframe.operators import links, listing, ordinal, predicates, schemas, tree, validation, versions
from entityframe.operators.joins import CartesianError, JoinSort, SavedJoin, check_definition, run_saved_join
from entityframe.operators.listing import Listing
from helpers import bags, column, store, typed

U = [f"{n}{n}{n}{n}{n}{n}{n}{n}-1111-4111-8111-111111111111" for n in "123456"]


# --- distributed numbering ----------------------------------------------------------------------


def test_positions_and_deep_pages(spark, monkeypatch):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"), F.lit("x").alias("same"))
    order = [F.col("same").asc(), F.col("v").asc()]
    assert ordinal.positions(df, order).filter("pos <> v").count() == 0
    monkeypatch.setattr(ordinal, "TOP_ROWS", 10)
    assert column(ordinal.page(df, order, 7, 4000), "v") == list(range(4000, 4007))
    assert column(ordinal.page(df, order, None, 4990), "v") == list(range(4990, 5000))
    assert column(ordinal.page(df, order, 3, 9000), "v") == []


@pytest.mark.parametrize("chunked", ["cut", "given", "whole"])
def test_rank_of_a_hot_group(spark, chunked):
    """Two thirds of the rows share one key; small slices must give the plain row numbers."""
    df = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(99).alias("k"),
        F.timestamp_seconds(F.col("id") % 200).alias("at"),
        F.col("id").alias("n"),
    )
    df = df.unionByName(df.withColumn("k", F.lit(None).cast("bigint")))
    chunk = F.floor(F.unix_seconds("at") / 13) if chunked == "given" else None
    rows = 25 if chunked == "cut" else ordinal.ROWS_PER_CHUNK
    got = ordinal.rank_in_group(df, ["k"], ["at", "n"], "r", chunk, rows)
    want = ordinal.rank_in_group(df, ["k"], ["at", "n"], "r")
    assert got.count() == 1200
    assert got.exceptAll(want.select(*got.columns)).count() == 0


# --- paths and trees ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("a", "1"), ("b", "1.1"), ("c", "1.2"), ("d", "1.1.A"), ("e", "10"), ("f", "1.10")]
    return bags(spark, "Node", [(i, p, {}) for i, p in rows])


def test_one_anchor(nodes):
    assert column(tree.ancestors_of(nodes, "1.1.A"), "path") == ["1", "1.1"]
    assert sorted(column(tree.children_of(nodes, "1"), "path")) == ["1.1", "1.10", "1.2"]
    assert sorted(column(tree.descendants_of(nodes, "1.1"), "path")) == ["1.1", "1.1.A"]
    assert sorted(column(tree.siblings_of(nodes, "1.1"), "path")) == ["1.10", "1.2"]
    assert column(tree.siblings_of(nodes, "1"), "path") == ["10"]
    relations = {r["path"]: r["relation"] for r in tree.hierarchy_of(nodes, "1.1").collect()}
    assert relations == {"1.1": "current", "1": "ancestor", "1.1.A": "child", "1.2": "sibling", "1.10": "sibling"}


def test_many_anchors_agree_with_one(nodes):
    for many, one in ((tree.ancestors, tree.ancestors_of), (tree.descendants, tree.descendants_of), (tree.children, tree.children_of), (tree.siblings, tree.siblings_of)):
        got = {}
        for r in many(nodes, nodes).select("anchor_path", "path").collect():
            got.setdefault(r[0], set()).add(r[1])
        for p in ("1", "1.1", "1.2", "1.1.A", "10", "1.10"):
            assert got.get(p, set()) == set(column(one(nodes, p), "path")), (many.__name__, p)


def test_tree_joins_are_equi_joins(nodes):
    for many in (tree.ancestors, tree.descendants, tree.children, tree.siblings):
        plan = many(nodes, nodes)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_path_functions(spark):
    df = spark.createDataFrame([("1.2.10",), ("1",), ("",), ("1..2",), ("a.b",)], "p string")
    p = F.col("p")
    got = {r[0]: tuple(r)[1:] for r in df.select("p", paths.depth(p), paths.parent(p), paths.is_valid(p), paths.is_valid(p, False)).collect()}
    assert got == {
        "1.2.10": (3, "1.2", True, True),
        "1": (1, "", True, True),
        "": (0, "", False, False),
        "1..2": (3, "1.", False, False),
        "a.b": (2, "a", False, True),
    }
    numeric = df.filter(paths.is_valid(p) | (p == "")).select("p", paths.next_sibling(p))
    assert dict(map(tuple, numeric.collect())) == {"1.2.10": "1.2.11", "1": "2", "": "1"}
    order = spark.createDataFrame([("1.10",), ("1.9",), ("1",), ("1.9.1",)], "p string").orderBy(paths.order_key(p))
    assert column(order, "p") == ["1", "1.9", "1.9.1", "1.10"]


def test_generate_and_next_paths(spark):
    df = spark.createDataFrame([("", 5), ("1", 2), ("1", 9), ("", 7)], "up string, n int")
    out = tree.generate_paths(df, "up", ["n"], "path", F.floor(F.col("n") / 3))
    assert sorted(column(out, "path")) == ["1", "1.1", "1.2", "2"]
    found = bags(spark, "N", [("a", "1.1", {}), ("b", "1.9", {}), ("c", "4", {})])
    assert sorted(column(tree.next_paths(found), "next_path")) == ["1.10", "5"]


# --- values and predicates ----------------------------------------------------------------------


def test_value_text(spark):
    bag = '{"i": 1000000, "d": 2.5, "e": 1e6, "t": true, "n": null, "o": {"a": [1, 2]}, "s": "2.0", "big": 12345678.9, "a.b": 3}'
    b = Bag.of(bags(spark, "T", [("x", None, json.loads(bag))]))
    df = bags(spark, "T", [("x", None, json.loads(bag))])
    keys = ["i", "d", "e", "t", "n", "o", "s", "big", "gone", "a.b"]
    got = df.select(*[b.text(k) for k in keys]).first()
    assert list(got) == ["1000000", "2.5", "1000000", "true", None, '{"a":[1,2]}', "2.0", "12345678.9", None, "3"]
    doubles = spark.createDataFrame([(2.0,), (1e7,), (0.1,), (12345678.9,), (-3.0,), (0.00001,)], "d double")
    assert column(doubles, values.double_text(F.col("d"))) == ["2", "10000000", "0.1", "12345678.9", "-3", "0.00001"]
    times = spark.sql("SELECT timestamp'2024-03-02 16:25:04.5Z' AS t UNION ALL SELECT timestamp'2024-03-02 00:00:00Z'")
    assert sorted(column(times, values.time_text(F.col("t")))) == ["2024-03-02T00:00:00Z", "2024-03-02T16:25:04.5Z"]


def test_uuid_forms(spark):
    good = "6BA7B810-9DAD-11D1-80B4-00C04FD430C8"
    texts = [good, "{" + good + "}", "urn:uuid:" + good, good.replace("-", ""), "nope", "", "{" + good]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert column(df, values.uuid_norm(F.col("t"))) == [good.lower()] * 4 + [None] * 3


def test_containment(spark):
    df = bags(spark, "T", [("x", None, {"v": 2.5, "s": "2.5", "o": {"a": 1, "b": [1, {"c": 2}]}, "l": ["p", "q"], "n": None, "t": True})])
    hits = [{"v": 2.5}, {"s": "2.5"}, {"o": {"a": 1}}, {"o": {"b": [{"c": 2}]}}, {"l": ["q"]}, {"l": []}, {"n": None}, {"t": True, "v": 2.5}, {}]
    misses = [{"v": "2.5"}, {"s": 2.5}, {"o": {"a": 2}}, {"l": ["z"]}, {"l": "p"}, {"gone": None}, {"t": False}, {"o": {"b": [3]}}]
    for wanted in hits:
        assert df.filter(predicates.contains_json(Bag.of(df), wanted)).count() == 1, wanted
    for wanted in misses:
        assert df.filter(predicates.contains_json(Bag.of(df), wanted)).count() == 0, wanted


def test_searches(spark):
    df = bags(spark, "T", [("a", None, {"n": 5}), ("b", None, {"n": "5"}), ("c", None, {"n": 10.0}), ("d", None, {"t": "ÉCOLE Rouge"}), ("e", None, {"n": None})])
    assert sorted(column(listing.search_range(df, "n", 5, 10), "id")) == ["a", "c"]
    assert sorted(column(listing.search_range(df, "n"), "id")) == ["a", "c"]
    assert sorted(column(listing.search_exists(df, "n"), "id")) == ["a", "b", "c", "e"]
    assert column(listing.search_contains(df, "t", "cole ROUGE"), "id") == ["d"]
    assert column(listing.search_contains(df, "t", "école"), "id") == []  # only ASCII letters fold
    assert column(listing.search_contains(df, "t", ""), "id") == []


def test_listing(spark):
    rows = [("a", "x.1", {"p": " beta "}), ("b", "x.2", {"p": "Alpha"}), ("c", None, {"p": ""}), ("d", None, {"q": "50%"})]
    df = bags(spark, "T", rows)
    by_p = listing.list_entities(df, Listing(sort="property", sort_property="p", direction="asc"), None)
    assert column(by_p, "id") == ["b", "a", "c", "d"]
    assert column(listing.list_entities(df, Listing()), "id") == ["a", "b", "c", "d"]
    assert column(listing.matching(df, Listing(text="ALPH")), "id") == ["b"]
    assert sorted(column(listing.matching(df, Listing(text="x.")), "id")) == ["a", "b"]
    assert sorted(column(listing.matching(df, Listing(filters=(PropertyFilter("p"),))), "id")) == ["a", "b", "c"]
    assert column(listing.matching(df, Listing(filters=(PropertyFilter("p", "a_pha"),))), "id") == ["b"]
    assert listing.matching(df, Listing(organization="other")).count() == 0
    assert listing.matching(df, Listing(entity_type="None")).count() == 0


def test_lookups(spark):
    thing = EntitySchema("T", (Field("code", "REFERENCE"),))
    df = bags(spark, "T", [("a", None, {"code": "k1"}), ("b", None, {"code": "k2"}), ("c", None, {})])
    wanted = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "a"), (3, "b")], "pos int, id string")
    assert [tuple(r) for r in listing.by_ids(df, wanted).select("requested_id", "id").collect()] == [("b", "b"), ("zz", None), ("a", "a"), ("b", "b")]
    refs = spark.createDataFrame([(" k1 ",), ("k1",), ("",), (None,)], "reference string")
    assert column(listing.by_references(df, thing, refs), "id") == ["a"]
    assert sorted(column(df, listing.reference_value(df, thing))) == ["c", "k1", "k2"]
    twice = df.unionByName(bags(spark, "T", [("n", None, {"code": " k2"})]))
    assert [tuple(r) for r in listing.reference_duplicates(twice, thing).select("reference", "uses", "first_id").collect()] == [("k2", 2, "b")]
    new = bags(spark, "T", [("n", None, {"code": " k2"}), ("b", None, {"code": "k2"}), ("o", None, {"code": "k9"})])
    assert column(listing.reference_conflicts(new, df, thing), "id") == ["n"]


# --- saved joins --------------------------------------------------------------------------------

COMPONENT = EntitySchema("Component", (Field("name"), Field("owner", "ENTITY_REFERENCE", True, "Team")))


def test_saved_reference_join(spark):
    teams = bags(spark, "Team", [(U[0], "teams.atlas", {"name": "Atlas"})])
    parts = bags(spark, "Component", [("c1", "components.falcon", {"name": "Falcon", "owner": U[0]}), ("c2", None, {"name": "x"})])
    st = store({"Team": teams, "Component": parts}, [COMPONENT])
    join = SavedJoin("Component", "Team", "REFERENCE", "owner")
    result = run_saved_join(st, join)
    assert [tuple(r) for r in result.edges.select("l.id", "r.id").collect()] == [("c1", U[0])]
    assert result.total.first()[0] == 1
    blank = run_saved_join(st, join, left_filters=(PropertyFilter("name", ""),))
    assert blank.edges.count() == 0
    for bad in (SavedJoin("Component", "Other", "REFERENCE", "owner"), SavedJoin("Component", "Team", "REFERENCE", "name"), SavedJoin("Component", "Team")):
        with pytest.raises(ValueError):
            check_definition(bad, COMPONENT)


def test_saved_cross_join(spark):
    st = store({t: typed(spark, t, "name string", [(f"{t}{i}", f"{t}{i % 2}") for i in range(n)]) for t, n in (("A", 5), ("B", 4))})
    cross = SavedJoin("A", "B", "CROSS")
    assert run_saved_join(st, cross).edges.count() == 20
    assert run_saved_join(st, cross).total.first()[0] == 20
    sorts = {
        "none": (),
        "one": (JoinSort("RIGHT", "name", "DESC"),),
        "left": (JoinSort("LEFT", "name", "DESC"), JoinSort("RIGHT", "id", "DESC")),
        "right": (JoinSort("RIGHT", "name"), JoinSort("LEFT", "name")),
        "mixed": (JoinSort("LEFT", "name"), JoinSort("RIGHT", "name"), JoinSort("LEFT", "id")),
    }
    for kind, criteria in sorts.items():
        whole = run_saved_join(st, cross, sorts=criteria, limit=None, allow_cartesian=True).edges.select("l.id", "r.id").collect()
        if kind == "mixed":
            with pytest.raises(CartesianError):
                run_saved_join(st, cross, sorts=criteria)
            continue
        assert len(whole) == 20
        for offset in (0, 7, 17):
            page = run_saved_join(st, cross, sorts=criteria, limit=6, offset=offset).edges.select("l.id", "r.id").collect()
            assert page == whole[offset : offset + 6], (kind, offset)


# --- links --------------------------------------------------------------------------------------


def test_service_graph(spark):
    team = EntitySchema("Team", (Field("name"), Field("code", "REFERENCE")))
    service = EntitySchema(
        "Service",
        (Field("code", "REFERENCE"), Field("dependencies", "ENTITY_REFERENCE_ARRAY", False, "Service"), Field("owner", "ENTITY_REFERENCE", False, "Team"), Field("support", "ENTITY_REFERENCE", False, "Team")),
    )
    teams = bags(spark, "Team", [(U[0], None, {"name": "T", "code": "TEAM-001"})])
    rows = [
        (U[1], None, {"code": "SVC-001", "owner": U[0], "support": "TEAM-001"}),
        (U[2], None, {"code": "SVC-002", "owner": U[0].upper(), "dependencies": [U[1], "SVC-001", U[4]]}),
    ]
    st = store({"Team": teams, "Service": bags(spark, "Service", rows)}, [team, service])
    table = links.all_links(st, ["Service"])
    got = {r["parent_id"]: r["children"] for r in links.children_lists(links.edges(table, st)).collect()}
    assert got == {U[1]: [U[0]], U[2]: sorted([U[0], U[1]])}
    assert [tuple(r) for r in links.dangling(table, st).select("parent_id", "by", "key").collect()] == [(U[2], "id", U[4])]
    hops = links.enrich(st, ["Service"], hops=2).filter("hop = 2").select("parent_id", "child_id").collect()
    assert [tuple(r) for r in hops] == [(U[1], U[0])]


def test_undeclared_links(spark):
    schema = EntitySchema("Component", (Field("name"),))
    rows = [("a", None, {"name": U[1]}), ("b", None, {"name": "B", "linked_ids": [U[0], "  ", 7, "txt"]})]
    table = links.link_table(bags(spark, "Component", rows), schema)
    assert sorted(map(tuple, table.select("parent_id", "by", "target_type", "key").collect())) == [
        ("a", "id", "", U[1]),
        ("b", "id", "Component", U[0]),
        ("b", "reference", "Component", "txt"),
    ]


def test_merge_links(spark):
    df = typed(spark, "C", "linked_entity_id string, linked_ids array<string>", [("a", None, [U[0]])])
    single = EntitySchema("C", (Field("linked_entity_id", "ENTITY_REFERENCE"), Field("linked_ids", "ENTITY_REFERENCE_ARRAY")))
    both = links.merge_links(df, EntitySchema("C", (Field("linkedIds", "JSON"),)), F.array(F.lit(U[1]), F.lit(" "), F.lit(U[0])))
    assert both.select("properties.linkedIds", "properties.linked_ids").first()[1] == [U[0], U[1]]
    two = links.merge_links(df, EntitySchema("C", (single.fields[0],)), F.array(F.lit(U[1]), F.lit(U[2])))
    assert "single reference" in two.first()["link_error"] and two.select("properties.linked_ids").first()[0] == [U[0]]
    one = links.merge_links(df, EntitySchema("C", (single.fields[0],)), F.array(F.lit(U[1])))
    assert tuple(one.select("properties.linked_entity_id", "link_error").first()) == (U[1], None)
    bad = links.merge_links(df, EntitySchema("C", (single.fields[0],)), F.array(F.lit("x")))
    assert "UUIDs" in bad.first()["link_error"]


# --- validation and schemas ---------------------------------------------------------------------


def test_validation_messages(spark):
    schema = EntitySchema(
        "T",
        (
            Field("name", "STRING", True),
            Field("n", "INTEGER", validation='{"min": 3, "max": 5}'),
            Field("f", "FLOAT"),
            Field("at", "TIMESTAMP"),
            Field("geo", "GEOMETRY"),
            Field("ts", "TIMESERIES"),
            Field("ref", "REFERENCE"),
            Field("one", "ENTITY_REFERENCE"),
            Field("many", "ENTITY_REFERENCE_ARRAY"),
            Field("flag", "BOOLEAN"),
        ),
    )
    good = {
        "name": "x", "n": 4, "f": "1.5", "at": "2024-01-02T03:04:05Z", "geo": {"type": "Point"}, "flag": True,
        "ts": [{"timestamp": 1, "value": 2}], "ref": "r", "one": U[0], "many": [U[0], U[1]],
    }
    bad = {
        "n": 2.5, "f": "x", "at": "2024-01-02", "geo": {"kind": 1}, "ts": [{"value": 2}], "ref": " ", "one": "x",
        "many": [U[0], 7], "flag": "true", "extra": 1, "another": 2,
    }
    out = {r["id"]: r for r in validation.validate(bags(spark, "T", [("g", None, good), ("b", None, bad)]), schema).collect()}
    assert out["g"]["is_valid"] and out["g"]["errors"] == [] and out["g"]["warnings"] == []
    assert out["b"]["errors"] == [
        "name: required field 'name' is missing",
        "n: field 'n' must be an integer, got float64",
        "f: field 'f' must be a float, got string",
        "at: field 'at' must be a valid timestamp (RFC3339)",
        "geo: field 'geo' must be a valid geometry, got map[string]interface {}",
        "ts: field 'ts' must be a valid timeseries, got []interface {}",
        "ref: field 'ref' must be a non-empty reference string",
        "one: field 'one' must be a valid UUID string",
        "many: field 'many' reference values must be strings, got float64",
        "flag: field 'flag' must be a boolean, got string",
        "another: property 'another' is not defined in schema",
        "extra: property 'extra' is not defined in schema",
    ]
    assert out["b"]["warnings"] == ["n: field 'n' value 2.5 is less than minimum 3"]


def test_field_rules():
    with pytest.raises(ValueError):
        EntitySchema("T", (Field("a", "STRING", False, "Other"),)).check()
    with pytest.raises(ValueError):
        Field("a", "ENTITY_ID")
    with pytest.raises(ValueError):
        EntitySchema("T", (Field("a"), Field("A"))).check()
    assert EntitySchema("T", (Field("x"), Field("r1", "reference"), Field("r2", "REFERENCE"))).canonical_reference == "r1"


def test_schema_versions():
    base = (Field("name", "STRING", True), Field("size", "INTEGER"))
    cases = [
        ((*base, Field("extra")), "MINOR"),
        ((*base, Field("extra", "STRING", True)), "MAJOR"),
        (base[:1], "MAJOR"),
        ((base[0], Field("size", "FLOAT")), "MAJOR"),
        ((base[0], Field("SIZE", "integer")), "PATCH"),
        ((base[0], Field("size", "INTEGER", True)), "MAJOR"),
        ((Field("name"), base[1]), "MINOR"),
    ]
    for new, level in cases:
        assert schemas.compatibility(base, new) == level
    assert schemas.bump("1.0.0", "MINOR") == "1.1.0" and schemas.bump("1.1.0", "MAJOR") == "2.0.0" and schemas.bump("", "PATCH") == "1.0.1"
    with pytest.raises(ValueError):
        schemas.bump("1.x", "MINOR")


def test_registry(spark):
    rows = [("org", "1", "A", "1.0.0", "ACTIVE", 1), ("org", "2", "A", "1.1.0", "ARCHIVED", 2), ("org", "3", "B", "1.0.0", "ACTIVE", 3)]
    reg = spark.createDataFrame(rows, "organization_id string, id string, name string, version string, status string, created_at int")
    assert sorted(column(schemas.latest(reg), "id")) == ["1", "3"]
    assert column(schemas.versions_of(schemas.archive(reg, "1"), "A"), "status") == ["ARCHIVED", "ARCHIVED"]
    new = spark.createDataFrame([("org", "4", "A", "2.0.0", "ACTIVE", 4)], reg.schema)
    after = schemas.publish(reg, new)
    assert sorted(column(after.filter("status = 'ACTIVE'"), "id")) == ["3", "4"]
    assert schemas.exists(reg, "B").first()[0] and not schemas.exists(reg, "Z").first()[0]
    assert column(schemas.version_of(reg, "A", "1.1.0"), "id") == ["2"] and column(schemas.by_id(reg, "3"), "name") == ["B"]


# --- versions -----------------------------------------------------------------------------------

USER = "name string, n int"


def test_update_delete_rollback(spark):
    current = typed(spark, "U", USER, [("a", "one", 1), ("b", "keep", 2)])
    fields = "seq int, op string, id string, name string, n int, changed_at timestamp, reason string"

    def changes(rows):
        df = spark.createDataFrame([(*r, None, None) for r in rows], fields)
        df = df.withColumn("changed_at", F.timestamp_seconds(F.col("seq")))
        return df.select(
            "seq", "op", "id", F.lit("org").alias("organization_id"), F.lit("s").alias("schema_id"), F.lit("U").alias("entity_type"),
            F.lit(None).cast("string").alias("path"), F.struct("name", "n").alias("properties"), "changed_at", "reason",
        )

    done = versions.apply_changes(current, changes([(1, "update", "a", "two", 2), (2, "update", "a", "three", 3), (3, "delete", "b", None, None), (4, "insert", "c", "new", 0)]))
    live = {r["id"]: (r["version"], r["name"]) for r in done.current.select("id", "version", "properties.name").collect()}
    assert live == {"a": (3, "three"), "c": (1, "new")}
    history = done.archived
    past = sorted(map(tuple, history.select("entity_id", "version", "change_type", "properties.name").collect()))
    assert past == [("a", 1, "UPDATE", "one"), ("a", 2, "UPDATE", "two"), ("b", 1, "DELETE", "keep")]

    asked = spark.createDataFrame([(1, "a", 1, " oops "), (2, "b", 1, ""), (3, "c", 9, "")], "seq int, id string, to_version long, reason string")
    back = versions.rollback(done.current, history, asked.withColumn("changed_at", F.timestamp_seconds(F.lit(99))))
    live = {r["id"]: (r["version"], r["name"]) for r in back.current.select("id", "version", "properties.name").collect()}
    assert live == {"a": (4, "one"), "b": (2, "keep"), "c": (1, "new")}
    kept = back.archived.select("entity_id", "version", "change_type", "reason").collect()
    assert [tuple(r) for r in kept] == [("a", 3, "ROLLBACK", "ROLLBACK: oops")]
    every = history.unionByName(back.archived)
    assert every.groupBy("entity_id", "version").count().filter("count > 1").count() == 0
    listed = versions.history_list(back.current, every).filter("entity_id = 'a'")
    assert column(listed, "version") == [4, 3, 2, 1]
    wanted = spark.createDataFrame([("a", 2), ("a", 4), ("a", 7)], "entity_id string, version long")
    assert sorted(column(versions.versions_at(back.current, every, wanted), "version")) == [2, 4]
    restored = back.current.filter("id = 'b'").select("created_at").first()[0]
    assert restored == current.filter("id = 'b'").select("created_at").first()[0]


def test_canonical_lines_and_diff(spark):
    bag = {"name": "base", "metadata": {"color": "red", "size": 10}, "tags": ["alpha", "beta"]}
    df = bags(spark, "T", [("x", "root.node", bag), ("y", None, {})]).withColumn("schema_id", F.lit("s-1"))
    lines = {r[0]: r[1] for r in df.select("id", versions.canonical_lines(df)).collect()}
    assert lines["x"] == [
        "Path: root.node", "SchemaID: s-1", "EntityType: T", "Version: 1", "Properties:",
        '  metadata.color: "red"', "  metadata.size: 10", '  name: "base"', '  tags[0]: "alpha"', '  tags[1]: "beta"',
    ]
    assert lines["y"][-1] == "  (empty)"
    base = bags(spark, "T", [("x", None, {"name": "Base", "metadata": {"color": "red"}, "gone": None})])
    target = bags(spark, "T", [("x", None, {"name": "Target", "metadata": {"color": "blue"}, "count": 2})])
    got = sorted(map(tuple, versions.diff(base, target, ["id"]).select("key", "old_value", "new_value", "change").collect()))
    assert got == [("count", None, "2", "added"), ("gone", "null", None, "removed"), ("metadata.color", '"red"', '"blue"', "changed"), ("name", '"Base"', '"Target"', "changed")]


def leaves(value, key=""):
    if isinstance(value, dict) and value:
        return {k2: v2 for k, v in value.items() for k2, v2 in leaves(v, f"{key}.{k}" if key else k).items()}
    if isinstance(value, list) and value:
        return {k2: v2 for i, v in enumerate(value) for k2, v2 in leaves(v, f"{key}[{i}]").items()}
    return {key: json.dumps(value, separators=(",", ":"), ensure_ascii=False)} if key else {}


def test_flatten_any_depth(spark):
    deep = {"a": 1}
    for n in range(12):
        deep = {"d": deep, "l": [n, [deep, "x\"{[", {}], []]}  if n < 4 else {"d": deep}
    cases = [deep, {}, {"a": {}, "b": [], "c": None}, {"q": "tab\t\"quote\" \\ {[<"}, {"m": [1, {"k": [[["z"]]]}, "s", True]}]
    df = bags(spark, "T", [(str(i), None, c) for i, c in enumerate(cases)])
    got = {}
    for r in versions.flatten(df, "id").collect():
        got.setdefault(int(r["id"]), {})[r["key"]] = r["value"]
    for i, c in enumerate(cases):
        assert got.get(i, {}) == leaves(c), i


def test_typed_flatten(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', 2.5D, 'd', cast(null as string)), 'l', array('x', null), 'e', array()) AS properties")
    got = dict(df.select(F.explode(Bag.of(df).leaves()).alias("x")).select("x.*").collect())
    assert got == {"a": "1", "b.c": "2.5", "l[0]": '"x"', "l[1]": "null", "e": "[]"}


def test_type_tests(spark):
    texts = ["1", "0", "+7", "1e3", "2.5", ".5", "5.", "1d", "0x10", "inf", "NaN", "yes", "T", "y", "2024-03-02", "2024-03-02 16:25:04.594", "2024-03-02 5:04:05",
             "2024-3-2", "2024/03/02", "13/02/2024", "02/13/2024", "99/99/2024", "2024-03-02T10:00:00+02:00", "2024-03-02T10:00:00", "1e999", "99999999999999999999", "abc"]
    c = F.col("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", coerce.kinds(c)).collect()}
    b, i, f, s = coerce.IS_BOOL, coerce.IS_INT, coerce.IS_FLOAT, coerce.IS_TIMESTAMP
    assert got == {
        "1": b | i | f, "0": b | i | f, "+7": i | f, "1e3": i | f, "2.5": f, ".5": f, "5.": i | f, "1d": 0, "0x10": 0, "inf": f, "NaN": f,
        "yes": b, "T": b, "y": 0, "2024-03-02": s, "2024-03-02 16:25:04.594": s, "2024-03-02 5:04:05": s, "2024-3-2": 0, "2024/03/02": s,
        "13/02/2024": s, "02/13/2024": s, "99/99/2024": 0, "2024-03-02T10:00:00+02:00": s, "2024-03-02T10:00:00": 0, "1e999": 0,
        "99999999999999999999": i | f, "abc": 0,
    }
    days = dict(df.select("t", F.date_format(coerce.to_timestamp(c), "yyyy-MM-dd HH:mm:ss.SSS")).collect())
    assert days["13/02/2024"] == days["02/13/2024"] == "2024-02-13 00:00:00.000"
    assert days["2024-03-02 16:25:04.594"] == "2024-03-02 16:25:04.594" and days["2024-03-02T10:00:00+02:00"] == "2024-03-02 08:00:00.000"
    ints = dict(df.select("t", coerce.to_integer(c)).collect())
    assert (ints["1e3"], ints["+7"], ints["5."], ints["2.5"], ints["1d"]) == (1000, 7, 5, None, None)
    bools = dict(df.select("t", coerce.to_boolean(c)).collect())
    assert (bools["y"], bools["T"], bools["0"], bools["abc"]) == (True, True, False, None)


def test_slug(spark):
    cases = {" 2025/10/23 12:09:55 ": "n2025_10_23_12_09_55", "Team Schema": "team_schema", "--": "", "_a__B_": "a_b", "Éa": "a"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert dict(df.select("t", coerce.slug(F.col("t"))).collect()) == cases


def test_store_over_one_mixed_table(spark):
    mixed = bags(spark, "A", [("a", "1", {"k": 1})]).unionByName(bags(spark, "B", [("b", "1.1", {"k": 2})]))
    st = EntityStore(mixed=mixed, organization="org")
    assert column(st.load("B"), "id") == ["b"] and st.all().count() == 2 and st.envelopes(["A"]).count() == 1
    with pytest.raises(KeyError):
        EntityStore().load("A")


# --- text and uploads ---------------------------------------------------------------------------


def test_small_doubles_keep_their_digits(spark):
    numbers = [1.2345678901234567e-5, 1e-9, 0.1, 123456.789, 3.0, 1.5e14, -2.5e-7]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select(values.double_text(F.col("x")).alias("t"))
    texts = [r.t for r in df.collect()]
    assert [float(t) for t in texts] == numbers
    assert texts[1:] == ["0.000000001", "0.1", "123456.789", "3", "150000000000000", "-0.00000025"]


def test_backslash_makes_the_next_character_plain():
    assert predicates.pattern("a\\b") == "%ab%"
    assert predicates.pattern("C:\\dir") == "%C:dir%"
    assert predicates.pattern("50\\%") == "%50\\%%" and predicates.pattern("end\\") == "%end\\\\%"


def test_export_keeps_blanks(spark, tmp_path):
    from entityframe.sources import export

    rows = [("  lead", "tail  "), ("", 'a "b", c')]
    export.write_csv(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "out"))
    assert sorted(map(tuple, export.read_back(spark, str(tmp_path / "out"), ["a", "b"]).collect())) == sorted(rows)


def test_header_names_differ_by_more_than_case():
    from entityframe.sources.csv_files import clean_headers

    assert clean_headers(["Name", "name", " a-b.c ", "", "NAME", "a b c"]) == ["Name", "name_2", "a_b_c", "column_4", "NAME_3", "a_b_c_2"]


def test_multi_line_records(spark, tmp_path):
    from entityframe.sources.csv_files import read_csv

    (tmp_path / "a.csv").write_text('\n , \nkey,note\n1,"two\nlines"\n2\n3,x,extra\n')
    raw = read_csv(spark, str(tmp_path / "a.csv"), multi_line=True)
    rows = sorted((r["@key"], r["@note"], r["row_number"]) for r in raw.df.collect())
    assert raw.columns == ["key", "note"] and rows == [("1", "two\nlines", 3), ("2", None, 4), ("3", "x", 5)]
