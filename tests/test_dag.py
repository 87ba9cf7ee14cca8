import pytest
from pyspark.sql import functions as F

from entityframe import EntitySchema, Field, Options, PropertyFilter, Result
from entityframe.functions import values
from entityframe.operators.joins import CartesianError
from entityframe.plans.nodes import (
    ANY_ALIAS,
    AntiJoin,
    Filter,
    Join,
    LeftJoin,
    Load,
    Materialize,
    Output,
    OutputField,
    Paginate,
    Project,
    Sort,
    Transformation,
    Union,
    nodes_from_json,
)
from helpers import bags, column, store, typed

PLAIN = Options(key_norm=values.trim_norm)
U1, U2 = "11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222"


def run(nodes, st, options=PLAIN, **kw):
    return Result(Transformation(tuple(nodes)), st, options, **kw)


@pytest.fixture(params=["typed", "variant"])
def users(spark, request):
    if request.param == "typed":
        rows = [("a", "Charlie", "active"), ("b", "Bob", ""), ("c", "Dora", None)]
        return store({"user": typed(spark, "user", "name string, status string", rows)})
    rows = [
        ("a", None, {"name": "Charlie", "status": "active"}),
        ("b", None, {"name": "Bob", "status": ""}),
        ("c", None, {"name": "Dora"}),
    ]
    return store({"user": bags(spark, "user", rows)})


def test_load_and_filter(users):
    active = (PropertyFilter("status", "active"),)
    loaded = run([Load("l", (), "u", "user", active)], users).frame()
    assert column(loaded, "u.id") == ["a"]
    filtered = run([Load("l", (), "u", "user"), Filter("f", ("l",), "", active)], users).frame()
    assert column(filtered, "u.id") == ["a"]


def test_exists_false_takes_empty_and_missing(users):
    missing = (PropertyFilter("status", exists=False),)
    assert sorted(column(run([Load("l", (), "u", "user", missing)], users).frame(), "u.id")) == ["b", "c"]
    strict = (PropertyFilter("status", exists=False, in_array=("x",)),)
    assert column(run([Load("l", (), "u", "user", strict)], users).frame(), "u.id") == []


def test_json_null_exists(spark):
    st = store({"user": bags(spark, "user", [("a", None, {"s": None}), ("b", None, {})])})
    assert column(run([Load("l", (), "u", "user", (PropertyFilter("s", exists=True),))], st).frame(), "u.id") == ["a"]
    assert sorted(column(run([Load("l", (), "u", "user", (PropertyFilter("s", exists=False),))], st).frame(), "u.id")) == ["a", "b"]


def test_sort_and_page(users):
    nodes = [Load("l", (), "u", "user"), Sort("s", ("l",), "u", "name")]
    assert column(run(nodes, users).frame(), "u.id") == ["b", "a", "c"]
    assert column(run([*nodes, Paginate("p", ("s",), 1, 1)], users).frame(), "u.id") == ["a"]
    assert column(run([*nodes, Paginate("p", ("s",), None, 1)], users).frame(), "u.id") == ["a", "c"]
    assert column(run([*nodes, Paginate("p", ("s",), 5, 9)], users).frame(), "u.id") == []


def test_sort_puts_missing_entities_and_values_as_text(spark):
    left = typed(spark, "L", "k string", [("l1", "x"), ("l2", "none")])
    right = typed(spark, "R", "k string, v string", [("r1", "x", None)])
    nodes = [
        Load("a", (), "l", "L"),
        Load("b", (), "r", "R"),
        LeftJoin("j", ("a", "b"), "l", "r", "k"),
        Sort("s", ("j",), "r", "v"),
    ]
    assert column(run(nodes, store({"L": left, "R": right})).frame(), "l.id") == ["l2", "l1"]


def test_stable_sort_survives_materialize(spark):
    df = typed(spark, "T", "k string, n int", [("a", "x", 3), ("b", "y", 1), ("c", "x", 2)])
    nodes = [
        Load("l", (), "t", "T"),
        Sort("s1", ("l",), "t", "n"),
        Sort("s2", ("s1",), "t", "k"),
        Materialize("m", ("s2",), (Output("o", (OutputField("t", "id", "key"),)),)),
    ]
    assert [r["o.key"] for r in run(nodes, store({"T": df})).flat(2).collect()] == ["c", "a"]


def test_project_keeps_envelope_and_renames(users):
    out = run([Load("l", (), "u", "user"), Project("p", ("l",), "people", ("name",))], users).frame()
    assert out.columns == ["people"]
    assert sorted(column(out, "people.id")) == ["a", "b", "c"]
    assert sorted(column(out, F.to_json("people.properties"))) == ['{"name":"Bob"}', '{"name":"Charlie"}', '{"name":"Dora"}']


def test_alias_errors(spark, users):
    two = [Load("a", (), "x", "user"), Load("b", (), "y", "user"), Join("j", ("a", "b"), "x", "y", "name")]
    with pytest.raises(ValueError):
        run([*two, Filter("f", ("j",), "z", (PropertyFilter("name", "q"),))], users)
    with pytest.raises(ValueError):
        run([*two, Project("f", ("j",), "", ("name",))], users)
    with pytest.raises(ValueError):
        run([Load("a", (), "x", "user"), Join("j", ("a", "a"), "x", "nope", "name")], users)


def test_materialize_one_alias(users):
    fields = (OutputField("u", "name", "firstName"), OutputField("u", "status", "status"), OutputField("u", "ID", "id"))
    active = (PropertyFilter("status", "active"),)
    out = run([Load("l", (), "u", "user", active), Materialize("m", ("l",), (Output("materialized", fields),))], users).frame()
    row = out.select("materialized.id", "materialized.entity_type", F.to_json("materialized.properties").alias("p")).first()
    assert tuple(row) == ("a", "user", '{"firstName":"Charlie","status":"active","id":"a"}')


def test_union_with_any_alias(spark):
    st = store({"A": typed(spark, "A", "name string", [("1", "First")]), "B": typed(spark, "B", "name string", [("2", "Second")])})
    fields = (OutputField(ANY_ALIAS, "name", "name"), OutputField("", "id", "id"))
    nodes = [
        Load("a", (), "first", "A"),
        Load("b", (), "second", "B"),
        Union("u", ("a", "b")),
        Materialize("m", ("u",), (Output("result", fields),)),
    ]
    out = run(nodes, st).frame().select("result.id", "result.properties.name", "result.properties.id")
    assert sorted(map(tuple, out.collect())) == [("1", "First", "1"), ("2", "Second", "2")]


def test_unseeded_envelope_comes_from_the_first_value(spark):
    st = store({"A": typed(spark, "A", "name string", [("1", "First"), ("2", None)])})
    nodes = [Load("a", (), "x", "A"), Materialize("m", ("a",), (Output("o", (OutputField("", "name", "name"),)),))]
    out = run(nodes, st).frame().select("o.id", "o.properties.name")
    assert sorted(map(tuple, out.collect()), key=str) == [("1", "First"), (None, None)]


def test_union_of_clashing_types_keeps_values(spark):
    st = store(
        {"A": typed(spark, "A", "v int", [("1", 5)]), "B": typed(spark, "B", "v string", [("2", "x")]), "C": bags(spark, "C", [("3", None, {"v": [1]})])}
    )
    nodes = [Load("a", (), "t", "A"), Load("b", (), "t", "B"), Load("c", (), "t", "C")]
    both = run([*nodes[:2], Union("u", ("a", "b"))], st)
    assert sorted(r[0] for r in both.frame().select(F.to_json("t.properties")).collect()) == ['{"v":"x"}', '{"v":5}']
    three = run([*nodes, Union("u", ("a", "b", "c")), Filter("f", ("u",), "t", (PropertyFilter("v", "5"),))], st)
    assert column(three.frame(), "t.id") == ["1"]


def test_paged_join_with_one_shared_key(spark):
    left = typed(spark, "L", "join string, idx int", [(f"l{i:03}", "shared", i) for i in range(30)])
    right = typed(spark, "R", "join string, idx int", [(f"r{i:03}", "shared", i) for i in range(25)])
    nodes = [Load("a", (), "l", "L"), Load("b", (), "r", "R"), Join("j", ("a", "b"), "l", "r", "join")]
    result = run(nodes, store({"L": left, "R": right}))
    rows = result.frame(10, 50).select("l.properties.idx", "r.properties.idx").collect()
    assert [tuple(r) for r in rows] == [(k // 25, k % 25) for k in range(50, 60)]
    assert result.total().first()["total"] == 750


def test_cartesian_chain_is_paged_without_a_product(spark):
    sizes = {"A": 120, "B": 110, "C": 95}
    st = store({t: typed(spark, t, "idx int", [(f"{t}{i:03}", i) for i in range(n)]) for t, n in sizes.items()})
    nodes = [
        Load("a", (), "left", "A"),
        Load("b", (), "middle", "B"),
        Load("c", (), "right", "C"),
        Join("ab", ("a", "b"), "left", "middle", ""),
        Join("abc", ("ab", "c"), "middle", "right", ""),
    ]
    result = run(nodes, st)
    assert result.total().first()["total"] == 1_254_000
    for offset in (50, 95 * 110 - 10, 1_253_990):
        page = result.frame(25, offset)
        got = [tuple(r) for r in page.select("left.properties.idx", "middle.properties.idx", "right.properties.idx").collect()]
        assert got == [(p // (110 * 95), p // 95 % 110, p % 95) for p in range(offset, min(offset + 25, 1_254_000))]
        plan = page._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(CartesianError):
        result.frame()
    sorted_page = run([*nodes, Sort("s", ("abc",), "left", "idx", "DESC")], st).frame(1)
    assert column(sorted_page, "left.properties.idx") == [99]  # "99" is the largest text


def test_whole_cross_product_on_request(spark):
    st = store({t: typed(spark, t, "idx int", [(f"{t}{i}", i) for i in range(n)]) for t, n in {"A": 3, "B": 4}.items()})
    nodes = [Load("a", (), "a", "A"), Load("b", (), "b", "B"), Join("ab", ("a", "b"), "a", "b", "")]
    whole = run(nodes, st, Options(allow_cartesian=True)).frame()
    assert len(set(whole.select("a.id", "b.id").collect())) == whole.count() == 12
    nodes[2] = LeftJoin("ab", ("a", "b"), "a", "b", "")
    assert run(nodes, st, Options(allow_cartesian=True)).frame().count() == 12
    nodes[1] = Load("b", (), "b", "B", (PropertyFilter("idx", "77"),))
    alone = run(nodes, st, Options(allow_cartesian=True)).frame().select("a.id", "b.id").collect()
    assert sorted(r[0] for r in alone) == ["A0", "A1", "A2"] and {r[1] for r in alone} == {None}


def test_anti_join_without_a_field(spark):
    st = store({"A": typed(spark, "A", "v int", [("1", 1)]), "B": typed(spark, "B", "v int", [("2", 2)])})
    nodes = [Load("a", (), "a", "A"), Load("b", (), "b", "B"), AntiJoin("j", ("a", "b"), "a", "b", "")]
    assert run(nodes, st).frame().count() == 0
    nodes[1] = Load("b", (), "b", "B", (PropertyFilter("v", "77"),))
    assert run(nodes, st).frame().count() == 1


DEVICE = EntitySchema("device", (Field("owner", "ENTITY_REFERENCE", False, "user"),))
GROUP = EntitySchema("group", (Field("members", "ENTITY_REFERENCE_ARRAY", False, "user"),))


def test_entity_reference_join(spark):
    users = bags(spark, "user", [(U1, None, {"username": "ann"}), (U2, None, {"username": "bo"})])
    devices = bags(spark, "device", [("d1", None, {"owner": "{" + U1.upper() + "}"}), ("d2", None, {"owner": "bad"}), ("d3", None, {})])
    st = store({"user": users, "device": devices}, [DEVICE])
    nodes = [Load("a", (), "d", "device"), Load("b", (), "u", "user"), Join("j", ("a", "b"), "d", "u", "owner")]
    out = run(nodes, st, Options()).frame()
    assert [tuple(r) for r in out.select("d.id", "u.id").collect()] == [("d1", U1)]


@pytest.mark.parametrize("kind", ["variant", "typed"])
def test_reference_array_join(spark, kind):
    users = bags(spark, "user", [(U1, None, {}), (U2, None, {})])
    lists = [("g1", [U1, U2, U1]), ("g2", []), ("g3", ["x", U2]), ("g4", None), ("g5", ["nobody"])]
    if kind == "typed":
        groups = typed(spark, "group", "members array<string>", lists)
    else:
        groups = bags(spark, "group", [(i, None, {} if m is None else {"members": m}) for i, m in lists])
    st = store({"user": users, "group": groups}, [GROUP])
    loads = [Load("a", (), "g", "group"), Load("b", (), "u", "user")]

    def pairs(node):
        return sorted(map(tuple, run([*loads, node], st, Options()).frame().select("g.id", "u.id").collect()), key=str)

    inner = [("g1", U1), ("g1", U2), ("g3", U2)]
    assert pairs(Join("j", ("a", "b"), "g", "u", "members")) == inner
    assert pairs(LeftJoin("j", ("a", "b"), "g", "u", "members")) == sorted([*inner, ("g2", None), ("g4", None), ("g5", None)], key=str)
    anti = run([*loads, AntiJoin("j", ("a", "b"), "g", "u", "members")], st, Options()).frame()
    assert sorted(column(anti, "g.id")) == ["g2", "g4", "g5"]


def test_list_join_keeps_equal_left_rows(spark):
    users = bags(spark, "user", [(U1, None, {})])
    groups = typed(spark, "group", "members array<string>", [("g1", [U1]), ("g1", [U1]), ("g2", ["x"]), ("g2", ["x"])])
    st = store({"user": users, "group": groups}, [GROUP])
    nodes = [Load("a", (), "g", "group"), Load("b", (), "u", "user"), LeftJoin("j", ("a", "b"), "g", "u", "members")]
    out = run(nodes, st, Options()).frame().select("g.id", "u.id")
    assert sorted(map(tuple, out.collect()), key=str) == [("g1", U1), ("g1", U1), ("g2", None), ("g2", None)]


ACCOUNT = EntitySchema("account", (Field("slug", "REFERENCE"), Field("alternate", "REFERENCE")))
VENDOR = EntitySchema("vendor", (Field("code", "REFERENCE"),))
TICKET = EntitySchema("ticket", (Field("accountRef", "REFERENCE", False, "account"),))
FREE = EntitySchema("ticket", (Field("accountRef", "REFERENCE"),))


def test_canonical_reference_join_respects_target_type(spark):
    accounts = typed(spark, "account", "slug string, alternate string", [("a1", "acct-001", "x"), ("a2", "acct-002", "acct-001")])
    vendors = typed(spark, "vendor", "code string", [("v1", "acct-001")])
    tickets = typed(spark, "ticket", "accountRef string", [("t1", "acct-001"), ("t2", ""), ("t3", None)])
    for schema, expected in ((TICKET, [("t1", "a1")]), (FREE, [("t1", "a1"), ("t1", "v1")])):
        st = store({"account": accounts, "vendor": vendors, "ticket": tickets}, [ACCOUNT, VENDOR, schema])
        nodes = [
            Load("t", (), "t", "ticket"),
            Load("a", (), "x", "account"),
            Load("v", (), "x", "vendor"),
            Union("r", ("a", "v")),
            Join("j", ("t", "r"), "t", "x", "accountRef"),
        ]
        assert sorted(map(tuple, run(nodes, st).frame().select("t.id", "x.id").collect())) == expected


def test_reference_without_canonical_falls_back_to_the_literal(spark):
    left = typed(spark, "ticket", "ref string", [("t1", "k"), ("t2", None)])
    right = typed(spark, "thing", "ref string", [("x1", "k"), ("x2", None)])
    st = store({"ticket": left, "thing": right}, [EntitySchema("ticket", (Field("ref", "REFERENCE"),))])
    nodes = [Load("a", (), "t", "ticket"), Load("b", (), "x", "thing"), Join("j", ("a", "b"), "t", "x", "ref")]
    assert [tuple(r) for r in run(nodes, st).frame().select("t.id", "x.id").collect()] == [("t1", "x1")]


def test_literal_join_matches_null_with_null_unless_told_not_to(spark):
    st = store({"A": typed(spark, "A", "k int", [("1", 1), ("2", None)]), "B": typed(spark, "B", "k string", [("x", "1"), ("y", None)])})
    nodes = [Load("a", (), "a", "A"), Load("b", (), "b", "B"), Join("j", ("a", "b"), "a", "b", "k")]
    kept = run(nodes, st)
    assert sorted(map(tuple, kept.frame().select("a.id", "b.id").collect())) == [("1", "x"), ("2", "y")]
    assert kept.total().first()[0] == 2
    strict = run(nodes, st, Options(null_safe=False))
    assert [tuple(r) for r in strict.frame().select("a.id", "b.id").collect()] == [("1", "x")]
    assert strict.total().first()[0] == 1


def test_self_join_and_alias_clash(spark):
    df = typed(spark, "A", "k int, up int", [("1", 1, 2), ("2", 2, 1)])
    st = store({"A": df})
    nodes = [Load("a", (), "x", "A"), Join("j", ("a", "a"), "x", "x", "k")]
    out = run(nodes, st).frame()
    assert out.columns == ["x"] and out.count() == 2


def test_join_by_type_splits_a_mixed_alias(spark):
    users = bags(spark, "user", [(U1, None, {"owner": "plain"})])
    devices = typed(spark, "device", "owner string", [("d1", U1)])
    notes = typed(spark, "note", "owner string", [("n1", "plain"), ("n2", U1)])
    st = store({"user": users, "device": devices, "note": notes}, [DEVICE])
    nodes = [
        Load("d", (), "x", "device"),
        Load("n", (), "x", "note"),
        Union("u", ("d", "n")),
        Load("r", (), "u", "user"),
        Join("j", ("u", "r"), "x", "u", "owner"),
    ]
    assert sorted(column(run(nodes, st, Options()).frame(), "x.id")) == ["d1", "n1"]


def test_flat_execution(spark):
    rows = [("1", "Alice", "active"), ("2", "Bob", "inactive"), ("3", "Charlie", "active")]
    st = store({"User": typed(spark, "User", "firstName string, status string", rows)})
    fields = (OutputField("u", "firstName", "firstName"), OutputField("u", "status", "status"))
    nodes = [Load("l", (), "u", "User"), Materialize("m", ("l",), (Output("table", fields),))]
    active = {"table": [PropertyFilter("status", "active")]}
    assert run(nodes, st, filters=active).flat().count() == 2
    down = run(nodes, st, sort=("table", "firstName", "DESC"))
    assert [r[0] for r in down.flat(1).collect()] == ["Charlie"]
    assert down.total().first()[0] == 3
    both = run(nodes, st, filters=active, sort=("table", "firstName", "DESC"))
    assert [r["table.firstName"] for r in both.flat(1, 1).collect()] == ["Alice"]
    assert both.flat().columns == ["table.firstName", "table.status"]


def test_graph_errors():
    with pytest.raises(ValueError, match="cycles"):
        Transformation((Filter("a", ("b",)), Filter("b", ("a",)))).ordered()
    with pytest.raises(ValueError, match="not found"):
        Transformation((Filter("a", ("x",)),)).ordered()
    with pytest.raises(ValueError, match="needs 2"):
        Transformation((Load("l", (), "a", "A"), Join("j", ("l",)))).ordered()
    with pytest.raises(ValueError, match="name the output"):
        Transformation((Load("l", (), "a", "A"), Load("k", (), "a", "A"))).result_id()
    with pytest.raises(ValueError):
        Transformation((Load("l", (), "a", "A"), Materialize("m", ("l",), ()))).ordered()


def test_stored_definition(users):
    text = """[
      {"id": "1", "type": "LOAD", "inputs": [], "load": {"alias": "u", "entityType": "user"}},
      {"id": "2", "type": "FILTER", "inputs": ["1"], "filter": {"alias": "u", "filters": [{"key": "status", "value": "active"}]}},
      {"id": "3", "type": "SORT", "inputs": ["2"], "sort": {"alias": "u", "field": "name", "direction": "DESC"}},
      {"id": "4", "type": "PAGINATE", "inputs": ["3"], "paginate": {"limit": 5}},
      {"id": "5", "type": "MATERIALIZE", "inputs": ["4"], "materialize": {"outputs": [{"alias": "o",
        "fields": [{"sourceAlias": "u", "sourceField": "name", "outputField": "n"}]}]}}]"""
    assert [r["o.n"] for r in run(nodes_from_json(text), users).flat().collect()] == ["Charlie"]
    with pytest.raises(ValueError):
        nodes_from_json('[{"id": "1", "type": "PIVOT"}]')
