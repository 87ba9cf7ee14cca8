"""Transformation DAG queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityframe import PropertyFilter, Result
from entityframe.functions.props import Bag
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
)
from showcase import fixtures as X
from showcase.registry import query


def run(spark, sf, nodes, types, **options) -> Result:
    return Result(Transformation(nodes), X.store(spark, sf, *types), X.PLAIN_IDS, **options)


def output(alias: str, *fields: tuple[str, str, str]) -> Output:
    return Output(alias, tuple(OutputField(*f) for f in fields))


def flat(result: Result, **window) -> DataFrame:
    return result.flat(separator="_", text=False, **window)


FLAGSHIP = (
    Load("orders", (), "o", "Order", (PropertyFilter("o_orderstatus", "F"),)),
    Load("customers", (), "c", "Customer"),
    Join("joined", ("orders", "customers"), "o", "c", "o_custkey"),
    Materialize(
        "row",
        ("joined",),
        (
            output(
                "row",
                ("o", "o_orderkey", "order_key"),
                ("o", "o_totalprice", "price"),
                ("c", "c_name", "customer"),
                ("c", "c_mktsegment", "segment"),
            ),
        ),
    ),
)


@query(
    """
    SELECT o_orderkey AS row_order_key, o_totalprice AS row_price, c_name AS row_customer, c_mktsegment AS row_segment
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
    ORDER BY c_name, o_orderdate DESC, 'order:' || o_orderkey LIMIT 100 OFFSET 50
    """
)
def dag_flagship(spark, sf):
    """A page of the sorted join, as a report shows it."""
    nodes = (*FLAGSHIP, Sort("s", ("row",), "row", "customer"), Paginate("p", ("s",), 100, 50))
    return flat(run(spark, sf, nodes, ("Order", "Customer")))


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS row_order_key,
           regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS row_price,
           c_name AS row_customer, c_mktsegment AS row_segment
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
    """
)
def dag_flagship_all(spark, sf):
    """The same join, every row, as text cells."""
    return run(spark, sf, FLAGSHIP, ("Order", "Customer")).flat(separator="_")


@query("SELECT COUNT(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def dag_total(spark, sf):
    return run(spark, sf, FLAGSHIP, ("Order", "Customer")).total()


@query(
    """
    SELECT 'customer:' || c_custkey AS id, c_name, c_acctbal FROM customer
    WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 3, 5, 7)
    """
)
def dag_load_filter(spark, sf):
    wanted = PropertyFilter("nation", in_array=("nation:1", "nation:3", "nation:5", "nation:7"))
    nodes = (Load("l", (), "c", "Customer", (PropertyFilter("c_mktsegment", "BUILDING"), wanted)),)
    frame = run(spark, sf, nodes, ("Customer",)).frame()
    return frame.select("c.id", "c.properties.c_name", "c.properties.c_acctbal")


@query(
    """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P')
    """
)
def dag_filter_in_array(spark, sf):
    nodes = (
        Load("l", (), "o", "Order"),
        Filter("f", ("l",), "", (PropertyFilter("o_orderpriority", in_array=("1-URGENT", "2-HIGH")),)),
        Filter("g", ("f",), "o", (PropertyFilter("o_orderstatus", exists=True, in_array=("O", "P")),)),
    )
    return run(spark, sf, nodes, ("Order",)).frame().select("o.properties.o_orderkey", "o.properties.o_orderpriority", "o.properties.o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')")
def dag_filter_exists_false(spark, sf):
    """Empty and missing notes both count as absent."""
    nodes = (
        Load("l", (), "o", "Order"),
        Filter("f", ("l",), "o", (PropertyFilter("note", exists=False),)),
    )
    return run(spark, sf, nodes, ("Order",)).frame().select("o.properties.o_orderkey", "o.properties.o_orderpriority")


@query("SELECT 'part:' || p_partkey AS id, p_name, p_size, 2 AS kept FROM part")
def dag_project_rename(spark, sf):
    """Projecting under a new alias renames the only alias; the envelope stays."""
    nodes = (Load("l", (), "p", "Part"), Project("q", ("l",), "item", ("p_name", "p_size")))
    frame = run(spark, sf, nodes, ("Part",)).frame()
    kept = len(frame.schema["item"].dataType["properties"].dataType.fields)
    return frame.select("item.id", "item.properties.p_name", "item.properties.p_size", F.lit(kept).alias("kept"))


@query(
    """
    SELECT 'part:' || p_partkey AS id, p_name, p_size FROM part
    ORDER BY CAST(p_size AS VARCHAR) DESC, 'part:' || p_partkey LIMIT 40 OFFSET 10
    """
)
def dag_sort_paginate(spark, sf):
    """Sizes sort as text, so 9 comes after 10 going up."""
    nodes = (
        Load("l", (), "p", "Part"),
        Sort("s", ("l",), "p", "p_size", "DESC"),
        Paginate("g", ("s",), 40, 10),
    )
    return run(spark, sf, nodes, ("Part",)).frame().select("p.id", "p.properties.p_name", "p.properties.p_size")


@query(
    """
    SELECT 'part:' || p_partkey AS id, p_size FROM part
    ORDER BY p_size DESC, 'part:' || p_partkey LIMIT 25 OFFSET 5
    """
)
def dag_sort_typed(spark, sf):
    """The typed sort option, with the window given at run time."""
    nodes = (Load("l", (), "p", "Part"), Sort("s", ("l",), "p", "p_size", "DESC", typed=True))
    return run(spark, sf, nodes, ("Part",)).frame(25, 5).select("p.id", "p.properties.p_size")


# --- joins --------------------------------------------------------------------------------------

LINE = ("l.properties.l_orderkey", "l.properties.l_linenumber", "l.properties.l_quantity")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, 'part:' || p_partkey AS part_id, p_retailprice
    FROM lineitem JOIN part
      ON (CASE WHEN l_linenumber <> 7 THEN l_partkey END) IS NOT DISTINCT FROM (CASE WHEN p_partkey <> 0 THEN p_partkey END)
    """
)
def join_literal_nullsafe(spark, sf):
    """No schema reference on the field: its text decides, and a missing value matches a missing one."""
    nodes = (
        Load("a", (), "l", "LineItem"),
        Load("b", (), "p", "Part"),
        Join("j", ("a", "b"), "l", "p", "part_no"),
    )
    frame = run(spark, sf, nodes, ("LineItem", "Part")).frame()
    return frame.select(*LINE, F.col("p.id").alias("part_id"), "p.properties.p_retailprice")


@query(
    """
    SELECT CAST(COUNT(*) AS BIGINT) AS total FROM lineitem JOIN part
      ON (CASE WHEN l_linenumber <> 7 THEN l_partkey END) IS NOT DISTINCT FROM (CASE WHEN p_partkey <> 0 THEN p_partkey END)
    """
)
def join_literal_total(spark, sf):
    """Its size from the key counts of both sides, without forming the pairs."""
    nodes = (
        Load("a", (), "l", "LineItem"),
        Load("b", (), "p", "Part"),
        Join("j", ("a", "b"), "l", "p", "part_no"),
    )
    return run(spark, sf, nodes, ("LineItem", "Part")).total()


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, p_name, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey
    """
)
def join_entity_reference(spark, sf):
    nodes = (
        Load("a", (), "l", "LineItem"),
        Load("b", (), "p", "Part"),
        Join("j", ("a", "b"), "l", "p", "part"),
    )
    return run(spark, sf, nodes, ("LineItem", "Part")).frame().select(*LINE, "p.properties.p_name", "p.properties.p_retailprice")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, 'part:' || p_partkey AS part_id FROM lineitem JOIN part ON l_partkey = p_partkey
    """
)
def join_reference_array_distinct(spark, sf):
    """Each line names its part twice and its supplier once; a repeated id matches once."""
    nodes = (
        Load("a", (), "l", "LineItem"),
        Load("b", (), "p", "Part"),
        Join("j", ("a", "b"), "l", "p", "refs"),
    )
    return run(spark, sf, nodes, ("LineItem", "Part")).frame().select(*LINE, F.col("p.id").alias("part_id"))


@query(
    """
    SELECT 'customer:' || c_custkey AS customer_id, 'nation:' || n_nationkey AS nation_id, n_name
    FROM customer JOIN nation ON n_name = CASE c_mktsegment WHEN 'FURNITURE' THEN '' WHEN 'MACHINERY' THEN 'ATLANTIS'
      ELSE 'NATION_' || c_nationkey END
    """
)
def join_reference_canonical(spark, sf):
    """A REFERENCE meets the canonical reference of its target type; a blank one meets nothing."""
    nodes = (
        Load("a", (), "c", "Customer"),
        Load("b", (), "n", "Nation"),
        Join("j", ("a", "b"), "c", "n", "nation_ref"),
    )
    frame = run(spark, sf, nodes, ("Customer", "Nation")).frame()
    return frame.select(F.col("c.id").alias("customer_id"), F.col("n.id").alias("nation_id"), "n.properties.n_name")


URGENT = (PropertyFilter("o_orderpriority", "1-URGENT"), PropertyFilter("o_orderstatus", "F"))


@query(
    """
    SELECT 'customer:' || c_custkey AS customer_id, 'order:' || o_orderkey AS order_id, o_totalprice
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    """
)
def join_left(spark, sf):
    nodes = (
        Load("a", (), "c", "Customer"),
        Load("b", (), "o", "Order", URGENT),
        LeftJoin("j", ("a", "b"), "c", "o", "cust_no"),
    )
    frame = run(spark, sf, nodes, ("Customer", "Order")).frame()
    return frame.select(F.col("c.id").alias("customer_id"), F.col("o.id").alias("order_id"), "o.properties.o_totalprice")


@query(
    """
    SELECT CAST(COUNT(*) AS BIGINT) AS total
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    """
)
def join_left_total(spark, sf):
    nodes = (
        Load("a", (), "c", "Customer"),
        Load("b", (), "o", "Order", URGENT),
        LeftJoin("j", ("a", "b"), "c", "o", "cust_no"),
    )
    return run(spark, sf, nodes, ("Customer", "Order")).total()


@query(
    """
    SELECT 'customer:' || c_custkey AS customer_id, c_mktsegment FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
    """
)
def join_anti(spark, sf):
    nodes = (
        Load("a", (), "c", "Customer"),
        Load("b", (), "o", "Order", URGENT),
        AntiJoin("j", ("a", "b"), "c", "o", "cust_no"),
    )
    frame = run(spark, sf, nodes, ("Customer", "Order")).frame()
    return frame.select(F.col("c.id").alias("customer_id"), "c.properties.c_mktsegment")


SMALL = (PropertyFilter("p_type", "SMALL"),)


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN p_partkey IS NOT NULL THEN 'part:' || p_partkey END AS part_id
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_type = 'SMALL'
    """
)
def join_left_array(spark, sf):
    """A line whose list holds no small part stays once, with no part."""
    nodes = (
        Load("a", (), "l", "LineItem"),
        Load("b", (), "p", "Part", SMALL),
        LeftJoin("j", ("a", "b"), "l", "p", "refs"),
    )
    return run(spark, sf, nodes, ("LineItem", "Part")).frame().select(*LINE, F.col("p.id").alias("part_id"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL')
    """
)
def join_anti_array(spark, sf):
    nodes = (
        Load("a", (), "l", "LineItem"),
        Load("b", (), "p", "Part", SMALL),
        AntiJoin("j", ("a", "b"), "l", "p", "refs"),
    )
    return run(spark, sf, nodes, ("LineItem", "Part")).frame().select(*LINE)


CHAIN = (
    Load("a", (), "n", "Nation"),
    Load("b", (), "s", "Supplier"),
    Load("c", (), "c", "Customer"),
    Join("ns", ("a", "b"), "n", "s", ""),
    Join("nsc", ("ns", "c"), "s", "c", " "),
)


@query(
    """
    WITH n AS (SELECT 'nation:' || n_nationkey AS nation_id FROM nation),
         s AS (SELECT 'supplier:' || s_suppkey AS supplier_id FROM supplier),
         c AS (SELECT 'customer:' || c_custkey AS customer_id FROM customer)
    SELECT * FROM n, s, c ORDER BY nation_id, supplier_id, customer_id LIMIT 250 OFFSET 1400
    """
)
def join_cartesian(spark, sf):
    """A page of a three-way cross product, cut by position: the product itself is never formed."""
    nodes = (*CHAIN, Paginate("p", ("nsc",), 250, 1400))
    frame = run(spark, sf, nodes, ("Nation", "Supplier", "Customer")).frame()
    return frame.select(F.col("n.id").alias("nation_id"), F.col("s.id").alias("supplier_id"), F.col("c.id").alias("customer_id"))


@query(
    """
    SELECT CAST((SELECT COUNT(*) FROM nation) * (SELECT COUNT(*) FROM supplier) * (SELECT COUNT(*) FROM customer) AS BIGINT) AS total
    """
)
def join_cartesian_total(spark, sf):
    return run(spark, sf, CHAIN, ("Nation", "Supplier", "Customer")).total()


# --- union, materialize, flat results -----------------------------------------------------------


@query(
    """
    SELECT 'customer:' || c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'customer:' || c_custkey, c_name, c_acctbal FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, s_acctbal FROM supplier
    """
)
def dag_union_all(spark, sf):
    """Rows of all inputs under one alias; a customer in two inputs appears twice."""
    nodes = (
        Load("a", (), "x", "Customer", (PropertyFilter("c_mktsegment", "BUILDING"),)),
        Load("b", (), "x", "Customer"),
        Load("c", (), "x", "Supplier"),
        Union("u", ("a", "b", "c")),
    )
    frame = run(spark, sf, nodes, ("Customer", "Supplier")).frame()
    p = "x.properties"
    return frame.select(
        "x.id",
        F.coalesce(f"{p}.c_name", f"{p}.s_name").alias("name"),
        F.coalesce(f"{p}.c_acctbal", f"{p}.s_acctbal").alias("balance"),
    )


@query(
    """
    SELECT c_name AS result_name, 'customer:' || c_custkey AS result_id, c_acctbal AS result_balance FROM customer
    UNION ALL SELECT s_name, 'supplier:' || s_suppkey, s_acctbal FROM supplier
    """
)
def dag_materialize_any_alias(spark, sf):
    """Inputs under different aliases; each output field takes whichever alias has it."""
    nodes = (
        Load("a", (), "first", "Customer"),
        Load("b", (), "second", "Supplier"),
        Materialize("ma", ("a",), (output("first", ("first", "c_name", "name"), ("first", "c_acctbal", "balance")),)),
        Materialize("mb", ("b",), (output("second", ("second", "s_name", "name"), ("second", "s_acctbal", "balance")),)),
        Union("u", ("ma", "mb")),
        Materialize("m", ("u",), (output("result", (ANY_ALIAS, "name", "name"), ("", "id", "id"), ("", "balance", "balance")),)),
    )
    return flat(run(spark, sf, nodes, ("Customer", "Supplier")))


@query(
    """
    SELECT CASE WHEN o_orderkey IS NOT NULL THEN 'order:' || o_orderkey ELSE 'customer:' || c_custkey END AS seeded_id,
           CASE WHEN o_orderkey IS NOT NULL THEN 'Order' ELSE 'Customer' END AS seeded_type,
           c_name AS seeded_name, 'customer:' || c_custkey AS any_id, 'Customer' AS any_type, o_totalprice AS any_price
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    """
)
def dag_materialize_envelope(spark, sf):
    """An output's envelope comes from its first named alias that is there, else the next."""
    nodes = (
        Load("a", (), "c", "Customer"),
        Load("b", (), "o", "Order", URGENT),
        LeftJoin("j", ("a", "b"), "c", "o", "cust_no"),
        Materialize(
            "m",
            ("j",),
            (
                output("seeded", ("o", "o_orderkey", "key"), ("c", "c_name", "name")),
                output("anyone", (ANY_ALIAS, "o_totalprice", "price")),
            ),
        ),
    )
    frame = run(spark, sf, nodes, ("Customer", "Order")).frame()
    return frame.select(
        F.col("seeded.id").alias("seeded_id"),
        F.col("seeded.entity_type").alias("seeded_type"),
        F.col("seeded.properties.name").alias("seeded_name"),
        F.col("anyone.id").alias("any_id"),
        F.col("anyone.entity_type").alias("any_type"),
        F.col("anyone.properties.price").alias("any_price"),
    )


@query(
    """
    SELECT 'order:' || o_orderkey AS t_id, 'org-1' AS t_org, 'schema:Order' AS t_schema, 'Order' AS t_type,
           CAST(NULL AS VARCHAR) AS t_path, '1' AS t_version, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS t_created,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS t_updated
    FROM orders
    """
)
def dag_system_fields(spark, sf):
    """Envelope columns read as fields; an empty one counts as absent."""
    names = (("id", "id"), ("organizationId", "org"), ("schema_id", "schema"), ("entityType", "type"), ("path", "path"), ("version", "version"), ("createdAt", "created"), ("updated_at", "updated"))
    nodes = (
        Load("l", (), "o", "Order"),
        Materialize("m", ("l",), (output("t", *[("o", a, b) for a, b in names]),)),
    )
    return run(spark, sf, nodes, ("Order",)).flat(separator="_")


@query(
    """
    SELECT o_orderkey AS row_order_key, o_totalprice AS row_price, c_name AS row_customer, c_mktsegment AS row_segment
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F' AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD')
    ORDER BY c_name DESC, o_orderdate DESC, 'order:' || o_orderkey LIMIT 60 OFFSET 20
    """
)
def dag_result_filters_before_page(spark, sf):
    result = run(
        spark,
        sf,
        FLAGSHIP,
        ("Order", "Customer"),
        filters={"row": [PropertyFilter("segment", in_array=("BUILDING", "HOUSEHOLD"))]},
        sort=("row", "customer", "DESC"),
    )
    return flat(result, limit=60, offset=20)


@query(
    """
    WITH j AS (SELECT * FROM customer LEFT JOIN orders
               ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
    s AS (SELECT 'c' AS alias, 'Customer' AS entity_types, 'c_mktsegment' AS field, min_by(c_mktsegment, 'customer:' || c_custkey) AS sample FROM j
          UNION ALL SELECT 'c', 'Customer', 'c_name', min_by(c_name, 'customer:' || c_custkey) FROM j
          UNION ALL SELECT 'o', 'Order', 'o_orderkey', (SELECT CAST(o_orderkey AS VARCHAR) FROM j WHERE o_orderkey IS NOT NULL
                    ORDER BY 'customer:' || c_custkey, o_orderdate DESC, 'order:' || o_orderkey LIMIT 1))
    SELECT * FROM s
    """
)
def dag_alias_summary(spark, sf):
    """Types and first sample per alias and field."""
    nodes = (
        Load("a", (), "c", "Customer"),
        Load("b", (), "o", "Order", URGENT),
        Project("pa", ("a",), "c", ("c_name", "c_mktsegment", "cust_no")),
        Project("pb", ("b",), "o", ("o_orderkey", "cust_no")),
        LeftJoin("j", ("pa", "pb"), "c", "o", "cust_no"),
    )
    summary = run(spark, sf, nodes, ("Customer", "Order")).alias_summary()
    return summary.filter(F.col("field") != "cust_no").withColumn("entity_types", F.array_join("entity_types", ","))


@query(
    """
    WITH s AS (SELECT * FROM customer ORDER BY c_mktsegment DESC, c_name LIMIT 1)
    SELECT 'c' AS alias, 'Customer' AS entity_types, 'c_name' AS field, c_name AS sample FROM s
    UNION ALL SELECT 'c', 'Customer', 'c_mktsegment', c_mktsegment FROM s
    """
)
def dag_alias_summary_descending(spark, sf):
    """The first sample after a sort by a descending text, then an ascending one."""
    nodes = (
        Load("a", (), "c", "Customer"),
        Project("pa", ("a",), "c", ("c_name", "c_mktsegment")),
        Sort("s1", ("pa",), "c", "c_name", "ASC"),
        Sort("s2", ("s1",), "c", "c_mktsegment", "DESC"),
    )
    summary = run(spark, sf, nodes, ("Customer",)).alias_summary()
    return summary.withColumn("entity_types", F.array_join("entity_types", ","))


@query(
    """
    SELECT 'order:' || o_orderkey AS id, 'archive.' || o_orderkey AS path, 'ArchivedOrder' AS entity_type,
           o_totalprice * 2 AS doubled, o_orderpriority AS priority, 0 AS has_note
    FROM orders
    """
)
def entity_property_edits(spark, sf):
    """Single-property edits as column work: set one, drop one, move the path, change the type."""
    df = X.orders(spark, sf)
    edited = Bag.of(df).edited(o_totalprice=F.col("@o_totalprice") * 2, note=None)
    moved = df.select(
        "id",
        F.concat(F.lit("archive."), F.col("@o_orderkey")).alias("path"),
        F.lit("ArchivedOrder").alias("entity_type"),
        edited.col.alias("p"),
    )
    has_note = int("note" in moved.schema["p"].dataType.names)
    return moved.select(
        "id",
        "path",
        "entity_type",
        F.col("p.o_totalprice").alias("doubled"),
        F.col("p.o_orderpriority").alias("priority"),
        F.lit(has_note).alias("has_note"),
    )


@query(
    """
    SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, event_type AS type, 'x' || user_id AS second_tag,
           CASE event_type WHEN 'purchase' THEN 'meta,refund,tags,type,user' ELSE 'meta,tags,type,user' END AS keys,
           CAST(json_array_length(json('["a","b"]')) AS INTEGER) AS tags
    FROM events
    """
)
def json_properties(spark, sf):
    """JSON text to a bag and back."""
    df = X.events(spark, sf)
    again = df.withColumn("properties", F.parse_json(Bag.of(df).json()))
    bag = Bag.of(again)
    tags = bag.texts("tags")
    return again.select(
        F.regexp_replace("id", "event:", "").cast("bigint").alias("event_id"),
        F.try_variant_get(bag.value("meta"), "$.k", "bigint").alias("k"),
        bag.text("type").alias("type"),
        F.get(tags, F.lit(1)).alias("second_tag"),
        F.array_join(F.array_sort(bag.keys()), ",").alias("keys"),
        F.size(tags).alias("tags"),
    )


