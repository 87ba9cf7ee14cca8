"""Saved joins and reference normalising."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityframe import FieldType, PropertyFilter
from entityframe.functions import values
from entityframe.operators.joins import JoinSort, SavedJoin, run_saved_join
from showcase import fixtures as X
from showcase.registry import query

ORDER_CUSTOMER = SavedJoin(
    "Order", "Customer", "REFERENCE", "o_custkey", FieldType.ENTITY_REFERENCE, left_filters=(PropertyFilter("o_orderstatus", "F"),)
)

def edge_ids():
    return [F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id")]



@query(
    """
    SELECT 'order:' || o_orderkey AS left_id, 'customer:' || c_custkey AS right_id, o_totalprice, c_name
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
    """
)
def saved_join_reference(spark, sf):
    edges = run_saved_join(X.store(spark, sf, "Order", "Customer"), ORDER_CUSTOMER, limit=None).edges
    return edges.select(*edge_ids(), "l.properties.o_totalprice", "r.properties.c_name")


@query("SELECT COUNT(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def saved_join_total(spark, sf):
    return run_saved_join(X.store(spark, sf, "Order", "Customer"), ORDER_CUSTOMER).total


LINE_PART = SavedJoin("LineItem", "Part", "REFERENCE", "refs", FieldType.ENTITY_REFERENCE_ARRAY)


@query(
    """
    SELECT l_orderkey, l_linenumber, 'part:' || p_partkey AS right_id, p_retailprice
    FROM lineitem JOIN part ON l_partkey = p_partkey, (VALUES (1), (2)) twice(n)
    """
)
def saved_join_array_dups(spark, sf):
    """An id that a list repeats gives an edge each time."""
    edges = run_saved_join(X.store(spark, sf, "LineItem", "Part"), LINE_PART, limit=None).edges
    return edges.select("l.properties.l_orderkey", "l.properties.l_linenumber", edge_ids()[1], "r.properties.p_retailprice")


CROSS = SavedJoin(
    "Nation", "Supplier", "CROSS", sorts=(JoinSort("LEFT", "n_name", "DESC"), JoinSort("RIGHT", "s_name", "ASC"))
)


@query(
    """
    SELECT 'nation:' || n_nationkey AS left_id, 'supplier:' || s_suppkey AS right_id, n_name, s_name
    FROM nation CROSS JOIN supplier
    ORDER BY n_name DESC, s_name, left_id, right_id LIMIT 25 OFFSET 95
    """
)
def saved_join_cross(spark, sf):
    """One page of a cross join; only the rows on the page are ever paired."""
    named = (PropertyFilter("s_name", exists=True),)
    edges = run_saved_join(X.store(spark, sf, "Nation", "Supplier"), CROSS, right_filters=named, offset=95).edges
    return edges.select(*edge_ids(), "l.properties.n_name", "r.properties.s_name")


@query("SELECT CAST((SELECT COUNT(*) FROM nation) * (SELECT COUNT(*) FROM supplier) AS BIGINT) AS total")
def saved_join_cross_total(spark, sf):
    return run_saved_join(X.store(spark, sf, "Nation", "Supplier"), CROSS).total


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, 'part:' || p_partkey AS right_id
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag IN ('A', 'R') AND l_linenumber <> 7
      AND (l_partkey IN (5, 6, 7) OR l_suppkey IN (1, 2, 3)) AND p_type = 'ECONOMY'
    """
)
def saved_join_filters(spark, sf):
    """Strict existence, lists that match a scalar or any array element, and run-time extras."""
    refs = ("part:5", "part:6", "part:7", "supplier:1", "supplier:2", "supplier:3")
    join = SavedJoin(
        "LineItem",
        "Part",
        "REFERENCE",
        "part",
        FieldType.ENTITY_REFERENCE,
        left_filters=(PropertyFilter("refs", in_array=refs), PropertyFilter("part_no", exists=True)),
    )
    edges = run_saved_join(
        X.store(spark, sf, "LineItem", "Part"),
        join,
        left_filters=(PropertyFilter("l_returnflag", in_array=("A", "R")),),
        right_filters=(PropertyFilter("p_type", "ECONOMY"),),
        limit=None,
    ).edges
    return edges.select(
        "l.properties.l_orderkey", "l.properties.l_linenumber", "l.properties.l_quantity", edge_ids()[1]
    )


@query(
    """
    SELECT 'order:' || o_orderkey AS left_id, 'customer:' || c_custkey AS right_id,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
    ORDER BY CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END DESC NULLS LAST, c_name ASC NULLS LAST,
             o_orderdate DESC, left_id LIMIT 50 OFFSET 100
    """
)
def saved_join_nulls_last(spark, sf):
    """Missing sort values come last in both directions."""
    sorts = (JoinSort("RIGHT", "segment", "DESC"), JoinSort("RIGHT", "c_name"))
    edges = run_saved_join(X.store(spark, sf, "Order", "Customer"), ORDER_CUSTOMER, sorts=sorts, limit=50, offset=100).edges
    return edges.select(*edge_ids(), "r.properties.segment")


@query(
    """
    WITH h AS (SELECT c_custkey, md5(c_name) AS m, c_name, c_mktsegment FROM customer)
    SELECT c_custkey, substr(m,1,8)||'-'||substr(m,9,4)||'-'||substr(m,13,4)||'-'||substr(m,17,4)||'-'||substr(m,21,12) AS ids,
           CAST(1 AS INTEGER) AS id_count, c_name || '|' || c_mktsegment AS texts
    FROM h
    """
)
def normalise_refs(spark, sf):
    """Four spellings of one UUID and a bad one become one id; repeats and blanks leave a text list."""
    df = X.table(spark, sf, "customer")
    m = F.md5("c_name")
    dashed = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    messy = F.array(
        F.concat(F.lit("{"), F.upper(dashed), F.lit("}")), F.concat(F.lit("URN:uuid:"), dashed), m, dashed, F.lit("not-an-id"), F.lit("")
    )
    texts = F.array(F.array("c_name", F.lit("")), F.array("c_mktsegment", "c_name"))
    shown = df.select("c_custkey", messy.alias("messy"), texts.alias("nested"))
    ids = values.id_list(F.col("messy"), shown.schema["messy"].dataType)
    flat = values.text_list(F.col("nested"), shown.schema["nested"].dataType)
    return shown.select(
        "c_custkey",
        F.array_join(ids, "|").alias("ids"),
        F.size(ids).alias("id_count"),
        F.array_join(flat, "|").alias("texts"),
    )
