"""The test tables viewed as entity types (all projections: nothing is read until a query runs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe import EntitySchema, EntityStore, Field, Options, entities_from, tune
from entityframe.functions import values
from entityframe.session import stage

ORG = "org-1"
PLAIN_IDS = Options(key_norm=values.trim_norm)  # ids here are texts like customer:12, not UUIDs


def text_id(c: Column) -> Column:
    """The id normaliser for links: ``type:number`` texts are ids, anything else is not."""
    return F.when(c.rlike("^[a-z]+:[0-9]+$"), c)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ref(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


SCHEMAS = {
    "Region": EntitySchema("Region", (Field("r_regionkey", "INTEGER", True), Field("r_name", "REFERENCE"))),
    "Nation": EntitySchema(
        "Nation",
        (
            Field("n_nationkey", "INTEGER", True),
            Field("n_name", "REFERENCE"),
            Field("region", "ENTITY_REFERENCE", True, "Region"),
        ),
    ),
    "Customer": EntitySchema(
        "Customer",
        (
            Field("c_custkey", "INTEGER", True),
            Field("c_name", "REFERENCE"),
            Field("nation", "ENTITY_REFERENCE", True, "Nation"),
            Field("nation_ref", "REFERENCE", False, "Nation"),
            Field("c_acctbal", "FLOAT"),
            Field("c_mktsegment", "STRING"),
        ),
    ),
    "Supplier": EntitySchema(
        "Supplier",
        (
            Field("s_suppkey", "INTEGER", True),
            Field("s_name", "REFERENCE"),
            Field("nation", "ENTITY_REFERENCE", True, "Nation"),
            Field("s_acctbal", "FLOAT"),
        ),
    ),
    "Part": EntitySchema(
        "Part",
        (
            Field("part_no", "INTEGER"),
            Field("p_name", "REFERENCE"),
            Field("p_brand", "STRING"),
            Field("p_type", "STRING"),
            Field("p_size", "INTEGER"),
            Field("p_retailprice", "FLOAT"),
        ),
    ),
    "Order": EntitySchema(
        "Order",
        (
            Field("o_orderkey", "INTEGER", True),
            Field("o_custkey", "ENTITY_REFERENCE", True, "Customer"),
            Field("partner", "ENTITY_REFERENCE", False, "Customer"),
            Field("o_orderstatus", "STRING"),
            Field("o_totalprice", "FLOAT"),
            Field("o_orderdate", "TIMESTAMP"),
            Field("o_orderpriority", "STRING"),
            Field("note", "STRING"),
            Field("cust_no", "INTEGER"),
        ),
    ),
    "LineItem": EntitySchema(
        "LineItem",
        (
            Field("l_orderkey", "INTEGER", True),
            Field("l_linenumber", "INTEGER", True),
            Field("part", "ENTITY_REFERENCE", True, "Part"),
            Field("refs", "ENTITY_REFERENCE_ARRAY"),
            Field("part_no", "INTEGER"),
            Field("l_quantity", "FLOAT"),
            Field("l_returnflag", "STRING"),
        ),
    ),
    "Document": EntitySchema(
        "Document",
        (
            Field("doc_id", "INTEGER", True),
            Field("text", "STRING"),
            Field("lang", "STRING"),
            Field("source", "STRING"),
            Field("n_chars", "INTEGER"),
        ),
    ),
}


def regions(spark, sf) -> DataFrame:
    df = table(spark, sf, "region")
    return entities_from(
        df, "Region", ref("region", "r_regionkey"), path=F.concat(F.lit("r"), F.col("r_regionkey")), organization=ORG
    )


def nations(spark, sf) -> DataFrame:
    df = table(spark, sf, "nation")
    path = F.concat(F.lit("r"), F.col("n_regionkey"), F.lit(".n"), F.col("n_nationkey"))
    props = ["n_nationkey", "n_name", ref("region", "n_regionkey").alias("region")]
    return entities_from(df, "Nation", ref("nation", "n_nationkey"), props, path=path, organization=ORG)


def _with_region(spark, sf, df: DataFrame, nation_key: str) -> DataFrame:
    """Add the region of a nation key; the nation table is small and the planner broadcasts it."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("__n"), F.col("n_regionkey").alias("__r"))
    return df.join(n, F.col(nation_key) == F.col("__n"), "left")


def customers(spark, sf, paths: bool = False) -> DataFrame:
    df, path = table(spark, sf, "customer"), None
    if paths:
        df = _with_region(spark, sf, df, "c_nationkey")
        path = F.concat(F.lit("r"), F.col("__r"), F.lit(".n"), F.col("c_nationkey"), F.lit(".c"), F.col("c_custkey"))
    name = F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    # One segment has a blank nation name and one a name that no nation has.
    nation_ref = (
        F.when(F.col("c_mktsegment") == "FURNITURE", "").when(F.col("c_mktsegment") == "MACHINERY", "ATLANTIS").otherwise(name)
    )
    props = [
        "c_custkey",
        "c_name",
        ref("nation", "c_nationkey").alias("nation"),
        nation_ref.alias("nation_ref"),
        F.col("c_custkey").alias("cust_no"),
        "c_acctbal",
        "c_mktsegment",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    ]
    return entities_from(df, "Customer", ref("customer", "c_custkey"), props, path=path, organization=ORG)


def suppliers(spark, sf, paths: bool = False) -> DataFrame:
    df, path = table(spark, sf, "supplier"), None
    if paths:
        df = _with_region(spark, sf, df, "s_nationkey")
        path = F.concat(F.lit("r"), F.col("__r"), F.lit(".n"), F.col("s_nationkey"), F.lit(".s"), F.col("s_suppkey"))
    props = ["s_suppkey", "s_name", ref("nation", "s_nationkey").alias("nation"), "s_acctbal"]
    return entities_from(df, "Supplier", ref("supplier", "s_suppkey"), props, path=path, organization=ORG)


def parts(spark, sf) -> DataFrame:
    df = table(spark, sf, "part")
    part_no = F.when(F.col("p_partkey") != 0, F.col("p_partkey")).alias("part_no")
    props = [part_no, "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return entities_from(df, "Part", ref("part", "p_partkey"), props, organization=ORG)


def orders(spark, sf) -> DataFrame:
    df = table(spark, sf, "orders")
    priority = F.col("o_orderpriority")
    note = F.when(priority == "5-LOW", "").when(priority != "4-NOT SPECIFIED", priority)
    props = [
        "o_orderkey",
        ref("customer", "o_custkey").alias("o_custkey"),
        # Leads nowhere for the upper half of the customer keys.
        ref("customer", F.col("o_custkey") * 2).alias("partner"),
        F.col("o_custkey").alias("cust_no"),
        "o_orderstatus",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
        note.alias("note"),
    ]
    return entities_from(df, "Order", ref("order", "o_orderkey"), props, created_at="o_orderdate", organization=ORG)


def lineitems(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem")
    part = ref("part", "l_partkey")
    props = [
        "l_orderkey",
        "l_linenumber",
        part.alias("part"),
        F.array(part, ref("supplier", "l_suppkey"), part).alias("refs"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("part_no"),
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
    ]
    key = F.concat(F.lit("lineitem:"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    return entities_from(df, "LineItem", key, props, created_at="l_shipdate", organization=ORG)


def documents(spark, sf) -> DataFrame:
    return entities_from(table(spark, sf, "documents"), "Document", ref("doc", "doc_id"), organization=ORG)


EVENT_JSON = (
    "concat('{\"type\":\"', event_type, '\",\"meta\":', props, ',\"tags\":[\"', event_type, '\",\"x', "
    "cast(user_id as string), '\"],\"user\":', if(event_type = 'error', concat('\"', user_id, '\"'), cast(user_id as string)), "
    "if(event_type = 'purchase', ',\"refund\":null', ''), '}')"
)


def events(spark, sf) -> DataFrame:
    """Events with a schemaless VARIANT bag: nested object, list, a number that is text in errors,
    and a key that only purchases have (as JSON null)."""
    df = table(spark, sf, "events")
    bag = F.parse_json(F.expr(EVENT_JSON))
    return entities_from(df, "Event", ref("event", "event_id"), bag, created_at="ts", organization=ORG)


BUILDERS = {
    "Region": regions,
    "Nation": nations,
    "Customer": customers,
    "Supplier": suppliers,
    "Part": parts,
    "Order": orders,
    "LineItem": lineitems,
    "Document": documents,
    "Event": events,
}


def store(spark: SparkSession, sf: str, *types: str) -> EntityStore:
    tune(spark)
    out = EntityStore(organization=ORG)
    for t in types or BUILDERS:
        out.add(t, BUILDERS[t](spark, sf), SCHEMAS.get(t))
    return out


def tree_store(spark: SparkSession, sf: str) -> EntityStore:
    """The types that sit in the region tree, with their paths."""
    out = store(spark, sf, "Region", "Nation")
    out.add("Customer", customers(spark, sf, paths=True), SCHEMAS["Customer"])
    return out.add("Supplier", suppliers(spark, sf, paths=True), SCHEMAS["Supplier"])


# --- versioned users ----------------------------------------------------------------------------

USER_BAG = ["event_type", "value", "props"]
SPLIT = "2024-01-16"


def user_versions(spark, sf) -> DataFrame:
    """Each user's events as successive images of the entity ``user:<id>``, numbered from 1."""
    from entityframe.operators import ordinal

    tune(spark)
    df = table(spark, sf, "events")
    ranked = ordinal.rank_in_group(df, ["user_id"], ["ts", "event_id"], "version", F.unix_date(F.to_date("ts")))
    return ranked.select(
        ref("user", "user_id").alias("id"),
        F.lit(ORG).alias("organization_id"),
        F.lit("schema:User").alias("schema_id"),
        F.lit("User").alias("entity_type"),
        F.concat(F.lit("u"), F.col("user_id")).alias("path"),
        F.struct(
            F.col("event_type").alias("kind"),
            F.col("value"),
            F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k")).alias("meta"),
            F.array("event_type", F.lit("seen")).alias("tags"),
        ).alias("properties"),
        F.col("version").cast("bigint").alias("version"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


def user_current_and_history(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Newest image per user as the live rows, every older one as history."""
    every = stage(user_versions(spark, sf), "users")  # a stored table in real use, read several times
    newest = every.groupBy("id").agg(F.max("version").alias("__v")).withColumnRenamed("id", "__id")
    marked = every.join(newest, F.col("id") == F.col("__id"))
    current = marked.filter(F.col("version") == F.col("__v")).drop("__id", "__v")
    past = marked.filter(F.col("version") < F.col("__v")).drop("__id", "__v")
    history = past.withColumnRenamed("id", "entity_id").select(
        "entity_id",
        "organization_id",
        "schema_id",
        "entity_type",
        "path",
        "properties",
        "created_at",
        "updated_at",
        "version",
        F.lit("UPDATE").alias("change_type"),
        F.col("updated_at").alias("changed_at"),
        F.lit("UPDATE").alias("reason"),
    )
    return current, history


def users_at_split(spark, sf) -> DataFrame:
    """Live users as of the split day: the image of the last event before it."""
    tune(spark)
    df = table(spark, sf, "events").filter(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    last = F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id"))
    first = F.min("ts")
    rows = df.groupBy("user_id").agg(last.alias("r"), first.alias("born"), F.count("*").alias("n"))
    return rows.select(
        ref("user", "user_id").alias("id"),
        F.lit(ORG).alias("organization_id"),
        F.lit("schema:User").alias("schema_id"),
        F.lit("User").alias("entity_type"),
        F.concat(F.lit("u"), F.col("user_id")).alias("path"),
        F.struct(F.col("r.event_type").alias("kind"), F.col("r.value").alias("value")).alias("properties"),
        F.col("n").alias("version"),
        F.col("born").cast("timestamp").alias("created_at"),
        F.col("r.ts").cast("timestamp").alias("updated_at"),
    )


def user_changes(spark, sf) -> DataFrame:
    """Events from the split day on as changes: an error deletes the user, anything else writes it."""
    return changes_of(table(spark, sf, "events"))


def changes_of(events: DataFrame) -> DataFrame:
    df = events.filter(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz"))
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT")
    return df.select(
        F.col("event_id").alias("seq"),
        op.alias("op"),
        ref("user", "user_id").alias("id"),
        F.lit(ORG).alias("organization_id"),
        F.lit("schema:User").alias("schema_id"),
        F.lit("User").alias("entity_type"),
        F.concat(F.lit("u"), F.col("user_id")).alias("path"),
        F.struct(F.col("event_type").alias("kind"), F.col("value")).alias("properties"),
        F.col("ts").cast("timestamp").alias("changed_at"),
        F.lit(None).cast("string").alias("reason"),
    )


# --- raw text rows ------------------------------------------------------------------------------

RAW_COLUMNS = ["user", "kind", "amount", "ok", "seen_at", "day", "empty_col"]


def raw_events(spark, sf) -> DataFrame:
    """Events as text cells with the flaws uploads have: blanks, padding, an unreadable number."""
    df = table(spark, sf, "events")
    kind = F.col("event_type")
    whole = F.floor("value")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS")
    return df.select(
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("user"),
        F.initcap(kind).alias("kind"),
        F.when(kind == "view", "").when((kind == "error") & (F.col("value") > 100), "n/a").otherwise(
            F.concat(whole.cast("string"), F.lit(".5"))
        ).alias("amount"),
        F.when(kind == "click", "Yes").when(kind == "signup", "1").otherwise("false").alias("ok"),
        stamp.alias("seen_at"),
        F.date_format(F.col("ts").cast("timestamp"), "MM/dd/yyyy").alias("day"),
        F.lit("  ").alias("empty_col"),
        (F.col("event_id") + 2).alias("row_number"),
    )


RAW_SCHEMA = EntitySchema(
    "Event Upload",
    (
        Field("user", "INTEGER", True),
        Field("kind", "STRING", True),
        Field("amount", "FLOAT", True),
        Field("ok", "BOOLEAN"),
        Field("seen_at", "TIMESTAMP"),
        Field("day", "TIMESTAMP"),
    ),
)


def raw_upload(spark, sf):
    from entityframe.sources.csv_files import raw_table

    tune(spark)
    return raw_table(raw_events(spark, sf), RAW_COLUMNS, "row_number")
