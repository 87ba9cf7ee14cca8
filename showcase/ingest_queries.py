"""Ingestion, validation, schema, export and streaming queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from entityframe import EntitySchema, Field, PropertyFilter, tune
from entityframe.functions import coerce
from entityframe.functions.props import Bag
from entityframe.operators import listing, ordinal, schemas, validation
from entityframe.session import staging_path
from entityframe.sources import export, ingest
from entityframe.sources.csv_files import raw_table, read_csv
from entityframe.sources.stored import StoredEntities
from entityframe.streaming import jobs
from showcase import dag_queries as D
from showcase import fixtures as X
from showcase.registry import query

# The raw text rows of fixtures.raw_events, in SQL.
RAW = """
    WITH raw AS (
      SELECT ' ' || user_id AS "user", upper(event_type[1]) || event_type[2:] AS kind,
             CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'error' AND value > 100 THEN 'n/a'
                  ELSE CAST(floor(value) AS BIGINT) || '.5' END AS amount,
             CASE event_type WHEN 'click' THEN 'Yes' WHEN 'signup' THEN '1' ELSE 'false' END AS ok,
             strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(microsecond(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') AS seen_at,
             strftime(ts, '%m/%d/%Y') AS day, event_id + 2 AS row_number, user_id, event_type, value, ts
      FROM events),
    good AS (SELECT * FROM raw WHERE amount NOT IN ('', 'n/a'))
"""

# --- profiling and inference --------------------------------------------------------------------


PROFILE = (
    RAW
    + """
    SELECT 'user' AS name, false AS is_bool, bool_and(try_cast(trim("user") AS BIGINT) IS NOT NULL) AS is_int, true AS is_float,
           false AS is_timestamp, true AS all_present, COUNT(*) AS "values" FROM raw
    UNION ALL SELECT 'kind', false, false, false, false, true, COUNT(*) FROM raw
    UNION ALL SELECT 'amount', false, false, bool_and(amount IN ('') OR try_cast(amount AS DOUBLE) IS NOT NULL), false,
           bool_and(amount <> ''), COUNT(*) FILTER (amount <> '') FROM raw
    UNION ALL SELECT 'ok', bool_and(lower(ok) IN ('true', 'false', 'yes', 'no', '1', '0')), false, false, false, true, COUNT(*) FROM raw
    UNION ALL SELECT 'seen_at', false, false, false, bool_and(try_cast(seen_at AS TIMESTAMP) IS NOT NULL), true, COUNT(*) FROM raw
    UNION ALL SELECT 'day', false, false, false, bool_and(try_strptime(day, '%m/%d/%Y') IS NOT NULL), true, COUNT(*) FROM raw
    UNION ALL SELECT 'empty_col', false, false, false, false, false, 0 FROM raw WHERE row_number = 2
    """
)


@query(PROFILE)
def ingest_profile(spark, sf):
    raw = X.raw_upload(spark, sf)
    return schemas.profile(raw.texts(), raw.columns).drop("ordinal")


@query(PROFILE)
def ingest_profile_appended(spark, sf):
    """The rows arrive in four files, each profiled alone; the merged profile is that of all."""
    raw = X.raw_upload(spark, sf)
    low, high = raw.df.agg(F.min("row_number"), F.max("row_number")).first()
    log = schemas.ProfileLog(spark, staging_path(spark, "profiles"))
    for part in range(4):
        own = replace(raw, df=raw.df.filter(F.floor((F.col("row_number") - low) * 4 / (high - low + 1)) == part))
        log.append(f"part {part}", own.texts(), raw.columns)
    return log.profile().drop("ordinal")


@query(
    RAW
    + """
    , t AS (SELECT bool_and(amount = '' OR try_cast(amount AS DOUBLE) IS NOT NULL) AS f,
                   bool_and(try_cast(seen_at AS TIMESTAMP) IS NOT NULL) AS s FROM raw)
    SELECT 'user' AS field_name, 'INTEGER' AS detected_type, 'STRING' AS field_type, true AS required, true AS overridden FROM t
    UNION ALL SELECT 'kind', 'STRING', 'STRING', true, false FROM t
    UNION ALL SELECT 'amount', CASE WHEN f THEN 'FLOAT' ELSE 'STRING' END, CASE WHEN f THEN 'FLOAT' ELSE 'STRING' END, false, false FROM t
    UNION ALL SELECT 'ok', 'BOOLEAN', 'BOOLEAN', true, false FROM t
    UNION ALL SELECT 'seen_at', CASE WHEN s THEN 'TIMESTAMP' ELSE 'STRING' END, CASE WHEN s THEN 'TIMESTAMP' ELSE 'STRING' END, true, false FROM t
    UNION ALL SELECT 'day', 'TIMESTAMP', 'TIMESTAMP', true, false FROM t
    UNION ALL SELECT 'empty_col', 'STRING', 'STRING', false, false FROM t
    """
)
def ingest_infer_schema(spark, sf):
    raw = X.raw_upload(spark, sf)
    return schemas.infer(raw.texts(), raw.columns, {"user": "string"}).drop("ordinal")


@query(
    RAW
    + """
    SELECT row_number, user_id, kind, try_cast(nullif(amount, '') AS DOUBLE) AS amount,
           lower(ok) IN ('yes', '1') AS ok, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
           CASE WHEN amount = 'n/a' THEN 'field amount: unable to coerce "n/a" to float' END AS error
    FROM raw
    """
)
def ingest_coerce(spark, sf):
    rows = ingest.coerced(X.raw_upload(spark, sf), X.RAW_SCHEMA)
    p = "properties"
    return rows.select(
        "row_number",
        F.col(f"{p}.user").alias("user_id"),
        f"{p}.kind",
        f"{p}.amount",
        f"{p}.ok",
        F.date_format(f"{p}.day", "yyyy-MM-dd").alias("day"),
        F.col("coerce_error").alias("error"),
    )


@query(
    """
    SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, o_totalprice AS number,
           o_orderpriority = '1-URGENT' AS flag, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
           CAST(NULL AS BIGINT) AS bad_whole, CAST(NULL AS DOUBLE) AS bad_number
    FROM orders
    """
)
def ingest_cell_forms(spark, sf):
    """Spellings a cell may have: exponents, signs, letters, slashed dates, zoned times."""
    tune(spark)
    df = X.table(spark, sf, "orders")
    price, status, when = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp")
    whole = F.floor(price).cast("string")
    number = F.when(status == "F", F.concat(whole, F.lit("e0"))).when(status == "O", F.concat(F.lit("+"), whole)).otherwise(
        F.concat(whole, F.lit(".0"))
    )
    flag = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" Y ")).otherwise("F")
    day = (
        F.when(status == "F", F.date_format(when, "yyyy/MM/dd"))
        .when(status == "O", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .otherwise(F.date_format(when, "yyyy.MM.dd"))
    )
    return df.select(
        "o_orderkey",
        coerce.to_integer(number).alias("whole"),
        coerce.to_float(price.cast("decimal(18,2)").cast("string")).alias("number"),
        coerce.to_boolean(flag).alias("flag"),
        F.date_format(coerce.to_timestamp(day), "yyyy-MM-dd").alias("day"),
        coerce.to_integer(F.concat(whole, F.lit(".25"))).alias("bad_whole"),
        coerce.to_float(F.concat(whole, F.lit("d"))).alias("bad_number"),
    )


# --- the row job --------------------------------------------------------------------------------


def upload(spark, sf) -> ingest.Ingest:
    return ingest.Ingest(X.raw_upload(spark, sf), X.RAW_SCHEMA, X.ORG, "events.csv")


@query(RAW + "SELECT row_number, user_id, kind, CAST(amount AS DOUBLE) AS amount, lower(ok) IN ('yes', '1') AS ok FROM good")
def ingest_valid_rows(spark, sf):
    rows = upload(spark, sf).rows().filter(F.col("error").isNull())
    p = "properties"
    return rows.select("row_number", F.col(f"{p}.user").alias("user_id"), f"{p}.kind", f"{p}.amount", f"{p}.ok")


@query(
    RAW
    + """
    SELECT row_number, CASE amount WHEN '' THEN 'amount: required field ''amount'' is missing'
             ELSE 'field amount: unable to coerce "n/a" to float' END AS error_message,
           'org-1' AS organization_id, 'Event Upload' AS schema_name, 'events.csv' AS file_name
    FROM raw WHERE amount IN ('', 'n/a')
    """
)
def ingest_rejects(spark, sf):
    return upload(spark, sf).rejects()


@query(
    RAW
    + """
    , n AS (SELECT row_number, user_id, row_number() OVER (PARTITION BY user_id ORDER BY row_number) AS nth FROM good)
    SELECT row_number, 'event_upload.n' || user_id || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS path FROM n
    """
)
def ingest_paths(spark, sf):
    """Paths from the first cell; the n-th of one path in file order is numbered."""
    return upload(spark, sf).valid().select("row_number", "path")


@query(RAW + "SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (amount NOT IN ('', 'n/a')) AS valid_rows, COUNT(*) FILTER (amount IN ('', 'n/a')) AS invalid_rows FROM raw")
def ingest_summary(spark, sf):
    return upload(spark, sf).summary()


@query(
    RAW
    + """
    SELECT row_number, trim("user") AS "user", kind, amount, ok, seen_at, day, '' AS empty_col,
           CASE amount WHEN '' THEN 'amount: required field ''amount'' is missing'
             WHEN 'n/a' THEN 'field amount: unable to coerce "n/a" to float' END AS error
    FROM raw ORDER BY row_number LIMIT 10
    """
)
def ingest_preview(spark, sf):
    """The first ten rows with their errors; nothing is written."""
    return upload(spark, sf).preview().select("row_number", "values.*", "error")


@query(
    """
    SELECT 'order_file.' || lower(CASE o_orderpriority WHEN '1-URGENT' THEN 'n1_urgent' WHEN '2-HIGH' THEN 'n2_high' WHEN '3-MEDIUM' THEN 'n3_medium'
             WHEN '4-NOT SPECIFIED' THEN 'n4_not_specified' ELSE 'n5_low' END)
             || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS path,
           o_orderkey, price, fresh FROM (
      SELECT o_orderkey, o_orderpriority, floor(o_totalprice) AS price, o_orderstatus = 'O' AS fresh,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth FROM orders)
    """
)
def ingest_csv(spark, sf):
    """CSV files end to end: read as text, profiled, coerced, validated, named."""
    tune(spark)
    raw = read_csv(spark, order_files(spark, sf))
    job = ingest.plan(raw, "Order File", organization=X.ORG, overrides={"Total_Price": "float"}).ingest
    p = "properties"
    return job.valid().select("path", F.col(f"{p}.key").alias("o_orderkey"), F.col(f"{p}.Total_Price").alias("price"), f"{p}.fresh")


_order_files: dict[tuple[str, str], str] = {}


def order_files(spark, sf) -> str:
    """The upload: orders as CSV files that follow each other by key, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _order_files:
        return _order_files[key]
    df = X.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("Order Priority"),
        F.col("o_orderkey").cast("string").alias("key"),
        F.floor("o_totalprice").cast("string").alias("Total-Price"),
        F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no").alias("fresh"),
        F.lit("a, \"quoted\" cell").alias("note.text"),
    )
    folder = _order_files[key] = staging_path(spark, "upload")
    df.orderBy(F.col("key").cast("bigint")).write.option("header", True).option("escape", '"').csv(folder)
    return folder


@query(
    """
    SELECT COUNT(*) AS total_batches, COUNT(*) FILTER (o_orderstatus = 'O') AS in_progress_batches,
           COUNT(*) FILTER (o_orderstatus = 'F') AS completed_batches, COUNT(*) FILTER (o_orderstatus = 'P') AS failed_batches,
           CAST(SUM(o_custkey) AS BIGINT) AS total_rows_staged,
           CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END) AS BIGINT) AS total_rows_flushed
    FROM orders
    """
)
def batch_stats(spark, sf):
    """Orders read as a batch manifest."""
    tune(spark)
    return ingest.batch_stats(manifest(spark, sf))


def manifest(spark, sf):
    status = F.col("o_orderstatus")
    return X.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("batch_id"),
        F.col("o_orderdate").cast("timestamp").alias("enqueued_at"),
        F.col("o_custkey").alias("rows_staged"),
        F.when(status == "F", F.col("o_custkey")).otherwise(0).alias("rows_flushed"),
        F.when(status == "F", "COMPLETED")
        .when(status == "P", "FAILED")
        .when(F.col("o_orderpriority") == "1-URGENT", "FLUSHING")
        .otherwise("PENDING")
        .alias("status"),
    )


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, 'FAILED' AS status, o_custkey AS rows_staged FROM orders
    WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20 OFFSET 40
    """
)
def batch_list(spark, sf):
    tune(spark)
    return ingest.batches(manifest(spark, sf), ["FAILED"], 20, 40).select("batch_id", "status", "rows_staged")


# --- validation ---------------------------------------------------------------------------------

CHECKED = EntitySchema(
    "Event",
    (
        Field("type", "STRING", True),
        Field("user", "INTEGER", True, validation='{"min": 20, "max": 120}'),
        Field("meta", "JSON"),
        Field("note", "STRING", True),
        Field("tags", "STRING"),
    ),
)


@query(
    """
    SELECT event_id, 'note: required field ''note'' is missing; tags: field ''tags'' must be a string, got []interface {}'
           || CASE WHEN event_type = 'purchase' THEN '; refund: property ''refund'' is not defined in schema' ELSE '' END AS errors,
           false AS is_valid
    FROM events
    """
)
def validate_errors(spark, sf):
    """Required, type and undeclared-property errors on schemaless bags."""
    tune(spark)
    out = validation.validate(X.events(spark, sf), CHECKED)
    return out.select(
        F.regexp_replace("id", "event:", "").cast("bigint").alias("event_id"), F.array_join("errors", "; ").alias("errors"), "is_valid"
    )


@query(
    """
    SELECT 'part:' || p_partkey AS id,
      concat_ws('; ',
        CASE WHEN p_size < 10 THEN 'p_size: field ''p_size'' value ' || p_size || ' is less than minimum 10'
             WHEN p_size > 40 THEN 'p_size: field ''p_size'' value ' || p_size || ' is greater than maximum 40' END,
        CASE WHEN length(p_name) > 9 THEN 'p_name: field ''p_name'' length ' || length(p_name) || ' is greater than maximum 9'
             WHEN NOT contains(lower(p_name), 'red') THEN 'p_name: field ''p_name'' value ''' || p_name || ''' does not match pattern ''RED''' END
      ) AS warnings
    FROM part
    """
)
def validate_warnings(spark, sf):
    """Custom rules warn, the first broken one per field."""
    tune(spark)
    rules = EntitySchema(
        "Part",
        (
            Field("part_no", "INTEGER"),
            Field("p_size", "INTEGER", validation='{"min": 10, "max": 40}'),
            Field("p_name", "REFERENCE", validation='{"max_length": 9, "pattern": "RED"}'),
            Field("p_brand"),
            Field("p_type"),
            Field("p_retailprice", "FLOAT"),
        ),
    )
    out = validation.validate(X.parts(spark, sf), rules)
    return out.select("id", F.array_join("warnings", "; ").alias("warnings"))


@query(
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'Field ''user'' must be an integer, got string; ' ELSE '' END
             || 'Required field ''note'' is missing; Field ''tags'' must be a string, got []interface {}' AS errors,
           CASE event_type WHEN 'purchase' THEN 'Property ''refund'' is not defined in schema' ELSE '' END AS warnings
    FROM events
    """
)
def validate_audit(spark, sf):
    """Stored entities against the latest schema: undeclared properties only warn."""
    tune(spark)
    out = validation.audit(X.events(spark, sf), CHECKED)
    return out.select(
        F.regexp_replace("id", "event:", "").cast("bigint").alias("event_id"),
        F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query("SELECT 'order:' || o_orderkey AS id, o_orderpriority NOT IN ('4-NOT SPECIFIED') AS is_valid FROM orders")
def validate_required(spark, sf):
    """The write gate: only required-ness."""
    tune(spark)
    gate = EntitySchema("Order", (Field("note", "STRING", True), Field("o_orderkey", "INTEGER", True)))
    return validation.validate(X.orders(spark, sf), gate, required_only=True).select("id", "is_valid")


# --- schemas ------------------------------------------------------------------------------------

# Every customer is a schema name, every order one of its versions, every order line a field of it.
REGISTRY = """
    WITH registry AS (
      SELECT o_orderkey AS id, 'schema_' || o_custkey AS name, o_orderdate AS created_at,
             CASE WHEN o_orderstatus = 'P' THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status,
             lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous
      FROM orders)
"""


def registry(spark, sf):
    tune(spark)
    return X.table(spark, sf, "orders").select(
        F.lit(X.ORG).alias("organization_id"),
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("schema_"), F.col("o_custkey")).alias("name"),
        F.concat_ws(".", F.lit("1"), F.dayofmonth("o_orderdate"), F.month("o_orderdate")).alias("version"),
        F.when(F.col("o_orderstatus") == "P", "ARCHIVED").otherwise("ACTIVE").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


@query(
    REGISTRY
    + """
    SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, id DESC) AS n
                          FROM registry WHERE status <> 'ARCHIVED') WHERE n = 1
    """
)
def schema_latest(spark, sf):
    return schemas.latest(registry(spark, sf)).select("name", "id")


@query(REGISTRY + "SELECT id, status, strftime(created_at, '%Y-%m-%d') AS day FROM registry WHERE name = 'schema_77'")
def schema_versions(spark, sf):
    found = schemas.versions_of(registry(spark, sf), "schema_77")
    return found.select("id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(
    REGISTRY
    + """
    SELECT id, CASE WHEN name IN (SELECT 'schema_' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND status = 'ACTIVE'
                    THEN 'ARCHIVED' ELSE status END AS status FROM registry
    UNION ALL SELECT -c_custkey - 1, 'ACTIVE' FROM customer WHERE c_mktsegment = 'BUILDING'
    """
)
def schema_publish(spark, sf):
    """New versions archive the active ones of their names."""
    new = X.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.lit(X.ORG).alias("organization_id"),
        (-F.col("c_custkey") - 1).alias("id"),
        F.concat(F.lit("schema_"), F.col("c_custkey")).alias("name"),
        F.lit("9.0.0").alias("version"),
        F.lit("ACTIVE").alias("status"),
        F.lit("2030-01-01").cast("timestamp").alias("created_at"),
    )
    return schemas.publish(registry(spark, sf), new).select("id", "status")


FIELDS = """
    , fields AS (
      SELECT l_orderkey AS schema_id, 'f' || l_linenumber AS k, max(l_returnflag) AS type, bool_or(l_linestatus = 'F') AS required
      FROM lineitem GROUP BY ALL)
"""


@query(
    REGISTRY
    + FIELDS
    + """
    , pairs AS (SELECT id, previous FROM registry WHERE previous IS NOT NULL),
    o AS (SELECT id, k, type, required FROM pairs JOIN fields ON schema_id = previous),
    n AS (SELECT id, k, type, required FROM pairs JOIN fields ON schema_id = id),
    s AS (SELECT coalesce(o.id, n.id) AS id, max(CASE WHEN n.k IS NULL THEN 2 WHEN o.k IS NULL THEN CASE WHEN n.required THEN 2 ELSE 1 END
            WHEN o.type <> n.type THEN 2 WHEN NOT o.required AND n.required THEN 2
            WHEN o.required AND NOT n.required THEN 1 ELSE 0 END) AS severity
          FROM o FULL JOIN n ON o.id = n.id AND o.k = n.k GROUP BY 1)
    SELECT pairs.id, CASE coalesce(severity, 0) WHEN 2 THEN 'MAJOR' WHEN 1 THEN 'MINOR' ELSE 'PATCH' END AS level,
           CASE coalesce(severity, 0) WHEN 2 THEN '3.0.0' WHEN 1 THEN '2.5.0' ELSE '2.4.10' END AS next_version
    FROM pairs LEFT JOIN s USING (id)
    """
)
def schema_compatibility(spark, sf):
    """Change level of every version against the one before, and the version number that follows."""
    reg = registry(spark, sf).withColumn("place", F.struct("created_at", "id"))
    month = F.date_trunc("month", "created_at")
    versions = ordinal.last_before(reg, ["name"], "place", F.col("id"), "previous_version_id", month)
    lines = X.table(spark, sf, "lineitem")
    fields = lines.groupBy(F.col("l_orderkey").alias("schema_id"), F.col("l_linenumber").alias("ordinal")).agg(
        F.max("l_returnflag").alias("field_type"), F.bool_or(F.col("l_linestatus") == "F").alias("required")
    )
    fields = fields.withColumn("field_name", F.concat(F.lit("F"), F.col("ordinal"))).withColumn("reference_entity_type", F.lit(""))
    found = schemas.compatibility_levels(versions, fields)
    return found.select("id", "level", schemas.next_version(F.lit("2.4.9"), F.col("level")).alias("next_version"))


@query(
    """
    WITH n AS (SELECT bool_and(o_totalprice = floor(o_totalprice)) AS whole, bool_and(o_orderstatus <> 'P') AS full_status FROM orders)
    SELECT 'amount' AS field_name, 'INTEGER' AS existing_type, CASE WHEN whole THEN 'INTEGER' ELSE 'FLOAT' END AS detected_type,
           false AS is_new, NOT whole AS type_conflict, false AS promoted FROM n WHERE NOT whole
    UNION ALL SELECT 'Priority', 'STRING', 'STRING', false, false, true FROM n
    UNION ALL SELECT 'extra', CAST(NULL AS VARCHAR), 'TIMESTAMP', true, false, false FROM n
    """
)
def schema_reconcile(spark, sf):
    """What an upload would change in the schema an earlier upload left."""
    tune(spark)
    df = X.table(spark, sf, "orders")
    before = df.select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.floor("o_totalprice").cast("string").alias("amount"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"),
    )
    after = df.select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.col("o_orderpriority").alias("Priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("extra"),
    )
    return schemas.reconcile_fields(schemas.infer(before, before.columns), schemas.infer(after, after.columns))


@query(
    """
    SELECT event_id, event_type AS type, CASE WHEN event_type <> 'error' THEN user_id ELSE user_id END AS "user",
           CAST(NULL AS DOUBLE) AS score, event_type || '|x' || user_id AS tags
    FROM events
    """
)
def schema_conform(spark, sf):
    """Schemaless bags brought into the shape of a new schema: cast, filled, dropped."""
    tune(spark)
    shape = EntitySchema(
        "Event", (Field("type"), Field("user", "INTEGER"), Field("score", "FLOAT"), Field("tags", "ENTITY_REFERENCE_ARRAY"))
    )
    out = schemas.conform(X.events(spark, sf), shape)
    p = "properties"
    return out.select(
        F.regexp_replace("id", "event:", "").cast("bigint").alias("event_id"),
        f"{p}.type",
        f"{p}.user",
        f"{p}.score",
        F.array_join(f"{p}.tags", "|").alias("tags"),
    )


# --- export and streaming -----------------------------------------------------------------------


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'customer:' || o_custkey AS o_custkey, 'customer:' || (o_custkey * 2) AS partner,
           o_orderstatus, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate, o_orderpriority,
           CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN '' ELSE o_orderpriority END AS note,
           CAST(o_custkey AS VARCHAR) AS cust_no
    FROM orders WHERE o_orderpriority ILIKE '%e%'
    """
)
def export_entity_rows(spark, sf):
    """A type written as CSV and read back."""
    tune(spark)
    rows = export.type_rows(X.orders(spark, sf), X.SCHEMAS["Order"], (PropertyFilter("o_orderpriority", "E"),))
    folder = staging_path(spark, "export")
    export.write_csv(rows, folder)
    return export.read_back(spark, folder, rows.columns)


@query(
    """
    SELECT 'customer:' || c_custkey AS row_customer, coalesce(CAST(o_orderkey AS VARCHAR), '') AS row_order,
           coalesce(regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', ''), '') AS row_price
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    """
)
def export_dag_rows(spark, sf):
    """A transformation result written as CSV and read back; a missing entity gives empty cells."""
    nodes = (
        D.Load("a", (), "c", "Customer"),
        D.Load("b", (), "o", "Order", D.URGENT),
        D.LeftJoin("j", ("a", "b"), "c", "o", "cust_no"),
        D.Materialize("m", ("j",), (D.output("row", ("c", "id", "customer"), ("o", "o_orderkey", "order"), ("o", "o_totalprice", "price")),)),
    )
    rows = export.result_rows(D.run(spark, sf, nodes, ("Customer", "Order")), separator="_")
    folder = staging_path(spark, "export")
    export.write_csv(rows, folder)
    return export.read_back(spark, folder, rows.columns)


STREAMED = EntitySchema("Streamed Event", (Field("user", "INTEGER", True), Field("kind", "STRING", True), Field("value", "FLOAT", True)))


@query(
    """
    SELECT 'streamed_event.n' || user_id || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS path, user_id AS "user", event_type AS kind, value
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type <> 'error')
    """
)
def stream_ingest(spark, sf):
    """Files picked up by a stream, ingested batch by batch, and read back."""
    tune(spark)
    shape = spark.read.parquet(f"{sf}/events.parquet").schema
    arriving = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, marks = staging_path(spark, "stream"), staging_path(spark, "marks")

    def as_raw(batch):
        text = batch.select(
            F.col("user_id").cast("string").alias("user"),
            F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("kind"),
            F.col("value").cast("string").alias("value"),
            "event_id",
        )
        return raw_table(text, ["user", "kind", "value"], "event_id")

    jobs.ingest_stream(arriving, [], "", STREAMED, out, marks, X.ORG, shape=as_raw).awaitTermination()
    stored = jobs.read_entities(spark, out)
    bag = Bag.of(stored)
    return stored.select("path", bag.typed("user", "bigint").alias("user"), bag.text("kind").alias("kind"), bag.number("value").alias("value"))


def written(spark, sf) -> str:
    """Run the whole ingest job of the raw events into a new folder."""
    out = staging_path(spark, "written")
    upload(spark, sf).write(f"{out}/entities", f"{out}/rejects", f"{out}/manifest", batch_id="b1")
    return out


@query(
    RAW
    + """
    , n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_number) AS nth FROM good)
    SELECT 'Event Upload' AS entity_type, 'event_upload.n' || user_id || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS path,
           CAST(amount AS DOUBLE) AS amount, kind FROM n
    """
)
def ingest_append(spark, sf):
    """Entities appended as one batch, partitioned by type, and loaded from the store."""
    out = written(spark, sf)
    stored = StoredEntities(spark, f"{out}/entities", f"{out}/manifest", X.ORG).store().load("Event Upload")
    bag = Bag.of(stored)
    return stored.select("entity_type", "path", bag.number("amount").alias("amount"), bag.text("kind").alias("kind"))


@query(
    RAW
    + """
    SELECT row_number, 'events.csv' AS file_name FROM raw WHERE amount IN ('', 'n/a') ORDER BY row_number LIMIT 200
    """
)
def ingest_reject_log(spark, sf):
    """The first page of the reject log of one file."""
    log = spark.read.parquet(f"{written(spark, sf)}/rejects")
    return ingest.reject_log(log, X.ORG, "Event Upload", "events.csv").select("row_number", "file_name")


@query(
    RAW
    + """
    SELECT 'COMPLETED' AS status, COUNT(*) FILTER (amount NOT IN ('', 'n/a')) AS rows_flushed, COUNT(*) FILTER (amount IN ('', 'n/a')) AS rows_rejected
    FROM raw
    """
)
def ingest_manifest(spark, sf):
    """The manifest row a batch leaves, with counts observed while it was written."""
    return spark.read.parquet(f"{written(spark, sf)}/manifest").select("status", "rows_flushed", "rows_rejected")


# --- the job's records of itself ----------------------------------------------------------------

UPLOAD_SCHEMA = EntitySchema("Order Upload", (Field("key", "INTEGER", True), Field("status", "BOOLEAN")))


def order_upload(spark, sf):
    rows = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        (F.col("o_orderkey") + 2).alias("row_number"),
    )
    return raw_table(rows, ["key", "status", "price"], "row_number")


@query(
    """
    SELECT 'Order Upload' AS name, '1.0.0' AS version, 'ARCHIVED' AS status FROM (SELECT COUNT(*) AS n FROM orders) WHERE n > 0
    UNION ALL SELECT 'Order Upload', '2.0.0', 'ACTIVE' FROM (SELECT COUNT(*) AS n FROM orders) WHERE n > 0
    """
)
def ingest_schema_version(spark, sf):
    """The schema an upload settles on follows the one before it in the registry."""
    tune(spark)
    first = ingest.Plan(ingest.Ingest(order_upload(spark, sf), UPLOAD_SCHEMA, X.ORG), True, [], (), ())
    registry = first.schema_row()
    plan = ingest.plan(order_upload(spark, sf), "Order Upload", UPLOAD_SCHEMA, organization=X.ORG)
    return schemas.publish(registry, plan.schema_row()).select("name", "version", "status")


@query(
    """
    SELECT 'Order Upload' AS schema_name, 'orders.csv' AS file_name, CAST(NULL AS BIGINT) AS row_number,
           'field status type mismatch: existing=BOOLEAN, detected=STRING' AS error_message
    FROM (SELECT COUNT(*) AS n FROM orders) WHERE n > 0
    """
)
def ingest_conflict_log(spark, sf):
    """What the file holds against the schema, logged against the file."""
    tune(spark)
    plan = ingest.plan(order_upload(spark, sf), "Order Upload", UPLOAD_SCHEMA, organization=X.ORG, file_name="orders.csv")
    found = plan.ingest.log().filter("row_number is null")
    return found.select("schema_name", "file_name", "row_number", "error_message")


class BreaksOff(ingest.Ingest):
    """A job that fails while the rejects are written, when its entities are there already."""

    def log(self):
        failed = F.when(F.col("row_number").isNull(), F.raise_error(F.lit("upload broke off")))
        return super().log().withColumn("error_message", F.coalesce(failed.cast("string"), "error_message"))


def broken_upload(spark, sf, out, batch):
    tune(spark)
    fields = EntitySchema("Order Upload", (Field("key", "INTEGER", True), Field("price", "FLOAT")))
    job = BreaksOff(order_upload(spark, sf), fields, X.ORG, "orders.csv", notes=("a note on the file",))
    try:
        job.write(f"{out}/entities", f"{out}/rejects", f"{out}/manifest", batch_id=batch)
    except Exception as error:  # noqa: BLE001
        if "upload broke off" not in str(error):
            raise


@query(
    """
    SELECT 'b9' AS batch_id, 'FAILED' AS status, CAST(0 AS BIGINT) AS rows_staged, true AS told, n AS on_disk, CAST(0 AS BIGINT) AS shown
    FROM (SELECT COUNT(*) AS n FROM orders) WHERE n > 0
    """
)
def ingest_failed_batch(spark, sf):
    """A batch that breaks off after its entities were written leaves its state and the reason, and shows no entity."""
    out = staging_path(spark, "failed")
    broken_upload(spark, sf, out, "b9")
    found = spark.read.parquet(f"{out}/manifest")
    shown = StoredEntities(spark, f"{out}/entities", f"{out}/manifest").mixed()
    there = spark.read.parquet(f"{out}/entities").agg(F.count("*").alias("on_disk")).withColumn("of", F.lit("b9"))
    counts = there.join(shown.agg(F.count("*").alias("shown")).withColumn("of", F.lit("b9")), "of")
    told = found.select("batch_id", "status", "rows_staged", F.col("error_message").contains("upload broke off").alias("told"))
    return told.join(counts, F.col("batch_id") == F.col("of")).drop("of")


@query("SELECT o_orderkey AS key, CAST(o_totalprice AS DOUBLE) AS price FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def ingest_committed_range(spark, sf):
    """A batch that is written again and breaks off still shows its first rows; a range search on a typed column of theirs."""
    out = staging_path(spark, "again")
    fields = EntitySchema("Order Upload", (Field("key", "INTEGER", True), Field("price", "FLOAT")))
    tune(spark)
    ingest.Ingest(order_upload(spark, sf), fields, X.ORG, "orders.csv").write(f"{out}/entities", f"{out}/rejects", f"{out}/manifest", batch_id="b1")
    for batch in ("b1", "b2"):
        broken_upload(spark, sf, out, batch)
    store = StoredEntities(spark, f"{out}/entities", f"{out}/manifest", X.ORG).store([fields])
    found = listing.search_range(store.load("Order Upload"), "price", 100_000, 150_000)
    bag = Bag.of(found)
    return found.select(bag.value("key").alias("key"), bag.value("price").alias("price"))


@query("SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def stored_containment(spark, sf):
    """Containment on an ingested store reads the typed columns of its keys."""
    tune(spark)
    out = staging_path(spark, "contained")
    text = X.table(spark, sf, "customer").select(
        *[F.col(c).cast("string").alias(n) for c, n in (("c_custkey", "no"), ("c_name", "name"), ("c_mktsegment", "segment"), ("c_nationkey", "nation"))], (F.col("c_custkey") + 1).alias("row_number")
    )
    fields = EntitySchema("Client", (Field("no", "INTEGER", True), Field("name"), Field("segment"), Field("nation", "INTEGER")))
    job = ingest.Ingest(raw_table(text, ["no", "name", "segment", "nation"], "row_number"), fields, X.ORG, "clients.csv")
    job.write(f"{out}/entities", f"{out}/rejects", f"{out}/manifest", batch_id="b1")
    store = StoredEntities(spark, f"{out}/entities", f"{out}/manifest", X.ORG).store([fields])
    found = listing.search_containment(store.load("Client"), {"segment": "BUILDING", "nation": 7})
    bag = Bag.of(found)
    return found.select(F.concat(F.lit("customer:"), bag.text("no")).alias("id"), bag.text("name").alias("name"))


@query("SELECT COUNT(*) AS entities, COUNT(*) AS ids FROM events")
def ingest_unique_ids(spark, sf):
    """Names that collide with the suffix of other names (x, x, x_2) share paths, but never ids."""
    tune(spark)
    label = F.when(F.col("event_id") % 3 == 2, "x_2").otherwise("x")
    raw = raw_table(X.table(spark, sf, "events").select(label.alias("label"), "event_id"), ["label"], "event_id")
    stored = ingest.Ingest(raw, EntitySchema("Label", (Field("label"),)), X.ORG).entities("b1")
    return stored.agg(F.count("*").alias("entities"), F.countDistinct("id").alias("ids"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS state, o_orderpriority AS state_2 FROM orders")
def ingest_late_header(spark, sf):
    """Files by key range, each with its header behind 1100 records of blank cells and two labels that differ by case only."""
    tune(spark)
    orders = X.table(spark, sf, "orders")
    low, high, n = orders.agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count("*")).first()
    files = max(4, n // 50_000)
    part = F.floor((F.col("o_orderkey") - low) * files / (high - low + 1)).cast("int")
    rows = orders.select(part.alias("part"), (F.col("o_orderkey") - low + 2000).alias("at"), F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("value"))
    at = (F.col("id") % 1101).alias("at")
    heads = spark.range(files * 1101).select(F.floor(F.col("id") / 1101).cast("int").alias("part"), at, F.when(at < 1100, " , ,").otherwise("Key,State,STATE").alias("value"))
    folder = staging_path(spark, "late")
    placed = heads.unionByName(rows).repartition("part").sortWithinPartitions("part", "at").select("part", "value")
    placed.write.partitionBy("part").text(folder)
    raw = read_csv(spark, folder)
    chosen = read_csv(spark, folder, header_row=1100)
    if chosen.columns != raw.columns:
        raise AssertionError("the chosen header is the one that is found")
    return raw.texts().select(F.col("Key").alias("key"), F.col("State").alias("state"), F.col("STATE_2").alias("state_2"))
