"""History, change application, rollback, snapshots and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityframe import tune
from entityframe.functions.props import Bag
from entityframe.operators import digests, versions
from entityframe.session import staging_path
from entityframe.streaming import jobs
from showcase import fixtures as X
from showcase.registry import query

EVERY = """
    WITH v AS (SELECT 'user:' || user_id AS id, event_type, value, CAST(props->>'k' AS BIGINT) AS k, ts,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
                      COUNT(*) OVER (PARTITION BY user_id) AS newest FROM events)
"""


@query(EVERY + "SELECT id AS entity_id, version, event_type AS kind, version = newest AS is_current FROM v")
def history_list(spark, sf):
    current, history = X.user_current_and_history(spark, sf)
    return versions.history_list(current, history).select(
        "entity_id", "version", F.col("properties.kind").alias("kind"), "is_current"
    )


@query(EVERY + "SELECT id AS entity_id, MAX(version) AS max_version FROM v WHERE version < newest GROUP BY id")
def history_max_version(spark, sf):
    return versions.max_versions(X.user_current_and_history(spark, sf)[1])


@query(
    EVERY
    + """
    SELECT id AS entity_id, version, value FROM v
    WHERE (id, version) IN (SELECT 'user:' || l_suppkey, CAST(l_quantity AS BIGINT) FROM lineitem)
    """
)
def version_lookup(spark, sf):
    """A batch of (entity, version) requests, some for versions that never were."""
    current, history = X.user_current_and_history(spark, sf)
    asked = X.table(spark, sf, "lineitem").select(
        X.ref("user", "l_suppkey").alias("entity_id"), F.col("l_quantity").cast("bigint").alias("version")
    )
    return versions.versions_at(current, history, asked).select("entity_id", "version", F.col("properties.value").alias("value"))


# Live users at the split day, then every later event as a change: an error deletes, the rest update
# (or, after a delete, bring back with the next version).
CHAIN = f"""
    WITH base AS (SELECT user_id, COUNT(*) AS v0, MIN(ts) AS born FROM events WHERE ts < TIMESTAMP '{X.SPLIT}' GROUP BY 1),
    start AS (SELECT user_id, event_type, value, ts, CAST(-1 AS BIGINT) AS seq, 'START' AS op FROM events WHERE ts < TIMESTAMP '{X.SPLIT}'
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    later AS (SELECT user_id, event_type, value, ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op
              FROM events WHERE ts >= TIMESTAMP '{X.SPLIT}'),
    chain AS (SELECT *, coalesce((SELECT v0 FROM base b WHERE b.user_id = u.user_id), 0)
                + SUM(CASE WHEN op = 'UPDATE' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS version,
              lead(op) OVER w AS next_op, lead(ts) OVER w AS next_ts
              FROM (SELECT * FROM start UNION ALL SELECT * FROM later) u WINDOW w AS (PARTITION BY user_id ORDER BY seq))
"""


@query(CHAIN + "SELECT 'user:' || user_id AS id, CAST(version AS BIGINT) AS version, event_type AS kind, value FROM chain WHERE op <> 'DELETE' AND next_op IS NULL")
def apply_changes_current(spark, sf):
    applied = versions.apply_changes(X.users_at_split(spark, sf), X.user_changes(spark, sf))
    return applied.current.select("id", "version", F.col("properties.kind").alias("kind"), F.col("properties.value").alias("value"))


def streamed(spark, sf, thirds, repeat=()):
    """Run the changes through a stream, a third of the feed (by event id) per micro-batch in the order given; ``repeat``
    names thirds that arrive a second time at the end."""
    tune(spark)
    out, marks, feed = (staging_path(spark, name) for name in ("history", "marks", "feed"))
    events = X.table(spark, sf, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    third = (high - low) // 3 + 1
    start = X.users_at_split(spark, sf)
    for at, part in enumerate((*thirds, *repeat)):
        own = F.floor((F.col("event_id") - low) / third) == part
        events.filter(own).repartitionByRange("event_id").write.parquet(f"{feed}/part={at}")
        # What has arrived by now; files of earlier parts are known to the checkpoint.
        arriving = spark.readStream.schema(events.schema).parquet(f"{feed}/part=*")
        jobs.history_stream(X.changes_of(arriving), spark, out, marks, start).awaitTermination()
    return out


NEWEST = CHAIN + "SELECT 'user:' || user_id AS id, CAST(version AS BIGINT) AS version, event_type AS kind, value FROM chain WHERE op <> 'DELETE' AND next_op IS NULL"


@query(NEWEST)
def stream_history(spark, sf):
    """The same changes arriving as a stream, a third after the other."""
    state = jobs.read_state(spark, streamed(spark, sf, (0, 1, 2)))
    return state.select("id", "version", F.col("properties.kind").alias("kind"), F.col("properties.value").alias("value"))


@query(NEWEST)
def stream_history_late(spark, sf):
    """The last third arrives before the others and a second time: the outcome is that of the order of the changes."""
    state = jobs.read_state(spark, streamed(spark, sf, (2, 0, 1), repeat=(2,)))
    return state.select("id", "version", F.col("properties.kind").alias("kind"), F.col("properties.value").alias("value"))


@query(
    CHAIN
    + """
    SELECT 'user:' || user_id AS entity_id, CAST(version AS BIGINT) AS version, next_op AS change_type, value,
           strftime(next_ts, '%Y-%m-%d %H:%M:%S') AS changed_at
    FROM chain WHERE op <> 'DELETE' AND next_op IS NOT NULL
    """
)
def stream_history_archived(spark, sf):
    """What the stream archived, with the middle third late."""
    past = jobs.read_history(spark, streamed(spark, sf, (0, 2, 1)))
    return past.select(
        "entity_id", "version", "change_type", F.col("properties.value").alias("value"), F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss").alias("changed_at")
    )


@query(
    CHAIN
    + """
    SELECT 'user:' || user_id AS entity_id, CAST(version AS BIGINT) AS version, next_op AS change_type, value,
           strftime(next_ts, '%Y-%m-%d %H:%M:%S') AS changed_at
    FROM chain WHERE op <> 'DELETE' AND next_op IS NOT NULL
    """
)
def apply_changes_history(spark, sf):
    """The same with chains cut into small slices, as a hot entity's would be."""
    applied = versions.apply_changes(X.users_at_split(spark, sf), X.user_changes(spark, sf), rows_per_chunk=64)
    return applied.archived.select(
        "entity_id", "version", "change_type", F.col("properties.value").alias("value"), F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss").alias("changed_at")
    )


@query(
    EVERY
    + """
    , asked AS (SELECT c_custkey AS seq, 'user:' || c_custkey AS id, 1 + c_nationkey AS to_version FROM customer),
    hit AS (SELECT a.id, a.to_version, v.event_type, v.value, v.newest FROM asked a JOIN v ON v.id = a.id AND v.version = a.to_version
            WHERE v.version < v.newest)
    SELECT id, CAST(newest + 1 AS BIGINT) AS version, event_type AS kind, value, true AS rolled_back FROM hit
    UNION ALL SELECT id, version, event_type, value, false FROM v WHERE version = newest AND id NOT IN (SELECT id FROM hit)
    """
)
def rollback(spark, sf):
    """Earlier images come back as new versions; requests for versions that are not archived do nothing."""
    current, history = X.user_current_and_history(spark, sf)
    asked = X.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"),
        X.ref("user", "c_custkey").alias("id"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("to_version"),
        F.lit("2024-03-01").cast("timestamp").alias("changed_at"),
        F.lit(" wrong upload ").alias("reason"),
    )
    applied = versions.rollback(current, history, asked)
    done = applied.archived.filter(F.col("reason") == "ROLLBACK: wrong upload").select(F.col("entity_id").alias("__id"))
    marked = applied.current.join(done.withColumn("__done", F.lit(True)), F.col("id") == F.col("__id"), "left")
    return marked.select(
        "id",
        "version",
        F.col("properties.kind").alias("kind"),
        F.col("properties.value").alias("value"),
        F.coalesce("__done", F.lit(False)).alias("rolled_back"),
    )


@query(
    """
    SELECT event_id, 'meta.k' AS key, CAST(props->>'k' AS VARCHAR) AS value FROM events
    UNION ALL SELECT event_id, 'type', '"' || event_type || '"' FROM events
    UNION ALL SELECT event_id, 'tags[0]', '"' || event_type || '"' FROM events
    UNION ALL SELECT event_id, 'tags[1]', '"x' || user_id || '"' FROM events
    UNION ALL SELECT event_id, 'user', CASE event_type WHEN 'error' THEN '"' || user_id || '"' ELSE CAST(user_id AS VARCHAR) END FROM events
    UNION ALL SELECT event_id, 'refund', 'null' FROM events WHERE event_type = 'purchase'
    """
)
def snapshot_flatten(spark, sf):
    """Leaves of nested schemaless bags, whatever their depth, within the row."""
    tune(spark)
    df = X.events(spark, sf).withColumn("event_id", F.regexp_replace("id", "event:", "").cast("bigint"))
    return versions.flatten(df, "event_id")


@query(
    EVERY
    + """
    , f AS (SELECT id, version, unnest([
                {'key': 'kind', 'val': '"' || event_type || '"'}, {'key': 'value', 'val': regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')},
                {'key': 'meta.k', 'val': CAST(k AS VARCHAR)}, {'key': 'tags[0]', 'val': '"' || event_type || '"'}, {'key': 'tags[1]', 'val': '"seen"'}], recursive := true) FROM v),
    d AS (SELECT *, lag(val) OVER (PARTITION BY id, key ORDER BY version) AS before FROM f)
    SELECT id AS entity_id, version, key, before AS old_value, val AS new_value, 'changed' AS change FROM d WHERE version > 1 AND val IS DISTINCT FROM before
    """
)
def snapshot_diff(spark, sf):
    """Every version against the one before, key by key."""
    every = X.user_versions(spark, sf).withColumnRenamed("id", "entity_id")
    base = every.withColumn("version", F.col("version") + 1)
    newest = every.groupBy("entity_id").agg(F.max("version").alias("__newest"))
    base = base.join(newest, "entity_id").filter(F.col("version") <= F.col("__newest")).drop("__newest")
    target = every.filter(F.col("version") > 1)
    return versions.diff(base, target, ["entity_id", "version"])


@query(
    EVERY
    + """
    SELECT id AS entity_id, version, 'Path: u' || replace(id, 'user:', '') || chr(10) || 'SchemaID: schema:User' || chr(10)
           || 'EntityType: User' || chr(10) || 'Version: ' || version || chr(10) || 'Properties:' || chr(10)
           || '  kind: "' || event_type || '"' || chr(10) || '  meta.k: ' || k || chr(10)
           || '  tags[0]: "' || event_type || '"' || chr(10) || '  tags[1]: "seen"' || chr(10)
           || '  value: ' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS lines
    FROM v
    """
)
def snapshot_canonical(spark, sf):
    every = X.user_versions(spark, sf)
    return every.select(
        F.col("id").alias("entity_id"), "version", F.array_join(versions.canonical_lines(every), "\n").alias("lines")
    )


def customer_changes(spark, sf, op):
    """A change per customer to the user of the same number."""
    return X.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"),
        op.alias("op"),
        X.ref("user", "c_custkey").alias("id"),
        F.lit(X.ORG).alias("organization_id"),
        F.lit("schema:User").alias("schema_id"),
        F.lit("User").alias("entity_type"),
        F.concat(F.lit("u"), F.col("c_custkey")).alias("path"),
        F.struct(F.lit("new").alias("kind"), F.col("c_acctbal").alias("value")).alias("properties"),
        F.lit("2024-03-01").cast("timestamp").alias("changed_at"),
        F.lit(None).cast("string").alias("reason"),
    )


AT_SPLIT = f"WITH base AS (SELECT user_id, COUNT(*) AS v0 FROM events WHERE ts < TIMESTAMP '{X.SPLIT}' GROUP BY 1)"


@query(
    AT_SPLIT
    + """
    SELECT 'user:' || user_id AS id, v0 AS version, false AS fresh FROM base
    UNION ALL SELECT 'user:' || c_custkey, 1, true FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM base)
    """
)
def apply_insert(spark, sf):
    """Inserts are stored where the entity is new and change nothing where it is there."""
    applied = versions.apply_changes(X.users_at_split(spark, sf), customer_changes(spark, sf, F.lit("INSERT")))
    return applied.current.select("id", "version", (F.col("properties.kind") == "new").alias("fresh"))


@query(
    AT_SPLIT
    + """
    SELECT c_custkey AS seq, op, CASE WHEN op = 'BOGUS' THEN 'unknown operation' WHEN op = 'INSERT' THEN 'entity already exists' ELSE 'entity not found' END AS reason
    FROM (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' ELSE 'BOGUS' END AS op,
                 c_custkey IN (SELECT user_id FROM base) AS there FROM customer)
    WHERE op = 'BOGUS' OR (op = 'INSERT' AND there) OR (op IN ('UPDATE', 'DELETE') AND NOT there)
    """
)
def apply_refused(spark, sf):
    """Changes that do not fit what is there are refused with a reason."""
    kind = F.col("c_nationkey") % 4
    op = F.when(kind == 0, "insert").when(kind == 1, "UPDATE").when(kind == 2, "DELETE").otherwise("BOGUS")
    applied = versions.apply_changes(X.users_at_split(spark, sf), customer_changes(spark, sf, op))
    return applied.refused.select("seq", "op", "reason")


@query(
    EVERY
    + """
    SELECT v.id, w.newest + 1 AS version, v.event_type AS kind FROM v JOIN (SELECT DISTINCT id, newest FROM v) w USING (id)
    WHERE v.version = 1 AND CAST(replace(v.id, 'user:', '') AS BIGINT) % 2 = 0
    UNION ALL SELECT id, version, event_type FROM v WHERE version = newest AND CAST(replace(id, 'user:', '') AS BIGINT) % 2 = 1
    """
)
def rollback_deleted(spark, sf):
    """Users that were deleted come back from their history with the version after their last."""
    current, history = X.user_current_and_history(spark, sf)
    even = F.regexp_replace("id", "user:", "").cast("bigint") % 2 == 0
    gone = current.filter(even).withColumnRenamed("id", "entity_id").withColumns(
        {"change_type": F.lit("DELETE"), "changed_at": F.col("updated_at"), "reason": F.lit("DELETE")}
    )
    past = history.unionByName(gone.select(*history.columns))
    asked = gone.select(
        F.lit(1).alias("seq"), F.col("entity_id").alias("id"), F.lit(1).alias("to_version"), F.col("changed_at"), F.lit("").alias("reason")
    )
    applied = versions.rollback(current.filter(~even), past, asked)
    return applied.current.select("id", "version", F.col("properties.kind").alias("kind"))


@query(
    """
    SELECT event_id, 'a.b' AS key, greatest('1', CAST(event_id % 3 AS VARCHAR)) AS old_value,
           greatest('1', CAST(event_id % 5 AS VARCHAR)) AS new_value, 'changed' AS change
    FROM events WHERE greatest('1', CAST(event_id % 3 AS VARCHAR)) <> greatest('1', CAST(event_id % 5 AS VARCHAR))
    """
)
def snapshot_diff_same_key(spark, sf):
    """A bag may hold a key with a dot and a nested one that reads the same: the last of the two counts."""
    tune(spark)
    bag = lambda n: F.parse_json(F.concat(F.lit('{"a.b":1,"a":{"b":'), (F.col("event_id") % n).cast("string"), F.lit("}}")))
    df = X.table(spark, sf, "events").select("event_id")
    return versions.diff(df.withColumn("properties", bag(3)), df.withColumn("properties", bag(5)), ["event_id"])


LATEST = "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(
    f"""
    WITH a AS (SELECT user_id, event_type, value FROM events WHERE ts < TIMESTAMP '{X.SPLIT}' QUALIFY {LATEST}),
    b AS (SELECT user_id, event_type, value FROM events QUALIFY {LATEST}),
    old AS (SELECT user_id, 'kind' AS key, '"' || event_type || '"' AS val FROM a UNION ALL SELECT user_id, 'value', regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') FROM a),
    new AS (SELECT user_id, 'kind' AS key, '"' || event_type || '"' AS val FROM b UNION ALL SELECT user_id, 'value', regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') FROM b)
    SELECT 'user:' || user_id AS id, key, old.val AS old_value, new.val AS new_value, CASE WHEN old.val IS NULL THEN 'added' WHEN new.val IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old FULL JOIN new USING (user_id, key) WHERE old.val IS DISTINCT FROM new.val
    """
)
def snapshot_store_diff(spark, sf):
    """The users at the split day against the users now: only entities whose digests differ are opened."""
    current, _ = X.user_current_and_history(spark, sf)
    bag = Bag.of(current)
    now = current.withColumn("properties", bag.edited(keep=("kind", "value")).col)
    return digests.Digests(X.users_at_split(spark, sf)).diff(digests.Digests(now))
