"""Versioned entities: applying changes, history, time travel, rollback and key-level diffs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityframe.functions.props import Bag
from entityframe.model import COLUMNS
from entityframe.operators import ordinal
from entityframe.session import stage
from entityframe.sources.tables import packed

IMAGE = ("organization_id", "schema_id", "entity_type", "path", "properties")
HISTORY = (
    "entity_id",
    *IMAGE,
    "created_at",
    "updated_at",
    "version",
    "change_type",
    "changed_at",
    "reason",
)
INSERT, UPDATE, UPSERT, DELETE, ROLLBACK = "INSERT", "UPDATE", "UPSERT", "DELETE", "ROLLBACK"


def max_versions(history: DataFrame) -> DataFrame:
    """Highest archived version per entity; an entity without history counts as 0 where joined."""
    return history.groupBy("entity_id").agg(F.max("version").alias("max_version"))


class Applied:
    """Outcome of a batch of changes: the new current rows, the rows to append to history, and the
    changes that were refused (``seq, id, op, reason``)."""

    def __init__(self, current: DataFrame, archived: DataFrame, refused: DataFrame | None = None):
        self.current = current
        self.archived = archived
        self.refused = refused


def _settles() -> Column:
    """Whether an entity is there after a change, where the change tells: an insert, upsert or rollback leaves it there, a
    delete leaves it gone, whether or not they were refused; an update settles nothing."""
    op = F.col("op")
    return F.when(op.isin("START", INSERT, UPSERT, ROLLBACK), F.lit(True)).when(op == DELETE, F.lit(False))


def _refusal() -> Column:
    """Why a change cannot be applied, null if it can, from ``__there`` before it."""
    op, there = F.col("op"), F.coalesce("__there", F.lit(False))
    return (
        F.when(~F.coalesce(op.isin("START", INSERT, UPDATE, UPSERT, DELETE, ROLLBACK), F.lit(False)), F.lit("unknown operation"))
        .when((op == INSERT) & there, F.lit("entity already exists"))
        .when(op.isin(UPDATE, DELETE) & ~there, F.lit("entity not found"))
    )


def _counts() -> Column:
    return F.col("__refused").isNull()


def _adds() -> Column:
    return F.when(_counts() & ~F.col("op").isin("START", DELETE), 1).otherwise(0).cast("bigint")


def _short_chains(rows: DataFrame) -> DataFrame:
    """Number and link the chains of entities with a bounded number of changes: all in one shuffle by id."""
    by = Window.partitionBy("id").orderBy("seq")
    told = rows.withColumn("__there", F.last(_settles(), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    checked = told.withColumn("__refused", _refusal()).drop("__there").withColumn("__counts", _counts())
    numbered = checked.withColumn("__added", F.sum(_adds()).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # Among the changes that count, the next one is what ends an image.
    valid = Window.partitionBy("id", "__counts")
    after = valid.orderBy("seq")
    ends = {f"__{name}": F.lead(c).over(after) for name, c in (("op", F.col("op")), ("at", F.col("changed_at")), ("reason", F.col("reason")), ("id", F.col("id")))}
    linked = numbered.withColumns(ends)
    return linked.withColumns(_bases(lambda c: c.over(valid))).drop("__counts")


def _bases(over: Callable[[Column], Column] = lambda c: c) -> dict[str, Column]:
    """Where a chain starts: the live version, and when the entity was first created."""
    began = F.min(F.when(F.col("op") != "START", F.col("changed_at")))
    born = F.coalesce(*[over(c) for c in (F.max("__created"), F.min("original_created_at"), began)])
    return {"__base_live": over(F.max("__live")), "__born": born}


def _long_chains(rows: DataFrame, sliced: Column) -> DataFrame:
    """The same where one entity may take most of the changes: within bounded slices of ``seq``, carried over by joins."""
    told = ordinal.last_before(rows, ["id"], "seq", _settles(), "__there", sliced)
    checked = told.withColumn("__refused", _refusal()).drop("__there")
    totals = {"__n": F.when(_counts(), 1).otherwise(0).cast("bigint"), "__added": _adds()}
    chain = stage(ordinal.running_totals(checked, ["id"], ["seq"], totals, sliced), "chain")
    valid = chain.filter(_counts())
    base = valid.groupBy("id").agg(*[c.alias(n) for n, c in _bases().items()])
    ending = valid.select(
        F.col("id").alias("__id"),
        (F.col("__n") - 1).alias("__ends"),
        F.col("op").alias("__op"),
        F.col("changed_at").alias("__at"),
        F.col("reason").alias("__reason"),
    )
    linked = valid.join(base, "id").join(ending, (F.col("id") == F.col("__id")) & (F.col("__n") == F.col("__ends")), "left")
    return linked.drop("__n", "__ends").unionByName(chain.filter(~_counts()).drop("__n"), allowMissingColumns=True)


def _chains(rows: DataFrame, changes: DataFrame, sliced: Column, longest: int) -> DataFrame:
    """Only entities with more than ``longest`` changes, of which there are few, are worked out in slices."""
    hot = stage(changes.groupBy("id").agg(F.count("*").alias("__n")).filter(F.col("__n") > longest).select("id"), "hot-entities")
    if hot.isEmpty():
        return _short_chains(rows)
    cut = _long_chains(rows.join(hot, "id", "left_semi"), sliced)
    return _short_chains(rows.join(hot, "id", "left_anti")).unionByName(cut)


def apply_changes(
    current: DataFrame,
    changes: DataFrame,
    history: DataFrame | None = None,
    chunk: Column | None = None,
    rows_per_chunk: int | None = None,
) -> Applied:
    """Apply inserts, updates, upserts, deletes and rollbacks in the order of ``seq``.

    ``changes`` has the columns ``seq`` (total per entity), ``op``, ``id``, the whole new image
    (``organization_id`` … ``properties``; null for a delete), ``changed_at`` and ``reason``, and
    optionally ``original_created_at``. Several changes to one entity form a chain: every image
    that is replaced or deleted is archived under the change that ended it, and each new image
    takes the next version.

    An INSERT of an entity that is there, an UPDATE or DELETE of one that is not (never was, or is
    deleted by then), and an unknown op are refused and change nothing. An UPSERT writes either way;
    it, an INSERT or a ROLLBACK brings a deleted entity back, which then continues from its highest
    archived version.

    The chains of touched entities are written once to the shared folder with their numbers; both
    outcomes are read from there. Chains of at most ``ordinal.ROWS_PER_CHUNK`` changes are worked out in one shuffle by id.
    Longer ones are numbered by running sums over slices of ``seq`` and linked by an equi-join on (id, number), so one
    entity may take most of the changes. With ``chunk`` or ``rows_per_chunk`` all chains are cut so, unless the numbers of
    all changes lie within ``rows_per_chunk``.
    """
    current = packed(current)
    stamped = changes if "original_created_at" in changes.columns else changes.withColumn(
        "original_created_at", F.lit(None).cast("timestamp")
    )
    incoming = stamped.select(
        "id",
        F.upper("op").alias("op"),
        F.col("seq").cast("bigint").alias("seq"),
        *IMAGE,
        F.col("changed_at").cast("timestamp").alias("changed_at"),
        "reason",
        "original_created_at",
        F.lit(None).cast("bigint").alias("__live"),
        F.lit(None).cast("timestamp").alias("__created"),
    )
    ids = incoming.select("id").distinct()
    starts = current.join(ids, "id", "left_semi").select(
        "id",
        F.lit("START").alias("op"),
        F.lit(-(2**62)).cast("bigint").alias("seq"),
        *IMAGE,
        F.col("updated_at").alias("changed_at"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("timestamp").alias("original_created_at"),
        F.col("version").cast("bigint").alias("__live"),
        F.col("created_at").alias("__created"),
    )
    # A sequence number occurs once per entity, so a slice of the numbers bounds its rows, and numbers that lie within
    # one slice bound every chain.
    rows = starts.unionByName(incoming)
    size = ordinal.ROWS_PER_CHUNK if rows_per_chunk is None else rows_per_chunk
    sliced = F.floor(F.col("seq") / size) if chunk is None else chunk
    low, high = incoming.agg(F.min("seq"), F.max("seq")).first()
    if chunk is None and (low is None or high - low < size):
        chain = _short_chains(rows)
    elif chunk is None and rows_per_chunk is None:
        chain = _chains(rows, incoming, sliced, size)
    else:
        chain = _long_chains(rows, sliced)
    chain = stage(chain, "linked-chain")

    images = chain.filter(F.col("__refused").isNull() & (F.col("op") != DELETE))
    if history is not None:
        past = max_versions(history).select(F.col("entity_id").alias("id"), F.col("max_version").alias("__past"))
        images = images.join(past, "id", "left")
    else:
        images = images.withColumn("__past", F.lit(None).cast("bigint"))
    version = F.coalesce("__base_live", "__past", F.lit(0)) + F.col("__added")
    images = images.drop("__live", "__created").withColumns({"version": version, "created_at": F.col("__born")})
    standing = images.withColumnRenamed("changed_at", "updated_at")

    survivors = standing.filter(F.col("__id").isNull()).select(*COLUMNS)
    untouched = current.join(ids, "id", "left_anti").select(*COLUMNS)
    kind = F.when(F.col("__op").isin(DELETE, ROLLBACK), F.col("__op")).otherwise(UPDATE)
    archived = standing.filter(F.col("__id").isNotNull()).select(
        F.col("id").alias("entity_id"),
        *IMAGE,
        "created_at",
        "updated_at",
        "version",
        kind.alias("change_type"),
        F.col("__at").alias("changed_at"),
        F.coalesce(F.nullif("__reason", F.lit("")), kind).alias("reason"),
    )
    refused = chain.filter(F.col("__refused").isNotNull()).select("seq", "id", "op", F.col("__refused").alias("reason"))
    return Applied(untouched.unionByName(survivors), archived, refused)


def rollback_changes(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Turn rollback requests (``seq, id, to_version, changed_at, reason``) into changes.

    The image comes from history; a request for a version that is not there yields nothing.
    """
    past = history.select(
        F.col("entity_id").alias("__id"),
        F.col("version").alias("__version"),
        *IMAGE,
        F.col("created_at").alias("original_created_at"),
    )
    text = F.trim(F.coalesce("reason", F.lit("")))
    reason = F.when(text == "", F.lit(ROLLBACK)).otherwise(F.concat(F.lit(f"{ROLLBACK}: "), text))
    found = requests.join(past, (F.col("id") == F.col("__id")) & (F.col("to_version") == F.col("__version")))
    return found.select(
        "seq", F.lit(ROLLBACK).alias("op"), "id", *IMAGE, "changed_at", reason.alias("reason"), "original_created_at"
    )


def rollback(current: DataFrame, history: DataFrame, requests: DataFrame) -> Applied:
    """Restore earlier images as new versions, of live and of deleted entities alike."""
    return apply_changes(current, rollback_changes(requests, history), history)


def snapshots(current: DataFrame, history: DataFrame) -> DataFrame:
    """Every known version of every entity; the live row stands in for its own version."""
    current = packed(current)
    live = current.select(F.col("id").alias("entity_id"), *IMAGE, "version", F.lit(True).alias("is_current"))
    gone = history.select("entity_id", *IMAGE, "version", F.lit(False).alias("is_current"))
    marks = current.select(F.col("id").alias("__id"), F.col("version").alias("__version"))
    past = gone.join(marks, (F.col("entity_id") == F.col("__id")) & (F.col("version") == F.col("__version")), "left_anti")
    return live.unionByName(past)


def history_list(current: DataFrame, history: DataFrame) -> DataFrame:
    """Versions per entity, the current one first, then newest to oldest."""
    return snapshots(current, history).orderBy("entity_id", F.col("is_current").desc(), F.col("version").desc())


def versions_at(current: DataFrame, history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images for (``entity_id``, ``version``) requests; what never existed yields no row."""
    asked = wanted.select(F.col("entity_id").alias("__id"), F.col("version").alias("__version")).distinct()
    return snapshots(current, history).join(
        asked, (F.col("entity_id") == F.col("__id")) & (F.col("version") == F.col("__version")), "left_semi"
    )


def _leaves(df: DataFrame) -> Column:
    """Leaves sorted by key; of those whose flattened keys collide (``"a.b"`` and a nested ``b``) the last stays."""
    at_end = lambda every: lambda x, i: ~F.coalesce(F.get(every, i + 1)["key"] == x["key"], F.lit(False))
    kept = F.transform(F.array(F.sort_array(Bag.of(df).leaves())), lambda every: F.filter(every, at_end(every)))
    return kept[0]


def flatten(df: DataFrame, *keep: str) -> DataFrame:
    """One row per property leaf: ``key`` like ``a.b`` or ``a[0]`` and its JSON-encoded ``value``."""
    return df.select(*keep, F.inline(Bag.of(df).leaves()))


def diff(base: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Key-level differences of two snapshot frames paired on ``on``: added, removed, changed.

    A pair meets in one equi-join; the keys are then compared within the row. A side that is
    missing counts as empty.
    """

    def leaves(df: DataFrame, name: str) -> DataFrame:
        return df.select(*on, F.map_from_entries(_leaves(df)).alias(name))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = leaves(base, "__old").join(leaves(target, "__new"), on, "full_outer")
    old, new = F.coalesce("__old", none), F.coalesce("__new", none)
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    rows = both.select(*on, old.alias("__old"), new.alias("__new"), F.explode(keys).alias("key"))
    before, after = F.element_at("__old", F.col("key")), F.element_at("__new", F.col("key"))
    change = F.when(before.isNull(), "added").when(after.isNull(), "removed").otherwise("changed")
    return (
        rows.select(*on, "key", before.alias("old_value"), after.alias("new_value"), change.alias("change"))
        .filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    )


def canonical_lines(df: DataFrame) -> Column:
    """A snapshot as deterministic text lines, built within the row."""
    leaves = _leaves(df)
    lines = F.transform(leaves, lambda x: F.concat(F.lit("  "), x.key, F.lit(": "), x.value))
    head = F.array(
        F.concat(F.lit("Path: "), F.coalesce("path", F.lit(""))),
        F.concat(F.lit("SchemaID: "), F.coalesce("schema_id", F.lit(""))),
        F.concat(F.lit("EntityType: "), F.col("entity_type")),
        F.concat(F.lit("Version: "), F.col("version").cast("string")),
        F.lit("Properties:"),
    )
    return F.concat(head, F.when(F.size(leaves) == 0, F.array(F.lit("  (empty)"))).otherwise(lines))
