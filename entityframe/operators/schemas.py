"""Schemas: inference from text columns, reconciliation, compatibility, the registry, conforming.

A registry is a table of schema versions (``organization_id, id, name, version, status,
previous_version_id, created_at``); a field table has one row per field of a schema version
(``schema_id, ordinal, field_name, field_type, required, reference_entity_type``).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import coerce
from entityframe.functions.props import Bag, quoted
from entityframe.functions.values import as_variant
from entityframe.model import SPARK_TYPES, EntitySchema, Field, FieldType
from entityframe.sources.tables import packed

MAJOR, MINOR, PATCH = "MAJOR", "MINOR", "PATCH"

# --- inference ----------------------------------------------------------------------------------

TESTS = {
    "is_bool": coerce.IS_BOOL,
    "is_int": coerce.IS_INT,
    "is_float": coerce.IS_FLOAT,
    "is_timestamp": coerce.IS_TIMESTAMP,
}


def profile_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """What a profile needs of some rows: ``ordinal, name, rows, full, kinds`` per text column, which merge by sums and by
    the bits all cells share.

    Each cell is classified once; a column takes two aggregates, and all share one pass of the data.
    """
    cells = df.select(*[F.trim(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)])
    marks = cells.select(
        *[F.when(F.col(f"c{i}") != "", coerce.kinds(F.col(f"c{i}"))).alias(f"k{i}") for i in range(len(columns))]
    )
    aggs = []
    for i in range(len(columns)):
        aggs += [F.count(f"k{i}").alias(f"full{i}"), F.bit_and(f"k{i}").alias(f"kinds{i}")]
    totals = marks.agg(F.count("*").alias("rows"), *aggs)
    lines = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("name"), "rows", F.col(f"full{i}").alias("full"), F.col(f"kinds{i}").alias("kinds"))
        for i, name in enumerate(columns)
    ]
    return totals.select(F.inline(F.array(*lines)))


def profile_of(state: DataFrame) -> DataFrame:
    """One row per text column: which types fit every non-blank cell, and how full it is."""
    full, fits = F.col("full"), F.coalesce("kinds", F.lit(0))
    return state.select(
        "ordinal",
        "name",
        *[(fits.bitwiseAND(bit) != 0).alias(t) for t, bit in TESTS.items()],
        ((full == F.col("rows")) & (full > 0)).alias("all_present"),
        full.alias("values"),
    )


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return profile_of(profile_state(df, columns))


class ProfileLog:
    """Profiles of files that keep arriving: the states of all files lie in ``folder``, one per file and column.

    Appending reads the new file alone. A column is told apart by its name without case; one that a file lacks is blank in
    all of its rows. Columns keep the order in which they first appeared, by the time of the append and then their place.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, file: str, df: DataFrame, columns: list[str]) -> None:
        """Profile a file's rows; a file that is appended again replaces its own state."""
        # The folder's name is a hash, whatever characters the file's name has.
        state = profile_state(df, columns).withColumns({"file": F.lit(file), "at": F.unix_micros(F.current_timestamp())})
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state={hashlib.sha256(file.encode()).hexdigest()[:32]}")

    def state(self) -> DataFrame:
        states = self.spark.read.parquet(self.folder)
        total = states.groupBy("file").agg(F.max("rows").alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        first = F.min(F.struct("at", "ordinal", "name"))
        merged = states.groupBy(F.lower("name").alias("key")).agg(first.alias("first"), F.sum("full").alias("full"), F.bit_and("kinds").alias("kinds"))
        # One row per column of the files; their order is that of the fields of a schema.
        order = Window.orderBy("first.at", "first.ordinal", "key")
        place = (F.row_number().over(order) - 1).alias("ordinal")
        return merged.select(place, F.col("first.name").alias("name"), F.lit(total).cast("bigint").alias("rows"), "full", "kinds")

    def profile(self) -> DataFrame:
        """As ``profile`` of all files' rows together."""
        return profile_of(self.state())


def infer(df: DataFrame, columns: list[str], overrides: dict[str, str] | None = None) -> DataFrame:
    """Field table of text columns: boolean, integer, float, timestamp, else string; a column
    without blanks is required. Overrides win over what was detected."""
    return inferred(profile(df, columns), overrides)


def inferred(profiled: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """The field table that follows from a profile."""
    detected = (
        F.when(F.col("is_bool"), FieldType.BOOLEAN.value)
        .when(F.col("is_int"), FieldType.INTEGER.value)
        .when(F.col("is_float"), FieldType.FLOAT.value)
        .when(F.col("is_timestamp"), FieldType.TIMESTAMP.value)
        .otherwise(FieldType.STRING.value)
    )
    effective = F.lit(None).cast("string")
    for name, kind in (overrides or {}).items():
        effective = F.when(F.col("name") == name, FieldType.parse(kind).value).otherwise(effective)
    return profiled.select(
        "ordinal",
        F.col("name").alias("field_name"),
        detected.alias("detected_type"),
        F.coalesce(effective, detected).alias("field_type"),
        F.col("all_present").alias("required"),
        effective.isNotNull().alias("overridden"),
    )


def fields_of(table: DataFrame) -> list[Field]:
    """Read a small field table (one row per column of a file) into definitions."""
    rows = table.orderBy("ordinal").collect()
    return [Field(r["field_name"], r["field_type"], bool(r["required"])) for r in rows]


# --- reconciliation -----------------------------------------------------------------------------


def compatible(existing: FieldType, detected: FieldType) -> bool:
    return existing is detected or (existing is FieldType.FLOAT and detected is FieldType.INTEGER)


def field_of(schema: EntitySchema, name: str) -> Field | None:
    """A field by its name, case aside, as columns are told apart; the exact spelling goes first."""
    return schema.field(name) or next((f for f in schema.fields if f.name.casefold() == name.casefold()), None)


@dataclass(frozen=True)
class SchemaChange:
    field: str
    message: str
    existing_type: str = ""
    detected_type: str = ""


@dataclass(frozen=True)
class Reconciled:
    schema: EntitySchema
    new_fields: tuple[str, ...]
    changes: tuple[SchemaChange, ...]
    updated: bool


def reconcile(existing: EntitySchema, detected: list[Field]) -> Reconciled:
    """Extend a schema by what a file holds: new fields are added, clashing types reported and
    kept, and a field becomes required when the file has it in every row. Names compare without case."""
    schema, added, changes, updated = existing, [], [], False
    for d in detected:
        have = field_of(schema, d.name)
        if have is None:
            schema, updated = schema.with_field(d), True
            added.append(d.name)
            continue
        if not compatible(have.type, d.type):
            # Fixed value: the wording users of the upload log know.
            message = f"field {d.name} type mismatch: existing={have.type.value}, detected={d.type.value}"
            changes.append(SchemaChange(d.name, message, have.type.value, d.type.value))
        if d.required and not have.required:
            schema, updated = schema.with_field(replace(have, required=True)), True
            changes.append(SchemaChange(d.name, "promoted to required based on data inference"))
    if updated:
        level = compatibility(existing.fields, schema.fields)
        schema = replace(schema, version=bump(existing.version, level))
        changes.append(SchemaChange("", f"schema {schema.name} updated to version {schema.version} ({level})"))
    return Reconciled(schema, tuple(added), tuple(changes), updated)


def reconcile_fields(existing: DataFrame, detected: DataFrame) -> DataFrame:
    """The same comparison for field tables of any size: one row per field that would change."""
    have = existing.select(
        F.lower("field_name").alias("__key"),
        F.col("field_type").alias("existing_type"),
        F.col("required").alias("__required"),
        F.lit(True).alias("__have"),
    )
    found = detected.select(
        F.lower("field_name").alias("__key"),
        "field_name",
        F.col("field_type").alias("detected_type"),
        F.col("required").alias("__now"),
    )
    fits = (F.col("existing_type") == F.col("detected_type")) | (
        (F.col("existing_type") == "FLOAT") & (F.col("detected_type") == "INTEGER")
    )
    both = found.join(have, "__key", "left")
    new = F.col("__have").isNull()
    return both.select(
        "field_name",
        "existing_type",
        "detected_type",
        new.alias("is_new"),
        (~new & ~fits).alias("type_conflict"),
        (~new & F.col("__now") & ~F.col("__required")).alias("promoted"),
    ).filter("is_new OR type_conflict OR promoted")


# --- compatibility ------------------------------------------------------------------------------


def compatibility(old: tuple[Field, ...], new: tuple[Field, ...]) -> str:
    """Change level between two field lists; names compare without case."""
    before, after = {f.name.lower(): f for f in old}, {f.name.lower(): f for f in new}
    level = PATCH
    for key in before.keys() | after.keys():
        a, b = before.get(key), after.get(key)
        if b is None:
            return MAJOR
        if a is None:
            if b.required:
                return MAJOR
            level = MINOR
            continue
        if a.type is not b.type or a.reference_entity_type.lower() != b.reference_entity_type.lower():
            return MAJOR
        if b.required and not a.required:
            return MAJOR
        if a.required and not b.required:
            level = MINOR
    return level


def bump(version: str, level: str) -> str:
    parts = (version or "1.0.0").split(".")
    if len(parts) != 3 or not all(p.isdigit() for p in parts):
        raise ValueError(f"invalid version format: {version}")
    major, minor, patch = map(int, parts)
    if level == MAJOR:
        return f"{major + 1}.0.0"
    if level == MINOR:
        return f"{major}.{minor + 1}.0"
    return f"{major}.{minor}.{patch + 1}"


def next_version(version: Column, level: Column) -> Column:
    """``bump`` as a Column; null for a version that is not three numbers."""
    current = F.when(F.coalesce(version, F.lit("")) == "", F.lit("1.0.0")).otherwise(version)
    part = [F.split(current, r"\.").getItem(i).try_cast("int") for i in range(3)]
    text = (
        F.when(level == MAJOR, F.concat((part[0] + 1).cast("string"), F.lit(".0.0")))
        .when(level == MINOR, F.concat(part[0].cast("string"), F.lit("."), (part[1] + 1).cast("string"), F.lit(".0")))
        .otherwise(F.concat_ws(".", part[0].cast("string"), part[1].cast("string"), (part[2] + 1).cast("string")))
    )
    return F.when(current.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), text)


def compatibility_levels(versions: DataFrame, fields: DataFrame) -> DataFrame:
    """Change level of every schema version against the one before it.

    ``versions`` has ``id`` and ``previous_version_id``. The fields of both sides meet in one
    full-outer join on (version, lower-case name).
    """
    last = F.max_by(
        F.struct(F.upper("field_type").alias("type"), "required", F.lower(F.coalesce("reference_entity_type", F.lit(""))).alias("ref")),
        "ordinal",
    )
    unique = fields.groupBy("schema_id", F.lower("field_name").alias("__key")).agg(last.alias("__f"))
    pairs = versions.filter(F.col("previous_version_id").isNotNull()).select("id", "previous_version_id")
    new = pairs.join(unique, F.col("id") == F.col("schema_id")).select("id", "__key", F.col("__f").alias("new"))
    old = pairs.join(unique, F.col("previous_version_id") == F.col("schema_id")).select("id", "__key", F.col("__f").alias("old"))
    both = old.join(new, ["id", "__key"], "full_outer")
    gone, fresh = F.col("new").isNull(), F.col("old").isNull()
    severity = (
        F.when(gone, 2)
        .when(fresh, F.when(F.col("new.required"), 2).otherwise(1))
        .when((F.col("old.type") != F.col("new.type")) | (F.col("old.ref") != F.col("new.ref")), 2)
        .when(~F.col("old.required") & F.col("new.required"), 2)
        .when(F.col("old.required") & ~F.col("new.required"), 1)
        .otherwise(0)
    )
    worst = both.groupBy("id").agg(F.max(severity).alias("__s"))
    level = F.when(F.col("__s") == 2, MAJOR).when(F.col("__s") == 1, MINOR).otherwise(PATCH)
    return pairs.join(worst, "id", "left").select("id", "previous_version_id", level.alias("level"))


# --- registry -----------------------------------------------------------------------------------


def latest(registry: DataFrame) -> DataFrame:
    """Newest schema version per organization and name that is not archived."""
    names = registry.columns
    row = F.struct(*names)
    live = registry.filter(F.col("status") != "ARCHIVED")
    return live.groupBy("organization_id", "name").agg(F.max_by(row, F.struct("created_at", "id")).alias("r")).select("r.*")


def versions_of(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.col("name") == F.lit(name)).orderBy(F.col("created_at").desc(), F.col("id").desc())


def version_of(registry: DataFrame, name: str, version: str) -> DataFrame:
    return registry.filter((F.col("name") == F.lit(name)) & (F.col("version") == F.lit(version)))


def by_id(registry: DataFrame, schema_id: str) -> DataFrame:
    return registry.filter(F.col("id") == F.lit(schema_id))


def exists(registry: DataFrame, name: str) -> DataFrame:
    return registry.agg(F.coalesce(F.bool_or(F.col("name") == F.lit(name)), F.lit(False)).alias("exists"))


def publish(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Append new versions; the versions they follow are archived, so one per name stays active."""
    names = new.select(F.col("organization_id").alias("__org"), F.col("name").alias("__name")).distinct()
    match = (F.col("organization_id") == F.col("__org")) & (F.col("name") == F.col("__name"))
    kept = registry.join(names.withColumn("__hit", F.lit(True)), match, "left")
    status = F.when(F.col("__hit") & (F.col("status") == "ACTIVE"), F.lit("ARCHIVED")).otherwise(F.col("status"))
    return kept.withColumn("status", status).drop("__org", "__name", "__hit").unionByName(new)


def archive(registry: DataFrame, schema_id: str) -> DataFrame:
    """Deleting a schema archives it in place; its versions stay listed."""
    status = F.when(F.col("id") == F.lit(schema_id), F.lit("ARCHIVED")).otherwise(F.col("status"))
    return registry.withColumn("status", status)


# --- conforming data ----------------------------------------------------------------------------


def conform(df: DataFrame, schema: EntitySchema) -> DataFrame:
    """Entities with bags in the shape of ``schema``: fields cast, absent ones null, others dropped.

    A value that does not fit the declared type becomes null; the stored rows are not touched.
    """
    df = packed(df)
    bag = Bag.of(df)
    cols = []
    for f in schema.struct_type().fields:
        have = bag.type_of(f.name)
        declared = schema.field(f.name).type
        if have is None:
            value = F.lit(None).cast(f.dataType)
        elif have == f.dataType:
            value = bag.value(f.name)
        elif isinstance(f.dataType, T.StringType):
            value = bag.text(f.name)
        elif isinstance(f.dataType, T.ArrayType):
            value = bag.raw_items(f.name)
        elif isinstance(f.dataType, T.VariantType):
            value = F.try_parse_json(bag.text(f.name)) if isinstance(have, T.StringType) else as_variant(bag.value(f.name), have)
        elif isinstance(have, (T.StringType, T.VariantType)):
            value = coerce.value(F.nullif(F.trim(bag.text(f.name)), F.lit("")), declared)
        else:
            value = bag.value(f.name).try_cast(f.dataType)
        cols.append(value.alias(f.name))
    return df.withColumn("properties", F.struct(*cols))


def cell_type(kind: FieldType) -> T.DataType:
    """Spark type of a coerced file cell; kinds without a text form keep the text."""
    if kind in (FieldType.GEOMETRY, FieldType.TIMESERIES, FieldType.ENTITY_REFERENCE_ARRAY):
        return T.StringType()
    return SPARK_TYPES[kind]
