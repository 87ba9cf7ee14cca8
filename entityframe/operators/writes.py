"""Creating entities in bulk: links merged, references trimmed and unique, bags validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityframe.functions import values
from entityframe.functions.props import Bag
from entityframe.model import EntitySchema, Field, FieldType
from entityframe.operators import links, listing, validation
from entityframe.sources.tables import packed


def normalised_reference(df: DataFrame, schema: EntitySchema, strict: bool = True) -> DataFrame:
    """Trim the canonical reference. Strict mode reports a blank or non-text one in
    ``reference_error``; otherwise it is stored as it is."""
    df = packed(df)
    bag = Bag.of(df)
    none = F.lit(None).cast("string")
    name = schema.canonical_reference
    if name is None or bag.type_of(name) is None:
        return df.withColumn("reference_error", none)
    text = bag.string(name)
    error = (
        F.when(bag.is_null(name), none)
        .when(text.isNull(), F.lit(f"reference field {name} must be a string"))
        .when(F.trim(text) == "", F.lit(f"reference field {name} cannot be empty"))
    )
    if bag.is_struct:
        df = df.withColumn("properties", bag.edited(**{name: F.trim(bag.text(name))}).col)
    else:
        parts = F.try_variant_get(bag.col, "$", "map<string,variant>")
        trimmed = F.transform_values(
            parts, lambda k, v: F.when((k == name) & text.isNotNull(), F.trim(text).cast("variant")).otherwise(v)
        )
        df = df.withColumn("properties", F.to_variant_object(trimmed))
    return df.withColumn("reference_error", error if strict else none)


def check_inserts(
    new: DataFrame,
    schema: EntitySchema,
    stored: DataFrame,
    requested: Column | None = None,
    id_norm=values.uuid_norm,
) -> DataFrame:
    """New entities with every reason they may not be stored, in ``errors``.

    Requested links are merged in, the reference is trimmed, must be new to the stored entities of
    the type and may appear once in the batch (the first id keeps it), and the bag is validated.
    """
    df = packed(new)
    declared = schema
    if requested is not None:
        df = links.merge_links(df, schema, requested, id_norm)
        if schema.field("linked_ids") is None:
            declared = schema.with_field(Field("linked_ids", FieldType.ENTITY_REFERENCE_ARRAY))
    else:
        df = df.withColumn("link_error", F.lit(None).cast("string"))
    df = validation.validate(normalised_reference(df, schema), declared, id_norm).drop("warnings", "is_valid")
    taken = F.lit(None).cast("string")
    name = schema.canonical_reference
    if name is not None and Bag.of(df).type_of(name) is not None:
        clash = listing.reference_conflicts(df, stored, schema).select(F.col("id").alias("__id")).distinct()
        df = df.join(clash.withColumn("__taken", F.lit(True)), F.col("id") == F.col("__id"), "left").drop("__id")
        reference = Bag.of(df).string(name)
        first = (
            df.select("organization_id", reference.alias("__ref"), "id")
            .filter(F.col("__ref").isNotNull())
            .groupBy("organization_id", "__ref")
            .agg(F.min("id").alias("__first"))
            .withColumnRenamed("organization_id", "__org")
        )
        match = (F.col("organization_id") == F.col("__org")) & (reference == F.col("__ref"))
        df = df.join(first, match, "left")
        repeated = F.col("__first").isNotNull() & (F.col("__first") != F.col("id"))
        message = F.concat(F.lit(f'an entity of type {schema.name} already uses reference "'), F.col("__ref"), F.lit('"'))
        taken = F.when(F.coalesce("__taken", F.lit(False)) | repeated, message)
    problems = F.concat(F.array("link_error", "reference_error", taken), F.col("errors"))
    out = df.withColumn("errors", F.filter(problems, lambda e: e.isNotNull()))
    return out.drop("link_error", "reference_error", "__taken", "__first", "__org", "__ref")


def as_changes(good: DataFrame, first_seq: int = 0) -> DataFrame:
    """Accepted new entities as insert changes for ``versions.apply_changes``."""
    return good.select(
        F.lit(first_seq).cast("bigint").alias("seq"),
        F.lit("INSERT").alias("op"),
        "id",
        "organization_id",
        "schema_id",
        "entity_type",
        "path",
        "properties",
        F.current_timestamp().alias("changed_at"),
        F.lit(None).cast("string").alias("reason"),
    )
