"""Entity listing, lookups, searches and counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityframe.functions.props import Bag
from entityframe.model import EntitySchema, PropertyFilter
from entityframe.operators import ordinal, predicates, tree

DEFAULT_PAGE = 10


@dataclass(frozen=True)
class PathFilter:
    """Tree conditions for a listing; each names one path."""

    ancestors_of: str | None = None
    descendants_of: str | None = None
    children_of: str | None = None
    siblings_of: str | None = None

    def predicate(self) -> Column:
        path = F.col("path")
        tests = []
        if self.ancestors_of is not None:
            tests.append(tree.is_ancestor_of(path, self.ancestors_of))
        if self.descendants_of is not None:
            tests.append(tree.is_descendant_of(path, self.descendants_of))
        if self.children_of is not None:
            tests.append(tree.is_child_of(path, self.children_of))
        if self.siblings_of is not None:
            tests.append(tree.is_sibling_of(path, self.siblings_of))
        return predicates.all_of(tests)


@dataclass(frozen=True)
class Listing:
    """Options of one listing. ``sort`` is created_at, updated_at, entity_type, path, version or
    ``property`` (then ``sort_property`` names it)."""

    organization: str | None = None
    entity_type: str = ""
    filters: tuple[PropertyFilter, ...] = field(default=())
    text: str = ""
    path: PathFilter | None = None
    sort: str = "created_at"
    direction: str = "desc"
    sort_property: str = ""


def matching(df: DataFrame, options: Listing) -> DataFrame:
    """The entities a listing selects, unordered and unpaged."""
    bag = Bag.of(df)
    tests = []
    if options.organization is not None:
        tests.append(F.col("organization_id") == F.lit(options.organization))
    if options.entity_type.strip():
        tests.append(F.col("entity_type") == F.lit(options.entity_type.strip()))
    tests.append(predicates.listing_filters(bag, options.filters))
    tests.append(predicates.text_search(bag, options.text))
    if options.path is not None:
        tests.append(options.path.predicate())
    return df.filter(predicates.all_of(tests))


def listing_order(df: DataFrame, options: Listing) -> list[Column]:
    """Sort keys, ending in created_at descending and id so that the order is total."""
    up = options.direction.lower() == "asc"

    def way(c: Column) -> Column:
        # Nulls sort as the largest value, so they come last ascending and first descending.
        return c.asc_nulls_last() if up else c.desc_nulls_first()

    keys: list[Column] = []
    if options.sort == "property":
        text = F.lower(F.trim(F.coalesce(Bag.of(df).text(options.sort_property.strip()), F.lit(""))))
        keys += [F.when(text == "", 1).otherwise(0).asc(), way(text)]
    elif options.sort == "entity_type":
        keys.append(way(F.lower("entity_type")))
    elif options.sort in ("created_at", "updated_at", "path", "version"):
        keys.append(way(F.col(options.sort)))
    else:
        raise ValueError(f"cannot sort a listing by {options.sort!r}")
    return [*keys, F.col("created_at").desc_nulls_first(), F.col("id").asc()]


def list_entities(df: DataFrame, options: Listing, limit: int | None = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    found = matching(df, options)
    return ordinal.page(found, listing_order(found, options), limit, offset)


def total(df: DataFrame) -> DataFrame:
    """One-row exact total; it is its own job rather than a window over the page."""
    return df.agg(F.count("*").alias("total"))


def page_info(found: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """One row: the exact total and whether pages lie before and after this one."""
    counted = F.col("total")
    more = F.lit(False) if not limit else F.lit(offset + limit) < counted
    return total(found).select(
        "total", ((F.lit(offset) > 0) & (counted > 0)).alias("has_previous"), more.alias("has_next")
    )


def list_by_type(df: DataFrame, entity_type: str) -> DataFrame:
    """All entities of a type, newest first."""
    return df.filter(F.col("entity_type") == F.lit(entity_type)).orderBy(
        F.col("created_at").desc_nulls_first(), "id"
    )


def by_ids(df: DataFrame, wanted: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """Entities for requested ids in request order; an id without an entity keeps a null row.

    ``wanted`` has the columns ``pos`` and ``id``.
    """
    asked = wanted.select(F.col(pos).alias("pos"), F.col(key).alias("requested_id"))
    return asked.join(df, asked["requested_id"] == df["id"], "left").orderBy("pos")


def by_references(df: DataFrame, schema: EntitySchema, wanted: DataFrame, key: str = "reference") -> DataFrame:
    """Entities of a type whose canonical reference is among the wanted texts.

    Wanted and stored texts are trimmed, blanks dropped and repeats removed first.
    """
    field_name = schema.canonical_reference
    if field_name is None:
        raise ValueError(f"type {schema.name} declares no reference field")
    asked = (
        wanted.select(F.trim(key).alias("__ref")).filter(F.coalesce(F.col("__ref"), F.lit("")) != "").distinct()
    )
    found = df.filter(F.col("entity_type") == F.lit(schema.name))
    return found.join(asked, F.trim(Bag.of(found).text(field_name)) == asked["__ref"], "left_semi")


def reference_value(df: DataFrame, schema: EntitySchema | None) -> Column:
    """Trimmed canonical reference, or the id where it is missing, blank or not a string."""
    name = schema.canonical_reference if schema is not None else None
    if name is None:
        return F.col("id")
    return F.coalesce(F.nullif(F.trim(Bag.of(df).string(name)), F.lit("")), F.col("id"))


def search_containment(df: DataFrame, wanted: dict) -> DataFrame:
    return df.filter(predicates.contains_json(Bag.of(df), wanted))


def search_range(df: DataFrame, key: str, low: float | None = None, high: float | None = None) -> DataFrame:
    return df.filter(predicates.range_filter(Bag.of(df), key, low, high))


def search_exists(df: DataFrame, key: str) -> DataFrame:
    return df.filter(predicates.exists_filter(Bag.of(df), key))


def search_contains(df: DataFrame, key: str, term: str) -> DataFrame:
    return df.filter(predicates.contains_filter(Bag.of(df), key, term))


def count_by_organization(df: DataFrame) -> DataFrame:
    return df.groupBy("organization_id").agg(F.count("*").alias("entities"))


def count_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("organization_id", "entity_type").agg(F.count("*").alias("entities"))


def reference_duplicates(df: DataFrame, schema: EntitySchema, field_name: str | None = None) -> DataFrame:
    """References used by more than one entity of the type."""
    name = field_name or schema.canonical_reference
    if name is None:
        raise ValueError(f"type {schema.name} declares no reference field")
    reference = F.nullif(F.trim(Bag.of(df).string(name)), F.lit(""))
    return (
        df.select("organization_id", "entity_type", reference.alias("reference"), "id")
        .filter(F.col("reference").isNotNull())
        .groupBy("organization_id", "entity_type", "reference")
        .agg(F.count("*").alias("uses"), F.min("id").alias("first_id"))
        .filter(F.col("uses") > 1)
    )


def reference_conflicts(new: DataFrame, stored: DataFrame, schema: EntitySchema) -> DataFrame:
    """New entities whose reference another stored entity of the type already uses."""
    name = schema.canonical_reference
    mine = new.withColumn("__ref", F.trim(Bag.of(new).string(name)))
    theirs = stored.filter(F.col("entity_type") == F.lit(schema.name)).select(
        F.col("organization_id").alias("__org"),
        F.trim(Bag.of(stored).string(name)).alias("__theirs"),
        F.col("id").alias("__id"),
    )
    match = (
        (F.col("__ref") == F.col("__theirs"))
        & (F.col("organization_id") == F.col("__org"))
        & (F.col("id") != F.col("__id"))
    )
    return mine.join(theirs, match, "left_semi").drop("__ref")
