"""Links between entities: the link table, its resolution, what dangles, and merging on write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import values
from entityframe.functions.props import Bag
from entityframe.model import EntitySchema, FieldType
from entityframe.session import stage
from entityframe.sources.tables import packed

# Property names that hold links without being declared, compared without case.
LINKED_NAMES = (
    "linked_ids",
    "linkedIds",
    "linked_entities",
    "linkedEntities",
    "linked_entity_id",
    "linkedEntityId",
    "linked_entity_ids",
    "linkedEntityIds",
)
_LINKED = {n.lower() for n in LINKED_NAMES}
_LINK = "array<struct<by:string,target_type:string,key:string>>"


def _link_texts(bag: Bag, key: str) -> Column:
    """Trimmed, non-blank texts of a string or a list of strings; other values hold no links."""
    dtype = bag.type_of(key)
    if isinstance(dtype, T.StringType):
        texts = F.array(bag.value(key))
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        texts = bag.value(key)
    elif isinstance(dtype, T.VariantType):
        items = F.filter(
            F.try_variant_get(bag.value(key), "$", "array<variant>"), lambda x: values.variant_is(x, "STRING")
        )
        texts = F.when(
            values.variant_is(bag.value(key), "ARRAY"),
            F.transform(items, lambda x: F.try_variant_get(x, "$", "string")),
        ).otherwise(F.array(bag.string(key)))
    else:
        return F.array().cast("array<string>")
    trimmed = F.transform(texts, lambda x: F.trim(x))
    kept = F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def _link_maker(target: str, by_text: bool, id_norm):
    """How one link text of a field reads: by id where it is one, else by reference to the target."""

    def link(text: Column) -> Column:
        reference = F.struct(F.lit("reference").alias("by"), F.lit(target).alias("target_type"), text.alias("key"))
        if by_text:
            return reference
        key = id_norm(text)
        by_id = F.when(
            key.isNotNull(), F.struct(F.lit("id").alias("by"), F.lit(target).alias("target_type"), key.alias("key"))
        )
        return by_id.otherwise(reference) if target else by_id

    return link


def link_table(df: DataFrame, schema: EntitySchema | None, id_norm=values.uuid_norm) -> DataFrame:
    """One row per distinct link of each entity of one type.

    A declared field links by id where its value is one; reference fields, and fields with a target
    type, also link by reference text. The well-known undeclared names target the entity's own type.
    Links are found and deduplicated within the row.
    """
    bag = Bag.of(df)
    declared = {f.name.lower(): f for f in schema.fields} if schema is not None else {}
    names = bag.names() or [*(f.name for f in schema.fields if schema), *(n for n in LINKED_NAMES if n.lower() not in declared)]
    parts = []
    for name in names:
        found = declared.get(name.lower())
        if found is None and name.lower() not in _LINKED:
            continue
        target = found.reference_entity_type.strip() if found is not None else (schema.name if schema else "")
        by_text = found is not None and found.type is FieldType.REFERENCE

        if by_text and not target:
            continue
        make = _link_maker(target, by_text, id_norm)
        if isinstance(bag.type_of(name), T.StringType):  # the usual single text needs no list work
            text = F.trim(bag.value(name))
            parts.append(F.array(F.when(text != "", make(text))).cast(_LINK))
        else:
            parts.append(F.transform(_link_texts(bag, name), make).cast(_LINK))
    parent = df.select(
        F.col("organization_id"),
        F.col("id").alias("parent_id"),
        F.col("entity_type").alias("parent_type"),
        (F.concat(*parts) if parts else F.array().cast(_LINK)).alias("__links"),
    )
    distinct = F.array_except(F.col("__links"), F.array(F.lit(None)).cast(_LINK))
    return parent.select("organization_id", "parent_id", "parent_type", F.inline(distinct))


def _reference_targets(store) -> DataFrame | None:
    """(org, type, canonical reference text, id) of every entity that has one."""
    parts = []
    for name, schema in store.schemas.items():
        if schema.canonical_reference is None:
            continue
        df = store.load(name)
        text = F.nullif(F.trim(Bag.of(df).string(schema.canonical_reference)), F.lit(""))
        parts.append(
            df.select(
                F.col("organization_id").alias("__org"),
                F.col("entity_type").alias("child_type"),
                F.lower("entity_type").alias("__type"),
                text.alias("__ref"),
                F.col("id").alias("child_id"),
            ).filter(F.col("__ref").isNotNull())
        )
    return reduce(DataFrame.unionByName, parts) if parts else None


def resolve(links: DataFrame, store) -> DataFrame:
    """Links that lead somewhere, with the child each one reaches."""
    targets = store.envelopes().select(F.col("id").alias("child_id"), F.col("entity_type").alias("child_type"))
    found = links.filter(F.col("by") == "id").join(targets, F.col("key") == F.col("child_id"))
    referenced = _reference_targets(store)
    if referenced is None:
        return found
    match = (
        (F.col("organization_id") == F.col("__org"))
        & (F.lower("target_type") == F.col("__type"))
        & (F.col("key") == F.col("__ref"))
    )
    by_text = links.filter(F.col("by") == "reference").join(referenced, match)
    return found.unionByName(by_text.select(*found.columns))


def edges(links: DataFrame, store) -> DataFrame:
    """Distinct (parent, child) pairs; ``by_id`` tells whether some link named the child's id."""
    pair = ["organization_id", "parent_id", "parent_type", "child_id", "child_type"]
    return resolve(links, store).groupBy(*pair).agg(F.bool_or(F.col("by") == "id").alias("by_id"))


def dangling(links: DataFrame, store) -> DataFrame:
    """Links with no target; the links are written once and read on both sides."""
    links = stage(links, "links")
    hit = resolve(links, store).select(
        F.col("parent_id").alias("__p"), F.col("by").alias("__b"), F.col("target_type").alias("__t"), F.col("key").alias("__k")
    )
    match = (
        (F.col("parent_id") == F.col("__p"))
        & (F.col("by") == F.col("__b"))
        & (F.col("target_type") == F.col("__t"))
        & (F.col("key") == F.col("__k"))
    )
    return links.join(hit, match, "left_anti")


def all_links(store, types: list[str] | None = None, id_norm=values.uuid_norm) -> DataFrame:
    names = types if types is not None else list(store.frames)
    return reduce(DataFrame.unionByName, [link_table(store.load(t), store.schema_of(t), id_norm) for t in names])


def enrich(store, types: list[str], hops: int = 1, id_norm=values.uuid_norm) -> DataFrame:
    """Edges from all entities of the given types; children reached by id are followed further.

    ``hop`` numbers the step an edge was found in. With several hops the link table of all types is
    written once and read at each.
    """
    every = stage(all_links(store, None, id_norm), "links") if hops > 1 else None
    first = all_links(store, types, id_norm) if every is None else every.filter(F.col("parent_type").isin(types))
    step = edges(first, store)
    out = None
    for hop in range(1, hops + 1):
        if hop < hops:
            step = stage(step, "links")  # read both as a result and as the next frontier
        numbered = step.withColumn("hop", F.lit(hop))
        out = numbered if out is None else out.unionByName(numbered)
        if hop == hops:
            break
        reached = step.filter("by_id").select(F.col("child_id").alias("__id")).distinct()
        onward = every.join(reached, F.col("parent_id") == F.col("__id"), "left_semi")
        step = edges(onward, store)
    return out


def closure(store, types: list[str], max_hops: int | None = None, id_norm=values.uuid_norm) -> DataFrame:
    """All edges reachable from the entities of the given types over links by id, as ``enrich`` gives them for a few steps.

    ``hop`` is one more than the fewest links by id that lead from any of those entities to the edge's parent, however many
    ways and cycles lead there: an entity that was reached once is not followed again. Steps go on until none reaches
    anything new, or to ``max_hops``; each reads the links of its frontier only, and both the frontier and the set of
    entities reached are written to the shared folder.
    """
    every = stage(all_links(store, None, id_norm), "links")
    frontier = every.filter(F.col("parent_type").isin(types))
    # Entities of the given types without links of their own lead nowhere, so the links tell all that matter.
    seen = stage(frontier.select("organization_id", F.col("parent_id").alias("id")).distinct(), "reached")
    found, hop = [], 1
    while True:
        step = stage(edges(frontier, store).withColumn("hop", F.lit(hop)), "hop")
        found.append(step)
        if hop == max_hops:
            break
        reached = step.filter("by_id").select("organization_id", F.col("child_id").alias("id")).distinct()
        new = stage(reached.join(seen, ["organization_id", "id"], "left_anti"), "reached")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        starts = new.select(F.col("organization_id").alias("__org"), F.col("id").alias("__id"))
        frontier = every.join(starts, (F.col("organization_id") == F.col("__org")) & (F.col("parent_id") == F.col("__id")), "left_semi")
        hop += 1
    return reduce(DataFrame.unionByName, found)


def children_lists(found: DataFrame) -> DataFrame:
    """Children gathered per parent. A list holds the entities the parent's links reach: as many as the links
    by id, and for a link by reference text all entities that share the text (see ``reference_duplicates``)."""
    return found.groupBy("parent_id").agg(F.array_sort(F.collect_list("child_id")).alias("children"))


# --- merging on write ---------------------------------------------------------------------------


def linked_field(schema: EntitySchema):
    """The schema's linked field: the first well-known name that is declared."""
    for name in LINKED_NAMES:
        found = next((f for f in schema.fields if f.name.lower() == name.lower()), None)
        if found is not None:
            return found
    return None


def merge_links(df: DataFrame, schema: EntitySchema, requested: Column, id_norm=values.uuid_norm) -> DataFrame:
    """Put requested link ids into the schema's linked field and add them to ``linked_ids``.

    A single reference takes exactly one id and an array replaces its value; both want proper ids.
    Any other field is extended. Problems land in ``link_error`` and leave the row unchanged.
    """
    df = packed(df)
    bag = Bag.of(df)
    trimmed = F.transform(requested, lambda x: F.trim(x))
    wanted = F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))
    wanted = F.coalesce(wanted, F.array().cast("array<string>"))
    found = linked_field(schema)
    name = found.name if found is not None else "linked_ids"
    kind = found.type if found is not None else None
    asked = F.size(wanted) > 0
    bad = F.exists(wanted, lambda x: id_norm(x).isNull())
    no_error = F.lit(None).cast("string")
    not_ids = F.lit(f"field {name} requires linked entity IDs to be UUIDs")
    error = no_error
    if kind is FieldType.ENTITY_REFERENCE:
        error = (
            F.when(F.size(wanted) > 1, F.lit(f"linked ids given but field {name} expects a single reference"))
            .when(bad, not_ids)
            .otherwise(no_error)
        )
    elif kind is FieldType.ENTITY_REFERENCE_ARRAY:
        error = F.when(bad, not_ids).otherwise(no_error)
    apply = asked & error.isNull()
    changes = {"linked_ids": _extended(bag, "linked_ids", wanted, apply)}
    if kind is FieldType.ENTITY_REFERENCE:
        changes[name] = F.when(apply, F.get(wanted, F.lit(0))).otherwise(bag.text(name))
    elif kind is FieldType.ENTITY_REFERENCE_ARRAY:
        changes[name] = F.when(apply, wanted).otherwise(_or_null(bag, name))
    elif name != "linked_ids":
        changes[name] = _extended(bag, name, wanted, apply)
    edited = bag.edited(**changes)
    return df.withColumn("link_error", error).withColumn("properties", edited.col)


def _or_null(bag: Bag, name: str) -> Column:
    return bag.raw_items(name) if bag.type_of(name) is not None else F.lit(None).cast("array<string>")


def _extended(bag: Bag, name: str, wanted: Column, apply: Column) -> Column:
    if bag.type_of(name) is None:
        return F.when(apply, wanted)
    have = _link_texts(bag, name)
    kept = F.when(bag.has(name), have)
    return F.when(apply, F.array_distinct(F.concat(have, wanted))).otherwise(kept)
