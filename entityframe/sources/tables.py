"""Any table seen as entities, and the store the operators read."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions.props import PROPERTY, Bag
from entityframe.model import COLUMNS, ENVELOPE, EntitySchema


def _as_column(value, default: Column) -> Column:
    if value is None:
        return default
    return F.col(value) if isinstance(value, str) else value


def entities_from(
    df: DataFrame,
    entity_type: str,
    id: str | Column,
    properties: list[str | Column] | Column | None = None,
    path: str | Column | None = None,
    organization: str | Column = "org",
    schema_id: str | Column | None = None,
    version: str | Column | None = None,
    created_at: str | Column | None = None,
    updated_at: str | Column | None = None,
) -> DataFrame:
    """View ``df`` as entities of one type: envelope columns plus the properties.

    ``properties`` lists columns (all columns when None), each of which becomes an ``@`` column, or
    is one VARIANT column for schemaless bags. Zone-less times are cast once, here. It is a
    projection: nothing is read twice and unused columns are pruned from the scan.
    """
    null_time = F.lit(None).cast("timestamp")
    if isinstance(properties, Column):
        bag = [properties.alias("properties")]
    else:
        shown = df.select(*(df.columns if properties is None else properties))
        bag = []
        for p, f in zip(df.columns if properties is None else properties, shown.schema.fields):
            col = F.col(p) if isinstance(p, str) else p
            if isinstance(f.dataType, T.TimestampNTZType):
                col = col.cast("timestamp")
            bag.append(col.alias(PROPERTY + f.name))
    org = F.lit(organization) if isinstance(organization, str) else organization
    created = _as_column(created_at, null_time).cast("timestamp")
    return df.select(
        _as_column(id, F.lit(None)).cast("string").alias("id"),
        org.alias("organization_id"),
        _as_column(schema_id, F.lit(f"schema:{entity_type}")).alias("schema_id"),
        F.lit(entity_type).alias("entity_type"),
        _as_column(path, F.lit(None)).cast("string").alias("path"),
        *bag,
        _as_column(version, F.lit(1)).cast("bigint").alias("version"),
        created.alias("created_at"),
        (_as_column(updated_at, created)).cast("timestamp").alias("updated_at"),
    )


def packed(df: DataFrame) -> DataFrame:
    """The entities with their bag as one ``properties`` column."""
    if "properties" in df.columns:
        return df
    extra = [c for c in df.columns if c not in ENVELOPE and not c.startswith(PROPERTY)]
    cols = [Bag.of(df).col.alias("properties") if c == "properties" else F.col(c) for c in COLUMNS]
    return df.select(*cols, *extra)


def with_variant_bag(df: DataFrame) -> DataFrame:
    """The same entities with the bag as VARIANT, so that types of any shape can be unioned."""
    return df.withColumn("properties", Bag.of(df).variant()).select(*COLUMNS)


@dataclass
class EntityStore:
    """Entity frames by type plus the schemas that describe them.

    ``frames`` maps a type name to its frame (typed struct bags). ``mixed`` is an optional frame of
    many types with VARIANT bags, best written ``partitionBy("entity_type")``.
    """

    frames: dict[str, DataFrame] = field(default_factory=dict)
    schemas: dict[str, EntitySchema] = field(default_factory=dict)
    mixed: DataFrame | None = None
    organization: str | None = None

    def add(self, entity_type: str, df: DataFrame, schema: EntitySchema | None = None) -> EntityStore:
        self.frames[entity_type] = df
        if schema is not None:
            schema.check()
            self.schemas[entity_type] = schema
        return self

    def _scoped(self, df: DataFrame) -> DataFrame:
        if self.organization is None:
            return df
        return df.filter(F.col("organization_id") == F.lit(self.organization))

    def load(self, entity_type: str) -> DataFrame:
        if entity_type in self.frames:
            return self._scoped(self.frames[entity_type])
        if self.mixed is None:
            raise KeyError(f"no entities of type {entity_type!r}")
        return self._scoped(self.mixed.filter(F.col("entity_type") == F.lit(entity_type)))

    def all(self, types: list[str] | None = None) -> DataFrame:
        """All entities with VARIANT bags."""
        parts = [with_variant_bag(df) for t, df in self.frames.items() if types is None or t in types]
        if self.mixed is not None:
            mixed = self.mixed if types is None else self.mixed.filter(F.col("entity_type").isin(types))
            parts.append(mixed.select(*COLUMNS))
        if not parts:
            raise KeyError("the store is empty")
        return self._scoped(reduce(DataFrame.unionByName, parts))

    def envelopes(self, types: list[str] | None = None) -> DataFrame:
        """All entities without their bags: tree and id operators need no properties."""
        parts = [df.select(*ENVELOPE) for t, df in self.frames.items() if types is None or t in types]
        if self.mixed is not None:
            mixed = self.mixed if types is None else self.mixed.filter(F.col("entity_type").isin(types))
            parts.append(mixed.select(*ENVELOPE))
        return self._scoped(reduce(DataFrame.unionByName, parts))

    def schema_of(self, entity_type: str) -> EntitySchema | None:
        return self.schemas.get(entity_type)
