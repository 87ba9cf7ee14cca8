"""Ingested entities as of one moment: only what the manifest names as committed, with typed columns that scans filter by."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions.props import PROPERTY, quoted
from entityframe.model import COLUMNS, ENVELOPE, EntitySchema
from entityframe.operators import schemas
from entityframe.sources.tables import EntityStore

_FILE_ENVELOPE = (
    "id string, organization_id string, schema_id string, path string, version bigint, created_at timestamp, updated_at timestamp"
)


class StoredEntities:
    """A snapshot of the batches under ``entities`` that ``manifest`` names as committed.

    The list of batches (one line each) is read once, when the snapshot is taken: batches that complete later do not show
    in it, and batches that are PENDING or FAILED show what they had committed before, if anything. Only the folders of
    listed attempts are read, and with a type only those of that type.
    """

    def __init__(self, spark: SparkSession, entities: str, manifest: str, organization: str | None = None):
        self.spark, self.entities, self.organization = spark, entities.rstrip("/"), organization
        rows = spark.read.parquet(manifest).filter("committed is not null").select("batch_id", "committed", "schema_name", "columns")
        # A folder that holds nothing (no row was valid) has no files to read.
        self.batches = [r for r in rows.collect() if self._types(r)]

    def _types(self, row) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(row))
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()] if fs.exists(place) else []

    def _folder(self, row) -> str:
        return f"{self.entities}/batch_id={row['batch_id']}/attempt={row['committed']}"

    def _read(self, rows: list, shape: T.StructType) -> DataFrame:
        parts = T.StructType([T.StructField(n, T.StringType()) for n in ("batch_id", "attempt", "entity_type")])
        reader = self.spark.read.schema(T.StructType([*shape.fields, *parts.fields])).option("basePath", self.entities)
        return reader.parquet(*[self._folder(r) for r in rows]).drop("attempt")

    def _none(self, shape: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*shape.fields, T.StructField("batch_id", T.StringType()), T.StructField("entity_type", T.StringType())]))

    def mixed(self) -> DataFrame:
        """Entities of all types with VARIANT bags, and the ``batch_id`` they came with."""
        shape = T.StructType([*T._parse_datatype_string(_FILE_ENVELOPE).fields, T.StructField("properties", T.VariantType())])
        df = self._read(self.batches, shape) if self.batches else self._none(shape)
        return self._scoped(df.select(*COLUMNS, "batch_id"))

    def typed(self, schema: EntitySchema) -> DataFrame:
        """Entities of one type with a column for each property of its schema.

        Batches that stored a property with the schema's own type are read as they are, so filters reach the scan; where an
        earlier schema had another type, its values are cast, and those that do not fit are null. Properties that a batch
        did not know are null.
        """
        wanted = T.StructType([T.StructField(PROPERTY + f.name, schemas.cell_type(f.type)) for f in schema.fields])
        envelope = T._parse_datatype_string(_FILE_ENVELOPE)
        shapes: dict[str, list] = {}
        for r in self.batches:
            if r["schema_name"] == schema.name:
                shapes.setdefault(r["columns"], []).append(r)
        frames = []
        for columns, rows in shapes.items():
            had = {f.name.casefold(): f for f in T.StructType.fromJson(json.loads(columns)).fields}
            found = [had[f.name.casefold()] for f in wanted.fields if f.name.casefold() in had]
            df = self._read(rows, T.StructType([*envelope.fields, *found])).filter(F.col("entity_type") == F.lit(schema.name))
            frames.append(df.select(*_envelope(), *[_as(f, had.get(f.name.casefold())) for f in wanted.fields]))
        if not frames:
            frames = [self._none(T.StructType([*envelope.fields, *wanted.fields])).select(*_envelope(), *[F.col(quoted(f.name)) for f in wanted.fields])]
        return self._scoped(reduce(DataFrame.unionByName, frames))

    def _scoped(self, df: DataFrame) -> DataFrame:
        return df if self.organization is None else df.filter(F.col("organization_id") == F.lit(self.organization))

    def store(self, known: list[EntitySchema] | None = None) -> EntityStore:
        """The snapshot as a store: types with a schema by their columns, the others by their bags."""
        known = known or []
        rest = self.mixed().drop("batch_id")
        if known:
            rest = rest.filter(~F.col("entity_type").isin([s.name for s in known]))
        out = EntityStore(mixed=rest, organization=self.organization)
        for schema in known:
            out.add(schema.name, self.typed(schema), schema)
        return out


def _envelope() -> list[Column]:
    return [F.col(c) for c in ENVELOPE]


def _as(field: T.StructField, had: T.StructField | None) -> Column:
    if had is None:
        return F.lit(None).cast(field.dataType).alias(field.name)
    value = F.col(quoted(had.name))
    if had.dataType != field.dataType:
        plain = isinstance(had.dataType, T.AtomicType) and isinstance(field.dataType, T.AtomicType)
        value = value.try_cast(field.dataType) if plain else F.lit(None).cast(field.dataType)
    return value.alias(field.name)


__all__ = ["StoredEntities"]
