"""File ingestion: infer, reconcile, coerce, validate, name, and write in bulk."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import coerce, values
from entityframe.functions.props import PROPERTY, Bag
from entityframe.model import EntitySchema, Field
from entityframe.operators import ordinal, schemas, validation
from entityframe.session import stage, tune
from entityframe.sources.csv_files import RawTable

PREVIEW_ROWS = 10
MESSAGE_CHARS = 2000
LOG_PAGE = 200


def coerced(raw: RawTable, schema: EntitySchema) -> DataFrame:
    """Rows with a typed ``properties`` struct and ``coerce_error``, the first bad cell's message.

    Cells are trimmed, blank ones count as absent, and columns the schema lacks are skipped.
    """
    known = [(c, schemas.field_of(schema, c)) for c in raw.columns if schemas.field_of(schema, c) is not None]
    cells, typed, errors, props = {}, {}, [], []
    for i, (name, f) in enumerate(known):
        text = F.trim(raw.cell(name))
        cells[f"__cell{i}"] = F.when(text != "", text)
        typed[f"__value{i}"] = coerce.value(F.col(f"__cell{i}"), f.type).cast(schemas.cell_type(f.type))
        error = coerce.error(F.col(f"__cell{i}"), F.col(f"__value{i}"), f.type)
        if error is not None:
            errors.append(F.concat(F.lit(f"field {name}: "), error))
        props.append(F.col(f"__value{i}").alias(f.name))
    present = {c.casefold() for c in raw.columns}
    missing = [f for f in schema.fields if f.name.casefold() not in present]
    props += [F.lit(None).cast(schemas.cell_type(f.type)).alias(f.name) for f in missing]
    first = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    # Cells, then values, then errors: each is used several times and worked out once.
    steps = raw.df.withColumns(cells).withColumns(typed)
    return steps.withColumns({"properties": F.struct(*props), "coerce_error": first}).drop(*cells, *typed)


def checked(raw: RawTable, schema: EntitySchema, id_norm=values.uuid_norm, skip_validation: bool = False) -> DataFrame:
    """Coerced rows with ``error``: null for a good row, else every reason it is rejected."""
    rows = coerced(raw, schema)
    if skip_validation:
        return rows.withColumnRenamed("coerce_error", "error")
    found = validation.validate(rows, schema, id_norm)
    warned = F.transform("warnings", lambda w: F.concat(F.lit("warning "), w))
    message = F.array_join(F.concat(F.col("errors"), warned), "; ")
    error = F.coalesce("coerce_error", F.when(~F.col("is_valid"), message))
    return found.withColumn("error", error).drop("coerce_error", "errors", "warnings", "is_valid")


def path_column(schema_name: str, raw: RawTable) -> Column:
    """``slug(schema).slug(first non-blank cell)``, with ``entity`` and ``row_N`` to fall back on."""
    base = coerce.slug(F.lit(schema_name))
    cells = [F.nullif(F.trim(raw.cell(c)), F.lit("")) for c in raw.columns]
    row = F.concat(F.lit("row_"), (F.col("row_number") - F.lit(raw.header_row + 1)).cast("string"))
    child = F.nullif(coerce.slug(F.coalesce(*cells)), F.lit(""))
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("entity")), F.lit("."), F.coalesce(child, row))


def with_paths(good: DataFrame, raw: RawTable) -> DataFrame:
    """Turn ``__base`` into the path: the n-th row of one base, in file order, gets ``_n`` appended."""
    ranked = ordinal.rank_in_group(good, ["__base"], raw.order, "__nth", raw.chunk)
    suffix = F.when(F.col("__nth") > 1, F.concat(F.lit("_"), F.col("__nth").cast("string"))).otherwise("")
    return ranked.withColumn("path", F.concat(F.col("__base"), suffix)).drop("__base", "__nth")


@dataclass
class Ingest:
    """One file against one schema, as lazy frames."""

    raw: RawTable
    schema: EntitySchema
    organization: str = "org"
    file_name: str = ""
    id_norm: object = values.uuid_norm
    skip_validation: bool = False
    notes: tuple[str, ...] = ()
    _staged: DataFrame | None = None

    def rows(self) -> DataFrame:
        """Every row with its typed bag and its error.

        The counts observed here also keep a filter on ``error`` above the coercion; pushed below,
        it would work out every cell a second time.
        """
        if self._staged is not None:
            return self._staged
        found = checked(self.raw, self.schema, self.id_norm, self.skip_validation)
        return found.observe("ingest rows", F.count(F.lit(1)).alias("total"), F.count("error").alias("invalid"))

    def stage(self) -> Ingest:
        """Write the checked rows once; valid rows, rejects and counts are then read, not redone."""
        if self._staged is None:
            named = self.rows().withColumn("__base", path_column(self.schema.name, self.raw))
            self._staged = stage(named.drop(*[PROPERTY + c for c in self.raw.columns]), "ingest")
        return self

    def valid(self) -> DataFrame:
        """Good rows with their paths."""
        good = self.stage().rows().filter(F.col("error").isNull())
        return with_paths(good, self.raw)

    def rejects(self) -> DataFrame:
        """Reject log rows: file record number and message."""
        return (
            self.rows()
            .filter(F.col("error").isNotNull())
            .select(
                F.lit(self.organization).alias("organization_id"),
                F.lit(self.schema.name).alias("schema_name"),
                F.lit(self.file_name).alias("file_name"),
                "row_number",
                F.col("error").alias("error_message"),
            )
        )

    def log(self) -> DataFrame:
        """What is logged: the rejects, and notes on the file itself, which have no record number."""
        if not self.notes:
            return self.rejects()
        rows = [(self.organization, self.schema.name, self.file_name, None, note) for note in self.notes]
        shape = "organization_id string, schema_name string, file_name string, row_number bigint, error_message string"
        return self.rejects().unionByName(self.raw.df.sparkSession.createDataFrame(rows, shape))

    def entities(self, batch_id: str) -> DataFrame:
        """Valid rows as new entities.

        Ids are hashes of the batch, the file and the record's place in it, so a retried task repeats
        them and no two records share one, even where their paths collide.
        """
        place = [F.col(c).cast("string") for c in self.raw.order]
        name = F.sha1(F.concat_ws("/", F.lit(batch_id), F.lit(self.file_name), *place))
        key = F.concat_ws(
            "-", *[F.substring(name, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        )
        now = F.current_timestamp()
        return self.valid().select(
            key.alias("id"),
            F.lit(self.organization).alias("organization_id"),
            F.lit(self.schema.id or f"schema:{self.schema.name}").alias("schema_id"),
            F.lit(self.schema.name).alias("entity_type"),
            "path",
            "properties",
            F.lit(1).cast("bigint").alias("version"),
            now.alias("created_at"),
            now.alias("updated_at"),
            F.lit(batch_id).alias("batch_id"),
        )

    def summary(self) -> DataFrame:
        return self.rows().agg(
            F.count("*").alias("total_rows"),
            F.count_if(F.col("error").isNull()).alias("valid_rows"),
            F.count_if(F.col("error").isNotNull()).alias("invalid_rows"),
        )

    def preview(self, limit: int = PREVIEW_ROWS) -> DataFrame:
        """First rows of the file: ``row_number``, the trimmed cells as the struct ``values``, and
        ``error``; nothing is written."""
        head = replace(self.raw, df=self.raw.df.orderBy(*self.raw.order).limit(limit))
        first = checked(head, self.schema, self.id_norm, self.skip_validation).orderBy(*self.raw.order)
        cells = [F.trim(F.coalesce(self.raw.cell(c), F.lit(""))).alias(c) for c in self.raw.columns]
        return first.select("row_number", F.struct(*cells).alias("values"), "error")

    def write(self, entities_path: str, rejects_path: str, manifest_path: str, batch_id: str | None = None) -> str:
        """Append entities, rejects and one manifest row, which is PENDING first and ends as COMPLETED or,
        if a step fails, FAILED with the reason.

        Every attempt writes its entities to a folder of its own, and readers (``stored.StoredEntities``) go by the attempt
        the manifest names as committed: a batch shows whole once it is COMPLETED, and a batch written again shows its
        earlier rows until then. What other attempts of the batch left is removed when one is completed.
        """
        batch, attempt = batch_id or str(uuid.uuid4()), uuid.uuid4().hex
        spark = self.raw.df.sparkSession
        before = committed_attempt(spark, manifest_path, batch)

        def mark(status: str, written: int = 0, rejected: int = 0, reason: str | None = None, commit: tuple[str | None, str | None] = before) -> None:
            row = manifest_row(spark, batch, self.organization, self.schema.name, self.file_name, written, rejected, status, reason)
            row = row.withColumns({"attempt": F.lit(attempt), "committed": F.lit(commit[0]).cast("string"), "columns": F.lit(commit[1]).cast("string")})
            _write_batch(row, f"{manifest_path.rstrip('/')}/batch_id={batch}")

        mark("PENDING")
        folder = f"{entities_path.rstrip('/')}/batch_id={batch}"
        try:
            written, rejected, columns = self._write_rows(f"{folder}/attempt={attempt}", rejects_path, batch)
        except Exception as error:
            mark("FAILED", reason=str(error)[:MESSAGE_CHARS])
            raise
        mark("COMPLETED", written, rejected, commit=(attempt, columns))
        _keep_only(spark, folder, f"attempt={attempt}")
        return batch

    def _write_rows(self, folder: str, rejects_path: str, batch: str) -> tuple[int, int, str]:
        """Rows written and refused, and the typed columns the entities have, as a JSON schema."""
        seen, refused = Observation(), Observation()
        good = with_typed_columns(self.stage().entities(batch))
        columns = T.StructType([f for f in good.schema.fields if f.name.startswith(PROPERTY)])
        _write_batch(good.observe(seen, F.count(F.lit(1)).alias("n")), folder)
        bad = self.log().withColumn("batch_id", F.lit(batch)).withColumn("created_at", F.current_timestamp())
        _write_batch(bad.observe(refused, F.count(F.lit(1)).alias("n")), f"{rejects_path.rstrip('/')}/batch_id={batch}")
        return seen.get["n"], refused.get["n"] - len(self.notes), columns.json()


def _write_batch(df: DataFrame, folder: str) -> None:
    shown = _stored(df).drop("batch_id")
    writer = shown.write.mode("overwrite")
    if "properties" in df.columns:
        writer = writer.partitionBy("entity_type")
    writer.parquet(folder)


def with_typed_columns(entities: DataFrame) -> DataFrame:
    """The entities with every property a second time as a column of its own type, which a scan can prune and filter by."""
    if "properties" not in entities.columns:
        return entities
    bag = Bag.of(entities)
    return entities.withColumns({PROPERTY + n: bag.value(n) for n in bag.names()})


def committed_attempt(spark, manifest_path: str, batch: str) -> tuple[str | None, str | None]:
    """The attempt of a batch that readers see, and its typed columns; nothing where it was never completed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{manifest_path.rstrip('/')}/batch_id={batch}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None, None
    row = spark.read.schema("committed string, columns string").parquet(folder.toString()).first()
    return (row["committed"], row["columns"]) if row else (None, None)


def _keep_only(spark, folder: str, name: str) -> None:
    """Remove the folders of a batch's other attempts."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(place):
        if found.getPath().getName() != name:
            fs.delete(found.getPath(), True)


def _stored(df: DataFrame) -> DataFrame:
    """Bags are stored as VARIANT, the shape all types of a store share."""
    return df.withColumn("properties", Bag.of(df).variant()) if "properties" in df.columns else df


MANIFEST = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("organization_id", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("rows_staged", T.LongType()),
        T.StructField("rows_flushed", T.LongType()),
        T.StructField("rows_rejected", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)


def manifest_row(spark, batch, organization, schema_name, file_name, written, rejected, status="COMPLETED", reason=None) -> DataFrame:
    row = (batch, organization, schema_name, file_name, written, written, rejected, status, reason)
    return spark.createDataFrame([row], MANIFEST).withColumn("enqueued_at", F.current_timestamp())


def batch_stats(manifest: DataFrame) -> DataFrame:
    status = F.col("status")
    return manifest.agg(
        F.count("*").alias("total_batches"),
        F.count_if(status.isin("PENDING", "FLUSHING")).alias("in_progress_batches"),
        F.count_if(status == "COMPLETED").alias("completed_batches"),
        F.count_if(status == "FAILED").alias("failed_batches"),
        F.coalesce(F.sum("rows_staged"), F.lit(0)).cast("bigint").alias("total_rows_staged"),
        F.coalesce(F.sum("rows_flushed"), F.lit(0)).cast("bigint").alias("total_rows_flushed"),
    )


def batches(manifest: DataFrame, statuses: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """Batches in the given states, newest first."""
    found = manifest.filter(F.col("status").isin(statuses))
    return ordinal.page(found, [F.col("enqueued_at").desc(), F.col("batch_id").asc()], limit, offset)


def reject_log(rejects: DataFrame, organization: str, schema_name: str, file_name: str, limit: int = LOG_PAGE, offset: int = 0) -> DataFrame:
    """Rejected rows of one file, newest first."""
    found = rejects.filter(
        (F.col("organization_id") == organization) & (F.col("schema_name") == schema_name) & (F.col("file_name") == file_name)
    )
    return ordinal.page(found, [F.col("created_at").desc(), F.col("row_number").asc()], limit, offset)


@dataclass
class Plan:
    """What ingesting a file would do: the schema to use, what changed, and the row job.

    Type conflicts are logged with the row errors, against the file itself (no row number).
    """

    ingest: Ingest
    created: bool
    detected: list[Field]
    new_fields: tuple[str, ...]
    changes: tuple[schemas.SchemaChange, ...]
    updated: bool = False

    def schema_row(self) -> DataFrame:
        """The settled schema as a registry row, ready for ``schemas.publish``; empty if nothing changed."""
        job, schema = self.ingest, self.ingest.schema
        name = f"{job.organization}/{schema.name}/{schema.version}"
        fields = json.dumps([{"name": f.name, "type": f.type.value, "required": f.required} for f in schema.fields])
        rows = [(schema.id or f"schema:{name}", job.organization, schema.name, schema.version, "ACTIVE", fields)] if self.created or self.updated else []
        shape = "id string, organization_id string, name string, version string, status string, fields string"
        return job.raw.df.sparkSession.createDataFrame(rows, shape).withColumn("created_at", F.current_timestamp())

    def headers(self, overrides: dict[str, str] | None = None) -> list[dict]:
        """Per file column: label, detected and effective type, required, overridden."""
        schema = self.ingest.schema
        out = []
        for name, label, d in zip(self.ingest.raw.columns, self.ingest.raw.labels, self.detected):
            effective = schemas.field_of(schema, name) or d
            out.append(
                {
                    "name": name,
                    "original_label": label,
                    "detected_type": d.type.value,
                    "effective_type": effective.type.value,
                    "required": effective.required,
                    "overridden": name in (overrides or {}),
                }
            )
        return out


def plan(
    raw: RawTable,
    schema_name: str,
    existing: EntitySchema | None = None,
    overrides: dict[str, str] | None = None,
    **options,
) -> Plan:
    """Profile the rows (one aggregate), settle the schema, and set up the row job."""
    if not schema_name.strip():
        raise ValueError("schema name is required")
    tune(raw.df.sparkSession)
    table = schemas.infer(raw.texts(), raw.columns, overrides).orderBy("ordinal").collect()
    detected = [Field(r["field_name"], r["detected_type"], r["required"]) for r in table]
    wanted = [replace(d, type=r["field_type"]) for d, r in zip(detected, table)]
    if existing is None:
        schema = EntitySchema(schema_name, tuple(wanted))
        change = schemas.SchemaChange("", f"schema {schema_name} created")
        return Plan(Ingest(raw, schema, **options), True, detected, (), (change,))
    settled = schemas.reconcile(existing, wanted)
    notes = tuple(c.message for c in settled.changes if c.existing_type)
    job = Ingest(raw, settled.schema, notes=notes, **options)
    return Plan(job, False, detected, settled.new_fields, settled.changes, settled.updated)
