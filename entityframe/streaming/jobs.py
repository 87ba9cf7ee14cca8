"""Streaming jobs: files that keep arriving, and a feed of entity changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from entityframe.model import EntitySchema
from entityframe.sources.csv_files import RawTable, raw_table
from entityframe.sources.ingest import Ingest
from entityframe.sources.stored import StoredEntities
from entityframe.streaming.state import HistoryStore


def ingest_stream(
    rows: DataFrame,
    columns: list[str],
    row_number: str,
    schema: EntitySchema,
    out: str,
    checkpoint: str,
    organization: str = "org",
    name: str = "stream",
    shape: Callable[[DataFrame], RawTable] | None = None,
    **options,
) -> StreamingQuery:
    """Ingest every file a streaming source has not seen yet, then stop.

    Each micro-batch runs the same job as a file and owns the folder named by the stream and its batch
    number, so a batch that is run again after a failure replaces its own output, and streams with
    names of their own may share a store.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        raw = shape(batch) if shape is not None else raw_table(batch, columns, row_number)
        job = Ingest(raw, schema, organization, file_name=f"{name}-{number}", **options)
        job.write(f"{out}/entities", f"{out}/rejects", f"{out}/manifest", batch_id=f"{name}-{number}")

    return (
        rows.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_entities(spark: SparkSession, out: str) -> DataFrame:
    """The entities of the micro-batches that are completed by now."""
    return StoredEntities(spark, f"{out}/entities", f"{out}/manifest").mixed()


def history_stream(
    changes: DataFrame,
    spark: SparkSession,
    out: str,
    checkpoint: str,
    start: DataFrame,
    buckets: int | None = None,
) -> StreamingQuery:
    """Apply a stream of changes to the entities of ``start``, a batch of the store at ``out`` per micro-batch.

    Changes may come late or more than once: the outcome is that of all changes in the order of ``seq``. ``buckets`` sets
    the number of key ranges, else it follows the size of ``start``. See ``state.HistoryStore`` for the files; ``read_state``,
    ``read_history`` and ``read_refused`` give what the newest finished micro-batch left.
    """
    store = HistoryStore(spark, out)
    store.create(start, buckets)
    return (
        changes.writeStream.foreachBatch(store.apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_state(spark: SparkSession, out: str, start: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """The live entities of a history stream; the store itself knows its start and its key ranges."""
    return HistoryStore(spark, out).current()


def read_history(spark: SparkSession, out: str) -> DataFrame:
    return HistoryStore(spark, out).history()


def read_refused(spark: SparkSession, out: str) -> DataFrame:
    return HistoryStore(spark, out).refused()


__all__ = ["history_stream", "ingest_stream", "read_entities", "read_history", "read_refused", "read_state"]
