"""A store bucketed by id: lookups and links by id shuffle the smaller side only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.session import staging_path

ROWS_PER_BUCKET = 1_000_000


@dataclass(frozen=True)
class ById:
    """A table bucketed and sorted by ``key``."""

    name: str
    buckets: int
    key: str = "id"

    def read(self, spark: SparkSession) -> DataFrame:
        """The table's entities; equi-joins and aggregates on its key leave it where it stands."""
        return spark.table(self.name)


def save_by_id(df: DataFrame, name: str | None = None, path: str | None = None, buckets: int | None = None, key: str = "id") -> ById:
    """Write entities as a table bucketed and sorted by ``key``.

    The number of buckets follows the number of rows (about a million a bucket), or is given, so that several tables share
    it and join with each other without any shuffle. Without a ``path`` the files lie in the session's shared folder.
    """
    spark = df.sparkSession
    name = name or f"entities_{uuid.uuid4().hex}"
    buckets = buckets or max(1, -(-df.count() // ROWS_PER_BUCKET))
    # One task a bucket writes one file a bucket, whose order the table then has.
    rows = df.repartition(buckets, F.col(key))
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path or staging_path(spark, "by-id")).format("parquet").saveAsTable(name)
    return ById(name, buckets, key)


def matching(table: ById, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Entities whose key is wanted: the distinct wanted keys are dealt to the table's buckets, the table is not shuffled."""
    spark = wanted.sparkSession
    ids = wanted.select(F.col(key).alias(table.key)).distinct().repartition(table.buckets, table.key)
    return table.read(spark).join(ids, table.key, "left_semi")


def lookup(table: ById, wanted: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """As ``listing.by_ids``, from a table by id. Requests of one id find its row once, however many there are."""
    asked = wanted.select(F.col(pos).alias("pos"), F.col(key).alias("requested_id"))
    found = matching(table, asked, "requested_id")
    return asked.join(found, F.col("requested_id") == F.col(table.key), "left").orderBy("pos")
