"""Session settings and the shared staging folder."""

from __future__ import annotations

import contextlib
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Run-time SQL settings the plans in this package are written for.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is worth one more shuffle: split it even where the split costs an exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Wide rows make generated methods the JVM will not compile (over 8000 bytecodes); beyond that
    # size, operators run on their own, whose generated code is split into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Settings that only a new session takes. Plans here are built from many small columns, and
# recording a call site for each would be most of the build time.
STARTUP_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

_shared: str | None = None


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; cluster-level settings stay the caller's."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def builder(app: str = "entityframe") -> SparkSession.Builder:
    """A session builder with all settings of this module."""
    out = SparkSession.builder.appName(app)
    for key, value in {**RUNTIME_CONF, **STARTUP_CONF}.items():
        out = out.config(key, value)
    return out


def use_shared_dir(path: str) -> None:
    """Name the shared folder for sessions whose ``spark.checkpoint.dir`` is unset, as local tests do."""
    global _shared
    _shared = path


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else what ``use_shared_dir`` was told."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _shared
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return found.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; the session deletes it when it ends."""
    path = f"{shared_dir(spark)}/entityframe/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Run-time settings for a block; afterwards they are as before."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stage(df: DataFrame, label: str, codec: str = "snappy", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage so that values which depend on physical placement (row ids) are fixed once and
    survive lost executors; later reads still prune columns. Once the table is written, the shuffle
    files it came from are of no use and are removed, rather than when the driver next collects garbage.
    """
    path = staging_path(df.sparkSession, label)
    with settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.options(compression=codec, **(options or {})).mode("errorifexists").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged[id(out)] = (weakref.ref(out, lambda _, key=id(out): _staged.pop(key, None)), path)
    return out


_staged: dict[int, tuple[weakref.ref, str]] = {}


def discard(df: DataFrame) -> None:
    """Delete a table that ``stage`` wrote and that no later result reads, before the session ends."""
    path = _staged.pop(id(df))[1]
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
