"""Operators for training-data pipelines: quality, deduplication, packing, mixing, search and token files.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Every operator takes and returns DataFrames, reads
only the columns it is told to, and leaves other columns alone.
"""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that tasks can import it wherever it is installed.

    The archive lies in the driver's folder for files that Spark distributes and goes with the session.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        folder = Path(SparkFiles.getRootDirectory()) / "archives"
        folder.mkdir(exist_ok=True)
        with zipfile.ZipFile(folder / f"{package.name}.zip", "w") as archive:
            for path in sorted(package.rglob("*.py")):
                archive.write(path, path.relative_to(package.parent))
        context.addPyFile(str(folder / f"{package.name}.zip"))
        _shipped.add(context.applicationId)
    return spark
