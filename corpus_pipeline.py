"""A corpus pipeline: filter, deduplicate lines and documents, mix sources, pack sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet and reads back as the
next stage's input. All but the last return the columns of ``documents``; other columns of the input, whatever their names,
are not read and go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.llm import line_dedup, mixing, near_dup, packing, quality_rules
from entityframe.llm.text import HAS_WORD
from entityframe.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality_rules.judge(docs.select(*COLUMNS), carry=tuple(COLUMNS))
    return judged.filter("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those left without a word go, and lengths follow the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), whole=True)
    left = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(HAS_WORD))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    A document is a row's id and text together, so an id with two texts is two documents, copies without an id are compared
    like any other, and of rows that repeat both one stays.
    """
    rows = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text"))
    gone = near_dup.near_duplicates(rows, doc_id="__key").filter("not kept").select(F.col("doc_id").alias("__key")).distinct()
    left = rows.join(gone, "__key", "left_anti")
    again = stage(rows.groupBy("__key").count().filter("count > 1").select("__key"), "repeated-rows")
    once, repeated = left.join(again, "__key", "left_anti"), left.join(again, "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(repeated).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: sorted by range, so files and rows in them follow the schedule."""
    return mixing.schedule(docs.select(*COLUMNS)).orderBy(*mixing.in_order()).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of documents that stand close in the mix; the schedule follows from the documents alone."""
    sized = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"), packing.long_size(packing.words(F.col("text"))).alias("n_words"))
    placed = mixing.schedule(sized)
    return packing.pack(placed.withColumn("text", F.lit(None).cast("string")), cluster=F.col("cluster"), length=F.col("n_words"), order=F.col("slot"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return stage(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
