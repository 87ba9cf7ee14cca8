"""How filters interact: what each removes, alone and after others, for every order of applying them.

The files of a table run through a stream of available-now micro-batches. Four filters look at one text alone. The fifth
fails a document whose text stands under a smaller id anywhere in the table, which a batch cannot know yet: a state keyed
by the text's digest holds the smallest id met so far with what its rows were counted as. When a smaller id arrives, the
earlier rows are counted again: their old mask is taken back from the counters of their part and the mask with the fifth
filter put in. The counters are signed changes per batch, so their sum is exact whatever the order of the files.

State and counters are tables in the shared folder to which every batch adds under its own number: a batch that runs again
repeats its own folders. A batch writes the texts whose holder it changes, and reads the state's small columns by key.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.llm.text import let, whole, words
from entityframe.session import settings, staging_path, stage

FILTERS = "ABCDE"
TWIN = 16  # the bit of filter E
BATCHES = 4
FILE_BYTES = 64 << 20  # of input a written file stands for, at the least

_CELL = ["part", "mask", "good", "toxic"]
_ROWS = "key binary, id long, part string, mask int, good int, toxic int"
_STATE = f"{_ROWS}, n long"
_COUNTS = "part string, mask int, good int, toxic int, n long"


def own_mask(text: Column) -> Column:
    """Bits of the filters that look at a text alone: A 1, B 2, C 4, D 8."""
    text = whole(text)

    def of_words(found: Column) -> Column:
        n = F.size(found)
        few = F.when(n < 50, 1).otherwise(0)
        return few + F.when(100 * F.size(F.array_distinct(found)) < 65 * n, 2).otherwise(0)

    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long")
    return let(words(text), of_words) + F.when(capitals, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def _files(spark: SparkSession, path: str) -> tuple[str, int]:
    """What to stream from, and how many bytes lie there.

    A stream takes folders and patterns; a single file is named by a pattern that only it fits.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = f"{path[:-1]}[{path[-1]}]" if fs.getFileStatus(place).isFile() else path
    return pattern, fs.getContentSummary(place).getLength()


class Counters:
    """The state of texts and the counters of parts under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, files: int):
        self.spark, self.folder, self.files = spark, folder, files

    def _before(self, table: str, number: int, shape: str) -> DataFrame:
        """What earlier batches wrote."""
        if not number:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*[f"{self.folder}/{table}/{n}" for n in range(number)])

    def _write(self, df: DataFrame, table: str, number: int) -> DataFrame:
        path = f"{self.folder}/{table}/{number}"
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.coalesce(self.files).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, batch: DataFrame, number: int) -> None:
        """Count a batch of ``_ROWS``.

        Every row with an id is first counted as a failure of E. Of the rows under the batch's smallest id of a text, those
        below or level with the state's holder are counted back as they are, and holders above them are taken back. A text
        with any number of copies is one row a task before the first shuffle, and its rows are dealt by text and id.
        """
        rows = self._write(batch.select(*[c.split()[0] for c in _ROWS.split(", ")]), "rows", number)
        named = rows.filter("id is not null")
        least = named.groupBy("key").agg(F.min("id").alias("id"))
        held = self._before("state", number, _STATE)
        smallest = held.groupBy("key").agg(F.min("id").alias("held"))
        news = least.join(smallest, "key", "left").filter("held is null or id <= held")
        news = self._write(news, "news", number)
        firsts = named.join(news.select("key", "id"), ["key", "id"]).groupBy("key", "id", *_CELL).agg(F.count("*").alias("n"))
        firsts = self._write(firsts.select(*[c.split()[0] for c in _STATE.split(", ")]), "state", number)
        passed = held.join(news.filter("id < held").select("key", F.col("held").alias("id")), ["key", "id"])

        failed = F.col("mask").bitwiseOR(F.lit(TWIN)).cast("int").alias("mask")
        cells = ["part", failed, "good", "toxic"]
        one, n = F.lit(1).cast("long").alias("n"), F.col("n")
        told = rows.select("part", F.when(F.col("id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(TWIN))).cast("int").alias("mask"), "good", "toxic", one)
        moved = [firsts.select(*_CELL, n), firsts.select(*cells, (-n).alias("n")), passed.select(*_CELL, (-n).alias("n")), passed.select(*cells, n)]
        for part in moved:
            told = told.unionByName(part)
        self._write(told.groupBy(*_CELL).agg(F.sum("n").alias("n")).filter("n <> 0"), "counts", number)

    def cells(self, batches: int) -> DataFrame:
        """The counters after all batches."""
        return self._before("counts", batches, _COUNTS).groupBy(*_CELL).agg(F.sum("n").alias("n")).filter("n <> 0")


def count_masks(
    spark: SparkSession, path: str, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", batches: int = BATCHES
) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents per part, failed filters and labels, from a stream over the files at ``path``.

    ``batches`` sets how many bytes of files a micro-batch takes. Rows without an id have no smaller id and are none; rows
    that share an id and a text do not fail each other; null texts count as empty, null parts as ''. A label counts if any
    row of ``labels`` for the id has it. Texts are told apart by SHA-256.
    """
    files, total = _files(spark, path)
    total = max(1, total)
    flags = [F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    marked = stage(labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("label_id")).agg(*flags).filter("good + toxic > 0"), "audit-labels")
    source = spark.readStream.schema(spark.read.parquet(path).select(doc_id, text, part).schema).option("maxBytesPerTrigger", str(-(-total // batches))).option("maxFileAge", "36500d").parquet(files)
    digest = F.unhex(F.sha2(whole(F.col(text)), 256))
    rows = source.select(F.col(doc_id).cast("long").alias("id"), digest.alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own_mask(F.col(text)).alias("mask"))
    # Rows without an id match no label; their digest spreads them over the join.
    near = [F.coalesce("id", F.xxhash64("key")) == F.col("label_id"), F.col("id").isNotNull() == F.col("has_id")]
    rows = rows.join(marked.withColumn("has_id", F.lit(True)), near, "left")
    rows = rows.select("key", "id", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    counters = Counters(spark, staging_path(spark, "audit"), max(4, -(-total // FILE_BYTES)))
    done: list[int] = []

    def one_batch(batch: DataFrame, number: int) -> None:
        counters.add(batch, number)
        done.append(number)

    query = rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", staging_path(spark, "audit-marks"))
    query.trigger(availableNow=True).start().awaitTermination()
    return stage(counters.cells(max(done, default=-1) + 1), "audit-cells")


def audit(cells: DataFrame) -> DataFrame:
    """The counts of every order of the filters, step by step, from documents per part and mask.

    ``kept``, ``removed`` and ``redundant`` belong to the step's place in its order; ``unique_fails`` and ``shapley`` to its
    filter. The latter is what the filter removes, summed over all orders: a document that fails k filters is removed by
    each of them in one k-th of the orders. A part is one row of at most 32 masks before its orders are laid out.
    """
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    per_mask = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("g"), F.sum(F.col("n") * F.col("toxic")).alias("t"))
    parts = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "g", "t")).alias("masks"))
    steps = []
    for order in orders:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append((order, step, bit, before))
            before |= bit
    plan = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"p":{p}}}' for o, s, b, p in steps) + "]"), "array<struct<o:string,s:int,b:int,p:int>>")
    rows = parts.select("part", "masks", F.explode(plan).alias("at"))
    mask = lambda m: m["mask"]
    hits = lambda m: mask(m).bitwiseAND(F.col("at.b")) != 0
    gone = lambda m: mask(m).bitwiseAND(F.col("at.p")) != 0
    total = lambda keep, value: F.aggregate(F.filter("masks", keep), F.lit(0).cast("long"), lambda a, m: a + value(m))
    n = lambda m: m["n"]
    return rows.select(
        "part",
        F.col("at.o").alias("filter_order"),
        F.col("at.s").alias("step"),
        total(lambda m: ~hits(m) & ~gone(m), n).alias("kept"),
        total(lambda m: hits(m) & ~gone(m), n).alias("removed"),
        total(lambda m: hits(m) & gone(m), n).alias("redundant"),
        total(lambda m: mask(m) == F.col("at.b"), n).alias("unique_fails"),
        total(lambda m: hits(m) & ~gone(m), lambda m: m["g"]).alias("good_lost"),
        total(lambda m: hits(m) & ~gone(m), lambda m: m["t"]).alias("toxic_lost"),
        total(hits, lambda m: (m["n"] * (F.lit(len(orders)) / F.bit_count(mask(m))).cast("long"))).alias("shapley"),
    )
