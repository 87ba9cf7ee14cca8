"""Positions, running totals and pages that stay distributed when one group is very large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityframe.session import stage

# A window group holds at most this many rows.
ROWS_PER_CHUNK = 1_000_000
# Pages that end within this many rows are a top-k: every split passes on that many rows at most, so 10 000 splits pass
# 20 million, of which one task holds this many at a time. Every larger page is cut by position.
TOP_ROWS = 2_000

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Add the 0-based position under a total order, without gathering rows in one task.

    Range-sorts and stages the rows (so that placement is fixed), then adds the sizes of the
    partitions before a row's own. Only one line per partition goes through the running sum.
    """
    placed = stage(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    in_part = F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.withColumn("__part", part)
        .join(offsets, "__part")
        .withColumn(name, F.col("__before") + in_part)
        .drop("__at", "__part", "__before")
    )


class PageIndex:
    """Rows sorted once, by ranges, and staged with the number of rows in each range: deep pages read what they show.

    A range is one partition of the sort and one file. The counts (one line a range) are kept, so a page knows the ranges it
    lies in, reads only those files and sorts only its own rows. The index shows the rows as of when it was built.
    """

    def __init__(self, df: DataFrame, order: list[Column]):
        self.rows = stage(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "pages")
        sizes = self.rows.groupBy(F.shiftright("__at", _ROW_BITS).alias("part"), F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
        self.ranges, total = [], 0
        for r in sizes.orderBy("part").collect():
            self.ranges.append((total, r["n"], r["part"], r["file"]))
            total += r["n"]
        self.total = total

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``[offset, offset + limit)`` of the order."""
        hit = [(max(offset - before, 0), min(offset + limit - before, n), part, file) for before, n, part, file in self.ranges if before < offset + limit and offset < before + n]
        if not hit:
            return self.rows.limit(0).drop("__at")
        own = reduce(lambda a, b: a | b, [F.col("__at").between((part << _ROW_BITS) + low, (part << _ROW_BITS) + high - 1) for low, high, part, _ in hit])
        found = self.rows.sparkSession.read.schema(self.rows.schema).parquet(*[file for *_, file in hit])
        return found.filter(own).orderBy("__at").drop("__at")


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows ``[offset, offset + limit)`` under a total order; a limit of None or 0 means all.

    Pages that end within the first ``TOP_ROWS`` rows are a top-k; all others, which a top-k would
    carry through one task, are cut by position.
    """
    limit = limit or None
    offset = max(offset or 0, 0)
    if limit is None and offset == 0:
        return df.orderBy(*order)
    if limit is not None and offset + limit <= TOP_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    numbered = positions(df, order, "__pos")
    wanted = F.col("__pos") >= offset
    if limit is not None:
        wanted = wanted & (F.col("__pos") < offset + limit)
    return numbered.filter(wanted).orderBy("__pos").drop("__pos")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column],
    chunk: Column | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add inclusive running sums per key under an order, safe for a key that holds most rows.

    ``chunk`` must grow with the order. Rows are summed within (key, chunk), and one line per
    (key, chunk) carries the totals of the chunks before. Without a chunk the rows are range-sorted
    and chunks cut by position, whatever the size of the groups.
    """
    cols = df.columns
    if chunk is None:
        df = positions(df, [F.col(c).asc() for c in (*keys, *order)], "__pos")
        chunk = F.floor(F.col("__pos") / rows_per_chunk)

    parted = df.withColumn("__chunk", chunk)
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = parted.withColumns({n: F.sum(c).over(w) for n, c in totals.items()})
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parted.groupBy(*keys, "__chunk")
        .agg(*[F.sum(c).alias(f"__t_{n}") for n, c in totals.items()])
        .withColumns({f"__c_{n}": F.sum(f"__t_{n}").over(before) for n in totals})
    )
    carried = carried.filter(F.col(f"__c_{next(iter(totals))}").isNotNull()).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__chunk").alias("__k_chunk"), *[f"__c_{n}" for n in totals]
    )
    match = F.col("__chunk") == F.col("__k_chunk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = within.join(carried, match, "left")
    return joined.select(
        *cols, *[(F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n) for n in totals]
    )


def rank_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "rank",
    chunk: Column | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """1-based row number per key under an order that is total within the key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, chunk, rows_per_chunk)


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, chunk: Column) -> DataFrame:
    """Add the last non-null ``value`` of the key's rows before a row; ``order`` is total in the key.

    Like ``running_totals``, within bounded chunks plus one carried line per chunk.
    """
    marked = df.withColumns({"__mark": F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v"))), "__chunk": chunk})
    w = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = marked.withColumn("__own", F.max("__mark").over(w))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*keys, "__chunk").agg(F.max("__mark").alias("__most")).withColumn("__past", F.max("__most").over(before))
    carried = carried.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__chunk").alias("__k_chunk"), "__past")
    match = F.col("__chunk") == F.col("__k_chunk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = within.join(carried, match, "left")
    return joined.select(*df.columns, F.coalesce("__own", "__past")["v"].alias(name))
