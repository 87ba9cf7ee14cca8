"""Pages and totals of a cross product, without forming the product; the whole of it is a cross join.

Row ``p`` of the product of sorted factors is found by arithmetic: the index into a factor is
``p // (rows of all later factors) % rows of this factor``. A page therefore needs only a short
range of each factor, joined to the page's positions on that index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityframe.operators import ordinal


@dataclass
class Factor:
    df: DataFrame
    order: list[Column]


def total(factors: list[Factor]) -> DataFrame:
    """One-row frame with the product of the factors' row counts."""
    counts = [f.df.agg(F.count("*").alias(f"n{i}")) for i, f in enumerate(factors)]
    marked = [c.withColumn("__one", F.lit(1)) for c in counts]
    joined = reduce(lambda a, b: a.join(b, "__one"), marked)
    size = reduce(lambda a, b: a * b, [F.col(f"n{i}") for i in range(len(factors))])
    return joined.select(size.alias("total"))


def whole(factors: list[Factor]) -> DataFrame:
    """Every row of the product, unordered. This is the cross join it looks like, with as many rows as
    the product of the counts: callers ask for it with ``allow_cartesian=True`` only."""
    return reduce(lambda a, b: a.crossJoin(b), [f.df for f in factors])


def page(factors: list[Factor], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``[offset, offset + limit)`` of the product in factor-major order."""
    return _rows(factors, limit, offset).orderBy("__p").drop("__p")


def _rows(factors: list[Factor], limit: int, offset: int) -> DataFrame:
    spark = factors[0].df.sparkSession
    sizes = [f.df.count() for f in factors]
    rows = reduce(lambda a, b: a * b, sizes)
    first, last = max(offset, 0), min(max(offset, 0) + limit, rows)
    name = "__p"
    out = spark.range(first, max(first, last)).withColumnRenamed("id", name)
    stride = rows
    for i, (factor, size) in enumerate(zip(factors, sizes)):
        if size == 0 or last <= first:
            indexed = factor.df.limit(0).withColumn("__i", F.lit(0).cast("bigint"))
            out = out.withColumn("__at", F.lit(0).cast("bigint"))
        else:
            stride //= size
            indexed = _slice(factor, size, first // stride, (last - 1) // stride)
            out = out.withColumn("__at", F.expr(f"{name} div {stride} % {size}"))
        out = out.join(indexed.withColumnRenamed("__i", f"__i{i}"), F.col("__at") == F.col(f"__i{i}"))
        out = out.drop("__at", f"__i{i}")
    return out


def _slice(factor: Factor, size: int, low: int, high: int) -> DataFrame:
    """Rows of a sorted factor whose index lies in ``[low, high]`` modulo its size, with the index."""
    if high - low + 1 >= size:
        return _indexed(factor, 0, size)
    start, stop = low % size, high % size
    if start <= stop:
        return _indexed(factor, start, stop - start + 1)
    return _indexed(factor, start, size - start).unionByName(_indexed(factor, 0, stop + 1))


def _indexed(factor: Factor, start: int, count: int) -> DataFrame:
    if start + count > ordinal.TOP_ROWS:
        numbered = ordinal.positions(factor.df, factor.order, "__i")
        return numbered.filter(F.col("__i").between(start, start + count - 1))
    top = factor.df.orderBy(*factor.order).offset(start).limit(count)
    # At most TOP_ROWS rows reach this window.
    w = Window.orderBy(*factor.order)
    return top.withColumn("__i", F.row_number().over(w).cast("bigint") + F.lit(start - 1))


def grouped_page(major: DataFrame, keys: list[Column], ways: list[Column], ties: list[Column], minor: Factor, limit: int, offset: int) -> DataFrame:
    """A page of the product ordered by the major side's keys, then the minor side, then ``ties``.

    Major rows with equal keys share their minor rows: such a group of ``g`` rows fills ``g`` times
    the minor side's rows, minor-major within. ``keys`` are the key values and ``ways`` the same keys
    with their directions.
    """
    spark = major.sparkSession
    names = [f"__s{i}" for i in range(len(keys))]
    valued = major.withColumns(dict(zip(names, keys)))
    numbered = ordinal.positions(valued, [*ways, *ties], "__m")
    wide = minor.df.count()
    rows = numbered.count() * wide
    first, last = max(offset, 0), min(max(offset, 0) + limit, rows)
    at = spark.range(first, max(first, last)).withColumnRenamed("id", "__p").withColumn("__a", F.expr(f"__p div {max(wide, 1)}"))

    # The row at position p div wide lies in the group that holds row p.
    anchors = numbered.select(F.col("__m").alias("__a"), *[F.col(n).alias(f"{n}k") for n in names])
    held = at.join(anchors, "__a")
    groups = held.select(*[f"{n}k" for n in names]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}k")) for n in names])
    sizes = numbered.join(groups, same).groupBy(*[F.col(n).alias(f"{n}g") for n in names]).agg(
        F.min("__m").alias("__start"), F.count("*").alias("__g")
    )
    match = reduce(lambda a, b: a & b, [F.col(f"{n}k").eqNullSafe(F.col(f"{n}g")) for n in names])
    within = F.expr(f"__p - __start * {wide}L")
    spots = held.join(sizes, match).withColumn("__q", within).select(
        "__p", F.expr("__q div __g").alias("__ri"), F.expr("__start + __q % __g").alias("__li")
    )
    right = ordinal.positions(minor.df, minor.order, "__n")
    out = spots.join(numbered, F.col("__li") == F.col("__m")).join(right, F.col("__ri") == F.col("__n"))
    return out.orderBy("__p").drop("__p", "__ri", "__li", "__m", "__n", *names)
