"""CSV export of an entity type or a transformation result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import values
from entityframe.functions.props import Bag, quoted
from entityframe.model import EntitySchema
from entityframe.operators import predicates


def cell(c: Column, dtype: T.DataType) -> Column:
    """Export form of a value: null is empty, times are RFC 3339 to the second, objects JSON."""
    if isinstance(dtype, values.TIMES):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        text = values.text_of(c, dtype)
    return F.coalesce(text, F.lit(""))


def type_rows(df: DataFrame, schema: EntitySchema, filters=()) -> DataFrame:
    """One text column per schema field, in schema order; filters follow the listing rules."""
    bag = Bag.of(df)
    kept = df.filter(predicates.listing_filters(bag, filters))
    cols = []
    for f in schema.fields:
        dtype = bag.type_of(f.name)
        value = F.lit("") if dtype is None else cell(bag.value(f.name), dtype)
        cols.append(value.alias(f.name))
    return kept.select(*cols)


def result_rows(result, limit: int | None = None, offset: int = 0, separator: str = ".") -> DataFrame:
    """``alias.field`` columns of a compiled transformation; a missing entity gives empty cells."""
    flat = result.flat(limit, offset, separator, text=False)
    return flat.select(*[cell(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in flat.schema.fields])


def write_csv(rows: DataFrame, path: str) -> None:
    """One folder of CSV parts, each with the header; no part is larger than one task's rows. Cells keep their blanks."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("errorifexists").options(header=True, escape='"', emptyValue="", **blanks).csv(path)


def read_back(spark, path: str, columns: list[str]) -> DataFrame:
    """An exported folder as text rows, empty cells as empty text."""
    shape = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(shape)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
        .fillna("")
    )


def export_log(rows: DataFrame, label: str) -> DataFrame:
    """One-row count of what an export holds."""
    return rows.agg(F.count("*").alias("rows_exported")).withColumn("export", F.lit(label))
