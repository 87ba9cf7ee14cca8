"""CSV files as numbered text rows."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions.props import PROPERTY, quoted
from entityframe.session import stage

HEADER_CANDIDATES = 10


@dataclass
class RawTable:
    """Text rows ready for ingestion.

    ``df`` holds the cells of ``columns`` (named with a leading ``@``, apart from any other), a ``row_number`` (of the record in its file, from 1) and the
    ``order`` columns; ``chunk`` is a bounded slice number that grows with that order.
    """

    df: DataFrame
    columns: list[str]
    order: list[str]
    chunk: Column
    labels: list[str] = field(default_factory=list)
    header_row: int = 0
    candidates: list[tuple[int, list[str], bool]] = field(default_factory=list)

    def cell(self, name: str) -> Column:
        return F.col(quoted(PROPERTY + name))

    def texts(self) -> DataFrame:
        """The cells under their own names."""
        return self.df.select(*[self.cell(c).alias(c) for c in self.columns])


ROWS_PER_CHUNK = 1_000_000


def raw_table(df: DataFrame, columns: list[str], row_number: str, header_row: int = 0) -> RawTable:
    """Text columns of any table, numbered by one of its columns."""
    cells = [F.col(quoted(c)).alias(PROPERTY + c) for c in columns]
    rows = df.select(*cells, F.col(row_number).cast("bigint").alias("row_number"))
    chunk = F.floor(F.col("row_number") / ROWS_PER_CHUNK)
    rows = rows.filter(~all_blank(columns))
    return RawTable(rows, columns, ["row_number"], chunk, list(columns), header_row)


def all_blank(columns: list[str]) -> Column:
    blank = F.lit(True)
    for c in columns:
        blank = blank & F.coalesce(F.trim(F.col(quoted(PROPERTY + c))) == "", F.lit(True))
    return blank


def clean_headers(cells: list[str]) -> list[str]:
    """Column names from header labels.

    Blanks, dots and dashes read as underscores, outer ones go, a label without anything left is named
    by its place. Names are told apart without regard to case, as columns are: the n-th of equal ones
    gets the suffix ``_n``.
    """
    plain = [cell.strip().translate(str.maketrans(" .-", "___")).strip("_") for cell in cells]
    named = [name or f"column_{i}" for i, name in enumerate(plain, start=1)]
    folded = [name.casefold() for name in named]
    nth = [folded[: i + 1].count(f) for i, f in enumerate(folded)]
    return [name if n == 1 else f"{name}_{n}" for name, n in zip(named, nth)]


def _cells(record: str) -> list[str]:
    return next(csv.reader([record.removeprefix("\ufeff")], skipinitialspace=True), [])


def _full(row: list[str]) -> bool:
    return any(cell.strip() for cell in row)


def _records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Non-empty records as text with their place, staged: ``record, row_number, __file, __block``.

    Files are numbered each on its own. With ``multi_line`` the parser finds the records: all their
    text lands in the column for what does not fit the one-column shape.
    """
    if multi_line:
        shape = T.StructType([T.StructField("one", T.StringType()), T.StructField("all", T.StringType())])
        read = spark.read.schema(shape).options(header=False, mode="PERMISSIVE", escape='"', multiLine=True, columnNameOfCorruptRecord="all").csv(path)
        text = F.coalesce("all", "one")
    else:
        read, text = spark.read.text(path), F.col("value")
    placed = read.select(text.alias("record"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    # Numbered after the filter: the records of a block stand together in its task, so their numbers have no gaps.
    staged = stage(placed.filter(F.trim("record") != "").withColumn("__at", F.monotonically_increasing_id()), "csv")
    # What is left to add follows from the counts of the blocks before: one line a block.
    parts = staged.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    return staged.join(offsets, ["__file", "__block"]).select("record", (F.col("__at") + F.col("__add")).alias("row_number"), "__file", "__block")


def read_csv(spark: SparkSession, path: str, header_row: int | None = None, multi_line: bool = False) -> RawTable:
    """Read a CSV file, or a folder of files that share a header, as text rows.

    The header is the first non-blank record or the chosen one, wherever it stands; short rows are
    padded, long ones cut, blank ones dropped. Records are staged once with their number in the file,
    which later passes read. Files of a folder come in the order of their paths, and each has its
    header at the same place.
    """
    numbered = _records(spark, path, multi_line)
    first_file = numbered.agg(F.min("__file")).first()[0]
    if first_file is None:
        raise ValueError("no rows found in file")
    own = numbered.filter(F.col("__file") == first_file)
    full = F.col("record").rlike(r'[^\s,"\x{FEFF}]')
    found = own.filter(full).orderBy("row_number").limit(HEADER_CANDIDATES).collect()
    if header_row is None:
        if not found:
            raise ValueError("header row could not be detected")
        at, header = found[0]["row_number"] - 1, found[0]["record"]
    else:
        at = header_row
        chosen = own.filter(F.col("row_number") == at + 1).select("record").first() if at >= 0 else None
        if chosen is None:
            raise ValueError(f"header row index {at} out of range")
        header = chosen["record"]
        if not _full(_cells(header)):
            raise ValueError(f"selected header row {at + 1} is empty")
    labels = _cells(header)
    columns = clean_headers(labels)
    shape = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    options = {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "escape": '"'}
    parsed = numbered.filter(F.col("row_number") > at + 1).withColumn("__cells", F.from_csv("record", shape.simpleString()[7:-1].replace(":", " "), options))
    body = parsed.select(*[F.col(f"__cells.c{i}").alias(PROPERTY + name) for i, name in enumerate(columns)], "row_number", "__file", "__block")
    candidates = [(r["row_number"] - 1, [c.strip() for c in _cells(r["record"])], r["row_number"] - 1 == at) for r in found]
    return RawTable(
        body.filter(~all_blank(columns)),
        columns,
        ["__file", "row_number"],
        F.struct("__file", "__block"),
        [c.strip() for c in labels],
        at,
        candidates,
    )
