"""Tree paths: dot-separated labels held as text. All functions build Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_PATH = r"^[0-9]+(\.[0-9]+)*$"
LABEL_PATH = r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*$"


def components(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, r"\."))


def depth(path: Column) -> Column:
    return F.size(components(path))


def parent(path: Column) -> Column:
    """Text before the last dot; a root label has the empty parent."""
    return F.regexp_extract(path, r"^(.*)\.[^.]*$", 1)


def last_label(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def prefixes(path: Column) -> Column:
    """Every label-prefix of the path, itself last."""
    parts = F.split(path, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )


def is_ancestor(path: Column, of: Column) -> Column:
    return (path == "") | F.startswith(of, F.concat(path, F.lit(".")))


def is_child(path: Column, of: Column) -> Column:
    return parent(path) == of


def is_sibling(left: Column, right: Column) -> Column:
    return (parent(left) == parent(right)) & (left != right)


def is_valid(path: Column, numeric: bool = True) -> Column:
    """Digits-only labels by default; ``numeric=False`` allows any label characters."""
    return F.coalesce(path.rlike(NUMERIC_PATH if numeric else LABEL_PATH), F.lit(False))


def next_sibling(path: Column) -> Column:
    """The path with its last (numeric) label plus one; an empty path gives "1"."""
    up = parent(path)
    number = (last_label(path).try_cast("bigint") + 1).cast("string")
    return (
        F.when(path == "", F.lit("1")).when(up == "", number).otherwise(F.concat(up, F.lit("."), number))
    )


def child_path(up: Column, index: Column) -> Column:
    label = index.cast("string")
    return F.when(F.coalesce(up, F.lit("")) == "", label).otherwise(F.concat(up, F.lit("."), label))


def order_key(path: Column) -> Column:
    """Array of label numbers: orders label by label numerically, shorter first."""
    digits = F.transform(F.split(path, r"\."), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.transform(digits, lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
