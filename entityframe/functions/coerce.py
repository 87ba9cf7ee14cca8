"""Text cells to typed values: type tests, coercions, slugs. All functions build Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from entityframe.model import FieldType

# Accepted spellings.
TRUE_TEXTS = ("1", "t", "true", "yes", "y")
FALSE_TEXTS = ("0", "f", "false", "no", "n")
BOOL_LIKE = ("1", "t", "true", "yes", "0", "f", "false", "no")  # y and n coerce but do not suggest a boolean

INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE_TEXT = r"(?i)^[+-]?inf(inity)?$"

# Timestamp shapes: zoned, zone-less with an optional time, and dates with slashes.
ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?)?$"
YEAR_FIRST = r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"
YEAR_LAST = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"


def to_integer(c: Column) -> Column:
    """Integer text, or float text without a fraction ("1e3"); anything else is null."""
    whole = _integral(c.try_cast("double"))
    return F.when(c.rlike(INT_TEXT), F.coalesce(c.try_cast("bigint"), whole)).when(c.rlike(FLOAT_TEXT), whole)


def _integral(d: Column) -> Column:
    return F.when((d == F.floor(d)) & (F.abs(d) < 9.2e18), d.try_cast("bigint"))


def to_float(c: Column) -> Column:
    """Decimal or exponent text within range, or a named infinity or NaN."""
    number = c.try_cast("double")
    return (
        F.when(c.rlike(FLOAT_TEXT), F.when(F.abs(number) < float("inf"), number))
        .when(c.rlike(INFINITE_TEXT), F.when(c.startswith("-"), float("-inf")).otherwise(float("inf")))
        .when(F.lower(c) == "nan", float("nan"))
    )


def to_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False)


def to_timestamp(c: Column) -> Column:
    """First shape that reads, month before day; zone-less texts are UTC."""
    text = F.trim(c)

    def part(at: int, size: int) -> Column:
        return F.substring(text, at, size)

    def day(year: Column, month: Column, of_month: Column) -> Column:
        return F.concat(year, F.lit("-"), month, F.lit("-"), of_month, F.lit("T00:00:00Z")).try_cast("timestamp")

    clock = F.when(F.length(text) == 10, F.lit("T00:00:00Z")).otherwise(
        F.concat(F.replace(F.substring(text, 11, 40), F.lit(","), F.lit(".")), F.lit("Z"))
    )
    year = part(7, 4)
    return (
        F.when(
            part(5, 1) == "-",
            F.when(text.rlike(PLAIN), F.concat(part(1, 10), clock).try_cast("timestamp")).when(
                text.rlike(ZONED), text.try_cast("timestamp")
            ),
        )
        .when(part(5, 1) == "/", F.when(text.rlike(YEAR_FIRST), day(part(1, 4), part(6, 2), part(9, 2))))
        .when(
            part(3, 1) == "/",
            F.when(
                text.rlike(YEAR_LAST),
                F.coalesce(day(year, part(1, 2), part(4, 2)), day(year, part(4, 2), part(1, 2))),
            ),
        )
    )


# Which types a text could be, one bit each.
IS_BOOL, IS_INT, IS_FLOAT, IS_TIMESTAMP = 1, 2, 4, 8


def kinds(c: Column) -> Column:
    """The types a trimmed, non-blank text fits, as a set of bits; one shape test leads to each."""
    number = c.try_cast("double")
    return (
        F.when(
            c.rlike(INT_TEXT), F.when(c.isin("0", "1"), IS_BOOL | IS_INT | IS_FLOAT).otherwise(IS_INT | IS_FLOAT)
        )
        .when(
            c.rlike(FLOAT_TEXT),
            F.when(F.abs(number) == float("inf"), 0).when(number == F.floor(number), IS_INT | IS_FLOAT).otherwise(IS_FLOAT),
        )
        .when(F.lower(c).isin(*BOOL_LIKE), IS_BOOL)
        .when(to_timestamp(c).isNotNull(), IS_TIMESTAMP)
        .when(c.rlike(INFINITE_TEXT) | (F.lower(c) == "nan"), IS_FLOAT)
        .otherwise(0)
    )


def quoted_text(c: Column) -> Column:
    """The text in double quotes, with quotes and backslashes escaped."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


READERS = {
    FieldType.INTEGER: (to_integer, "integer"),
    FieldType.FLOAT: (to_float, "float"),
    FieldType.BOOLEAN: (to_boolean, "boolean"),
    FieldType.TIMESTAMP: (to_timestamp, "timestamp: unrecognized timestamp format"),
}


def value(cell: Column, kind: FieldType) -> Column:
    """Typed value of a trimmed, non-blank cell; null where it does not read."""
    if kind in READERS:
        return READERS[kind][0](cell)
    return F.try_parse_json(cell) if kind is FieldType.JSON else cell


def error(cell: Column, read: Column, kind: FieldType) -> Column | None:
    """Message for a cell whose value did not read; None for kinds that always do."""
    failed = cell.isNotNull() & read.isNull()
    if kind in READERS:
        return F.when(failed, F.concat(F.lit("unable to coerce "), quoted_text(cell), F.lit(f" to {READERS[kind][1]}")))
    return F.when(failed, F.lit("invalid json payload")) if kind is FieldType.JSON else None


def slug(c: Column) -> Column:
    """Lower-case label of ``[a-z0-9_]``, runs collapsed, ends trimmed, "n" before a leading digit."""
    text = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")
    return F.when(text.rlike("^[^a-z_]"), F.concat(F.lit("n"), text)).otherwise(text)
