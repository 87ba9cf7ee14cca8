"""Property predicates: DAG filters, listing filters, saved-join filters and searches."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import values
from entityframe.functions.props import Bag
from entityframe.model import PropertyFilter


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def property_filters(bag: Bag, filters) -> Column:
    """DAG filter rules, AND-ed: blank values test nothing, ``exists=False`` also takes an empty
    or null value unless a value or list is asked for too."""
    tests = []
    for f in filters or ():
        if f.exists is True:
            tests.append(bag.has(f.key))
        elif f.exists is False:
            absent = ~bag.has(f.key)
            if not f.value and not f.in_array:
                absent = absent | bag.is_null(f.key) | F.coalesce(bag.text(f.key) == "", F.lit(False))
            tests.append(absent)
        if f.value:
            tests.append(bag.equals(f.key, f.value))
        if f.in_array:
            tests.append(bag.isin(f.key, f.in_array))
    return all_of(tests)


def pattern(term: str) -> str:
    """A contains pattern: ``%`` and ``_`` are wildcards, and a backslash makes the next character plain."""
    out, rest = [], iter(term)
    for c in rest:
        if c == "\\":
            c = next(rest, "\\")
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append(c)
    return f"%{''.join(out)}%"


def listing_filters(bag: Bag, filters) -> Column:
    """Listing rules: case-insensitive contains; a blank value asks only for a non-null one.

    ``%`` and ``_`` in the value act as wildcards; ``exists`` and ``in_array`` are not looked at.
    """
    tests = []
    for f in filters or ():
        if not f.key.strip():
            continue
        text = bag.text(f.key.strip())
        wanted = (f.value or "").strip()
        tests.append(text.ilike(pattern(wanted)) if wanted else text.isNotNull())
    return all_of(tests)


def saved_join_filters(bag: Bag, filters) -> Column:
    """Saved-join rules: strict existence, a blank value is a real test, and a list matches the
    scalar text or any array element."""
    tests = []
    for f in filters or ():
        if not f.key:
            continue
        if f.exists is not None:
            tests.append(bag.has(f.key) if f.exists else ~bag.has(f.key))
        if f.value is not None:
            tests.append(bag.equals(f.key, f.value))
        if f.in_array:
            test = bag.isin(f.key, f.in_array)
            if isinstance(bag.type_of(f.key), (T.ArrayType, T.VariantType)):
                wanted = F.array(*[F.lit(x) for x in f.in_array])
                test = test | F.arrays_overlap(bag.raw_items(f.key), wanted)
            tests.append(test)
    return all_of(tests)


def text_search(bag: Bag, term: str) -> Column:
    """Case-insensitive contains over type, path and the whole property text."""
    wanted = (term or "").strip()
    if not wanted:
        return F.lit(True)
    like = pattern(wanted)
    texts = [F.col("entity_type"), F.col("path"), bag.json()]
    return reduce(lambda a, b: a | b, [F.coalesce(t.ilike(like), F.lit(False)) for t in texts])


def range_filter(bag: Bag, key: str, low: float | None = None, high: float | None = None) -> Column:
    """Numeric value between the given bounds, both inclusive; anything but a number is out."""
    if isinstance(bag.type_of(key), values.INTEGRAL) and all(b is None or abs(b) < 2**62 for b in (low, high)):
        # Whole numbers compare as such, so that the test reaches the scan.
        whole = bag.value(key)
        bounds = [whole >= F.lit(math.ceil(low))] if low is not None else []
        bounds += [whole <= F.lit(math.floor(high))] if high is not None else []
        return all_of([whole.isNotNull(), *bounds])
    number = bag.number(key)
    tests = [number.isNotNull()]
    if low is not None:
        tests.append(number >= F.lit(float(low)))
    if high is not None:
        tests.append(number <= F.lit(float(high)))
    return all_of(tests)


def exists_filter(bag: Bag, key: str) -> Column:
    return bag.has(key)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_filter(bag: Bag, key: str, term: str) -> Column:
    """ASCII-case-insensitive substring of a string value; an empty term matches nothing."""
    if not term:
        return F.lit(False)
    folded = "".join(c.lower() if c.isascii() else c for c in term)
    return ascii_lower(bag.string(key)).contains(folded)


# --- containment -------------------------------------------------------------------------------


def contains_json(bag: Bag, wanted: dict) -> Column:
    """JSON containment (``bag @> wanted``), compiled into typed comparisons.

    Types must agree ("2.5" is not 2.5), objects match key by key, and every element of a wanted
    array must be contained in some element of the stored one.
    """
    return all_of([_contains(bag.value(k), bag.type_of(k), v) for k, v in wanted.items()])


def _contains(c: Column, dtype: T.DataType | None, wanted) -> Column:
    if dtype is None:
        return F.lit(False)
    if isinstance(dtype, T.VariantType):
        return _variant_contains(c, wanted)
    if wanted is None:
        return F.lit(False)  # a struct keeps no JSON null apart from a missing key
    if isinstance(wanted, bool):
        return c == F.lit(wanted) if isinstance(dtype, T.BooleanType) else F.lit(False)
    if isinstance(wanted, (int, float)):
        numeric = isinstance(dtype, (*values.INTEGRAL, *values.FLOATING, T.DecimalType))
        return c == F.lit(wanted) if numeric else F.lit(False)
    if isinstance(wanted, str):
        if isinstance(dtype, (T.StringType, *values.TIMES)):
            return values.text_of(c, dtype) == F.lit(wanted)
        return F.lit(False)
    if isinstance(wanted, dict):
        if not isinstance(dtype, T.StructType):
            return F.lit(False)
        types = {f.name: f.dataType for f in dtype.fields}
        return c.isNotNull() & all_of(
            [_contains(c.getField(k), types[k], v) if k in types else F.lit(False) for k, v in wanted.items()]
        )
    if not isinstance(dtype, T.ArrayType):
        return F.lit(False)
    return c.isNotNull() & all_of([_any_item(c, lambda x, v: _contains(x, dtype.elementType, v), v) for v in wanted])


def _any_item(items: Column, contains, wanted) -> Column:
    return F.exists(items, lambda x: F.coalesce(contains(x, wanted), F.lit(False)))


def _variant_contains(v: Column, wanted) -> Column:
    if wanted is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    if isinstance(wanted, bool):
        return values.variant_is(v, "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        number = F.try_variant_get(v, "$", "double")
        return values.variant_is(v, *values.VARIANT_NUMBERS) & (number == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return values.variant_is(v, "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(wanted))
    if isinstance(wanted, dict):
        parts = F.try_variant_get(v, "$", "map<string,variant>")
        tests = [
            F.coalesce(_variant_contains(F.element_at(parts, F.lit(k)), w), F.lit(False)) for k, w in wanted.items()
        ]
        return values.variant_is(v, "OBJECT") & all_of(tests)
    items = F.try_variant_get(v, "$", "array<variant>")
    tests = [_any_item(items, _variant_contains, w) for w in wanted]
    return values.variant_is(v, "ARRAY") & all_of(tests)


__all__ = [
    "PropertyFilter",
    "all_of",
    "contains_filter",
    "contains_json",
    "exists_filter",
    "listing_filters",
    "property_filters",
    "range_filter",
    "saved_join_filters",
    "text_search",
]
