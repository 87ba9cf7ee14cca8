"""How a property value reads as text, and tests on its JSON type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType)


def double_text(c: Column) -> Column:
    """Plain decimal text: integral doubles without a fraction, no exponent in the usual range."""
    size = F.abs(c)
    whole = (c == F.floor(c)) & (size < 1e15)
    cut = lambda kind: F.rtrim(c.try_cast(kind).cast("string"), F.lit("0"))
    return (
        F.when(whole, c.try_cast("bigint").cast("string"))
        # The shortest digits that name the double; between these bounds they come without an exponent.
        .when((size >= 1e-3) & (size < 1e7), c.cast("string"))
        # 17 significant digits of the smallest value in range end 26 places behind the point.
        .when((size >= 1e-9) & (size < 1e9), cut("decimal(38,27)"))
        .when((size >= 1e-9) & (size < 1e15), cut("decimal(38,18)"))
        .otherwise(c.cast("string"))
    )


def time_text(c: Column) -> Column:
    """RFC 3339 in UTC with the fraction shortened to its last non-zero digit."""
    fraction = F.rtrim(F.date_format(c, "SSSSSS"), F.lit("0"))
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("Z"),
    )


def variant_is(v: Column, *names: str) -> Column:
    """Whether the variant's own type is one of ``names`` (schema_of_variant spelling, by prefix)."""
    kind = F.schema_of_variant(v)
    test = F.lit(False)
    for name in names:
        test = test | kind.startswith(name)
    return F.coalesce(test, F.lit(False))


VARIANT_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


_ODD_NUMBER = r"^-?[0-9.]+(\.0|E-?[0-9]+)$"  # spellings only a double has


def variant_text(v: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    odd = text.rlike(_ODD_NUMBER) & variant_is(v, "DOUBLE", "FLOAT")
    return F.when(odd, double_text(F.try_variant_get(v, "$", "double"))).otherwise(text)


def text_of(c: Column, dtype: T.DataType) -> Column:
    """Text of a value: strings raw, numbers plain, booleans true/false, nested values as JSON."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, FLOATING):
        return double_text(c.cast("double"))
    if isinstance(dtype, TIMES):
        return time_text(c)
    if isinstance(dtype, T.VariantType):
        return variant_text(c)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def equals_text(c: Column, dtype: T.DataType, text: str) -> Column:
    """``text_of(c) == text`` written on the typed column where possible, so scans can use it."""
    if isinstance(dtype, T.StringType):
        return c == F.lit(text)
    if isinstance(dtype, INTEGRAL):
        try:
            number = int(text)
        except ValueError:
            return F.lit(False)
        if str(number) != text or not -(2**63) <= number < 2**63:
            return F.lit(False)
        return c == F.lit(number)
    if isinstance(dtype, T.BooleanType):
        return c == F.lit(text == "true") if text in ("true", "false") else F.lit(False)
    if isinstance(dtype, T.DoubleType):
        try:
            number = float(text)
        except ValueError:
            return F.lit(False)
        # The typed test narrows the scan; the text test keeps "1.0" different from "1".
        return (c == F.lit(number)) & (text_of(c, dtype) == F.lit(text))
    return text_of(c, dtype) == F.lit(text)


def as_variant(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return c
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(c)
    if isinstance(dtype, TIMES):
        return time_text(c).cast("variant")
    return c.cast("variant")


def text_list(c: Column, dtype: T.DataType) -> Column:
    """A scalar or (nested) list as a list of distinct non-empty texts, in order."""
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if isinstance(inner, T.ArrayType):
            return text_list(F.flatten(c), inner)
        texts = F.transform(c, lambda x: text_of(x, inner))
    elif isinstance(dtype, T.VariantType):
        items = F.try_variant_get(c, "$", "array<variant>")
        texts = F.when(variant_is(c, "ARRAY"), F.transform(items, variant_text)).otherwise(
            F.array(variant_text(c))
        )
    else:
        texts = F.array(text_of(c, dtype))
    kept = F.filter(texts, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


# --- UUIDs -------------------------------------------------------------------------------------

HEX_GROUPS = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def uuid_norm(c: Column) -> Column:
    """Canonical lower-case UUID text, or null: accepts urn:uuid:, braces and 32 bare digits."""
    low = F.lower(c)
    bare = F.regexp_replace(
        low, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5"
    )
    inner = F.regexp_extract(bare, "^(?:urn:uuid:)?(" + HEX_GROUPS + ")$", 1)
    braced = F.regexp_extract(bare, r"^\{(" + HEX_GROUPS + r")\}$", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), F.nullif(braced, F.lit("")))


def trim_norm(c: Column) -> Column:
    """Key normaliser for stores whose ids are plain texts."""
    trimmed = F.trim(c)
    return F.when(trimmed != "", trimmed)


def id_list(c: Column, dtype: T.DataType, norm=uuid_norm) -> Column:
    """Distinct normalised ids of a reference value; what does not normalise is dropped."""
    plain = isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType)
    ids = F.transform(c if plain else text_list(c, dtype), norm)
    return F.coalesce(without_nulls(ids), F.array().cast("array<string>"))


def without_nulls(items: Column) -> Column:
    """Distinct non-null items."""
    return F.array_except(items, F.array(F.lit(None).cast("string")))


# --- flattening --------------------------------------------------------------------------------


LEAVES = "array<struct<key:string,value:string>>"


def _leaf(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def json_string(c: Column) -> Column:
    """A text as a JSON string; only texts that need escapes go through the JSON writer."""
    escaped = F.to_json(F.array(c))
    return F.when(
        c.rlike(r'["\\\x00-\x1f]'), F.substring(escaped, F.lit(2), F.length(escaped) - 2)
    ).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def leaves_of(key: Column, c: Column, dtype: T.DataType) -> Column:
    """Leaves of a typed value as ``array<struct<key, value>>``; a null property has none.

    Structs are opened when the plan is built, lists by row; empty ones stay as leaves.
    """
    if isinstance(dtype, T.VariantType):
        return F.coalesce(flatten_variant(c, key), F.array().cast(LEAVES))
    if isinstance(dtype, T.StructType):
        parts = [
            leaves_of(F.concat(key, F.lit("." + f.name)), c.getField(f.name), f.dataType) for f in dtype.fields
        ]
        opened = F.concat(*parts) if parts else F.array().cast(LEAVES)
        empty = F.when(F.size(opened) == 0, F.array(_leaf(key, F.lit("{}")))).otherwise(opened)
        return F.when(c.isNull(), F.array().cast(LEAVES)).otherwise(empty)
    if isinstance(dtype, T.ArrayType):

        def item(x: Column, i: Column) -> Column:
            at = F.concat(key, F.lit("["), i.cast("string"), F.lit("]"))
            return F.when(x.isNull(), F.array(_leaf(at, F.lit("null")))).otherwise(leaves_of(at, x, dtype.elementType))

        empty = F.array(_leaf(key, F.lit("[]")))
        opened = F.when(F.size(c) == 0, empty).otherwise(F.flatten(F.transform(c, item)))
        return F.when(c.isNull(), F.array().cast(LEAVES)).otherwise(opened)
    text = text_of(c, dtype)
    if isinstance(dtype, (T.StringType, *TIMES)):
        text = json_string(text)
    return F.when(c.isNull(), F.array().cast(LEAVES)).otherwise(F.array(_leaf(key, text)))


def flatten_variant(v: Column, prefix: Column | None = None) -> Column:
    """All leaves of a JSON value as ``array<struct<key, value>>``: keys like ``a.b`` and ``a[0]``,
    values JSON-encoded; empty containers and nulls stay as leaves. Row-local at any depth.
    """
    # Containers open level by level. The value's own schema bounds the levels: every level of
    # nesting opens a bracket in it, except inside lists of mixed items, whose depth is then read
    # from the JSON text (the deepest bracket outside string literals).
    schema = F.schema_of_variant(v)
    nested = F.length(schema) - F.length(F.replace(schema, F.lit("<"), F.lit("")))
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(v), r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(
        F.filter(F.split(brackets, ""), lambda x: x != ""), lambda x: F.when(x.isin("{", "["), 1).otherwise(-1)
    )
    deepest = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, x: F.struct((acc.now + x).alias("now"), F.greatest(acc.top, acc.now + x).alias("top")),
        lambda acc: acc.top,
    )
    depth = F.when(schema.contains("VARIANT"), deepest).otherwise(nested)

    def open_up(x: Column) -> Column:
        key = F.when(x.key == "", F.lit("")).otherwise(F.concat(x.key, F.lit(".")))
        entries = F.map_entries(F.try_variant_get(x.value, "$", "map<string,variant>"))
        items = F.try_variant_get(x.value, "$", "array<variant>")
        children = F.coalesce(
            F.transform(entries, lambda e: _leaf(F.concat(key, e.key), e.value)),
            F.transform(
                items, lambda e, i: _leaf(F.concat(x.key, F.lit("["), i.cast("string"), F.lit("]")), e)
            ),
        )
        # The one-item list names the children, so that they are worked out once.
        whole = F.transform(F.array(children), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(x)))
        return F.get(whole, F.lit(0))

    start = prefix if prefix is not None else F.lit("")
    opened = F.aggregate(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        F.array(_leaf(start, v)),
        lambda acc, _: F.flatten(F.transform(acc, open_up)),
    )

    def encoded(x: Column) -> Column:
        kind = F.schema_of_variant(x.value)
        text = F.try_variant_get(x.value, "$", "string")
        number = double_text(F.try_variant_get(x.value, "$", "double"))
        return _leaf(
            x.key,
            F.when(kind == "STRING", json_string(text))
            .when(kind.isin("DOUBLE", "FLOAT"), number)
            .otherwise(F.to_json(x.value)),
        )

    return F.transform(F.filter(opened, lambda x: x.key != ""), encoded)
