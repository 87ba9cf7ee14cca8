"""Validate property bags against a schema: errors and warnings as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import coerce, values
from entityframe.functions.props import Bag
from entityframe.model import EntitySchema, Field, FieldType

# How messages name JSON types.
TYPE_NAMES = {
    "string": "string",
    "number": "float64",
    "boolean": "bool",
    "object": "map[string]interface {}",
    "array": "[]interface {}",
}
_VARIANT_KINDS = {
    "string": ("STRING",),
    "number": values.VARIANT_NUMBERS,
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def _is_kind(c: Column, dtype: T.DataType, kind: str) -> Column:
    if isinstance(dtype, T.VariantType):
        return values.variant_is(c, *_VARIANT_KINDS[kind])
    return F.lit(_static_kind(dtype) == kind)


def _static_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, *values.TIMES)):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, T.ArrayType):
        return "array"
    return "number"


def _got(c: Column, dtype: T.DataType) -> Column:
    if not isinstance(dtype, T.VariantType):
        return F.lit(TYPE_NAMES[_static_kind(dtype)])
    name = F.lit("unknown")
    for kind, spelled in TYPE_NAMES.items():
        name = F.when(_is_kind(c, dtype, kind), F.lit(spelled)).otherwise(name)
    return name


def _message(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _type_error(bag: Bag, f: Field, id_norm) -> Column:
    """Type error of a present value, or null."""
    name, c, dtype = f.name, bag.value(f.name), bag.type_of(f.name)
    none = F.lit(None).cast("string")
    is_string, is_number = _is_kind(c, dtype, "string"), _is_kind(c, dtype, "number")
    got = _got(c, dtype)
    text = bag.text(name)

    def must(what: str, ok: Column) -> Column:
        return F.when(~ok, _message(f"field '{name}' must be {what}, got ", got))

    match f.type:
        case FieldType.STRING:
            return must("a string", is_string)
        case FieldType.FILE_REFERENCE:
            return must("a file reference string", is_string)
        case FieldType.BOOLEAN:
            return must("a boolean", _is_kind(c, dtype, "boolean"))
        case FieldType.INTEGER:
            number = bag.number(name)
            whole = F.coalesce(number == F.floor(number), F.lit(False))
            digits = text.rlike(coerce.INT_TEXT) & text.try_cast("bigint").isNotNull()
            return must("an integer", is_number & whole | is_string & digits)
        case FieldType.FLOAT:
            return must("a float", is_number | is_string & coerce.to_float(text).isNotNull())
        case FieldType.TIMESTAMP:
            bad = F.when(
                ~(text.rlike(coerce.ZONED) & text.try_cast("timestamp").isNotNull()),
                F.lit(f"field '{name}' must be a valid timestamp (RFC3339)"),
            )
            if isinstance(dtype, values.TIMES):
                return none
            return F.when(~is_string, _message(f"field '{name}' must be a timestamp string, got ", got)).otherwise(bad)
        case FieldType.JSON:
            return none
        case FieldType.GEOMETRY:
            return must("a valid geometry", is_string | _is_kind(c, dtype, "object") & _has_key(c, dtype, "type"))
        case FieldType.TIMESERIES:
            return must("a valid timeseries", _is_kind(c, dtype, "array") & _all_points(c, dtype))
        case FieldType.REFERENCE:
            blank = F.when(F.trim(text) == "", F.lit(f"field '{name}' must be a non-empty reference string"))
            return F.coalesce(must("a reference string", is_string), blank)
        case FieldType.ENTITY_REFERENCE:
            blank = F.when(F.trim(text) == "", F.lit(f"field '{name}' must be a non-empty entity ID"))
            bad = F.when(id_norm(F.trim(text)).isNull(), F.lit(f"field '{name}' must be a valid UUID string"))
            return F.coalesce(must("an entity ID string", is_string), blank, bad)
        case FieldType.ENTITY_REFERENCE_ARRAY:
            is_array = _is_kind(c, dtype, "array")
            return F.coalesce(must("an array of string references", is_array), _array_error(bag, f, id_norm))
    raise ValueError(f"unknown field type: {f.type}")


def _has_key(c: Column, dtype: T.DataType, key: str) -> Column:
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(c, f"$['{key}']", "variant").isNotNull()
    if isinstance(dtype, T.StructType):
        return c.getField(key).isNotNull() if key in dtype.names else F.lit(False)
    return F.lit(False)


def _all_points(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        items, inner = F.try_variant_get(c, "$", "array<variant>"), T.VariantType()
    elif isinstance(dtype, T.ArrayType):
        items, inner = c, dtype.elementType
    else:
        return F.lit(False)
    return F.coalesce(
        F.forall(items, lambda x: _has_key(x, inner, "timestamp") & _has_key(x, inner, "value")), F.lit(False)
    )


def _array_error(bag: Bag, f: Field, id_norm) -> Column:
    """First bad element's message."""
    dtype = bag.type_of(f.name)
    if isinstance(dtype, T.VariantType):
        items, inner = F.try_variant_get(bag.value(f.name), "$", "array<variant>"), T.VariantType()
    elif isinstance(dtype, T.ArrayType):
        items, inner = bag.value(f.name), dtype.elementType
    else:
        return F.lit(None).cast("string")

    def check(x: Column) -> Column:
        text = F.trim(values.text_of(x, inner))
        return (
            F.when(~_is_kind(x, inner, "string"), _message(f"field '{f.name}' reference values must be strings, got ", _got(x, inner)))
            .when(text == "", F.lit(f"field '{f.name}' contains an empty entity ID"))
            .when(id_norm(text).isNull(), F.lit(f"field '{f.name}' contains an invalid UUID"))
        )

    return F.get(F.filter(F.transform(items, check), lambda e: e.isNotNull()), F.lit(0))


def _rule_warning(bag: Bag, f: Field) -> Column | None:
    """Message of the first broken rule of a present value, or null."""
    rules = f.rules
    if not rules:
        return None
    name = f.name
    number, text, string = bag.number(name), bag.text(name), bag.string(name)
    checks = []
    if "min" in rules:
        ok = F.coalesce(number >= F.lit(float(rules["min"])), F.lit(False))
        checks.append(F.when(~ok, _message(f"field '{name}' value ", text, f" is less than minimum {rules['min']}")))
    if "max" in rules:
        ok = F.coalesce(number <= F.lit(float(rules["max"])), F.lit(False))
        checks.append(F.when(~ok, _message(f"field '{name}' value ", text, f" is greater than maximum {rules['max']}")))
    length = F.octet_length(string)
    if "min_length" in rules:
        bad = length < F.lit(int(rules["min_length"]))
        checks.append(F.when(bad, _message(f"field '{name}' length ", length.cast("string"), f" is less than minimum {rules['min_length']}")))
    if "max_length" in rules:
        bad = length > F.lit(int(rules["max_length"]))
        checks.append(F.when(bad, _message(f"field '{name}' length ", length.cast("string"), f" is greater than maximum {rules['max_length']}")))
    if "pattern" in rules:
        bad = ~F.lower(string).contains(str(rules["pattern"]).lower())
        checks.append(F.when(bad, _message(f"field '{name}' value '", string, f"' does not match pattern '{rules['pattern']}'")))
    return F.coalesce(*checks) if checks else None


def _present_or(bag: Bag, f: Field, missing: Column, check: Column) -> Column:
    if bag.type_of(f.name) is None:
        return missing
    return F.when(bag.is_null(f.name), missing).otherwise(check)


def _texts(parts: list[Column]) -> Column:
    if not parts:
        return F.array().cast("array<string>")
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def _undeclared(bag: Bag, schema: EntitySchema, message) -> Column:
    declared = [f.name for f in schema.fields]
    if bag.is_struct:
        extra = sorted(n for n in bag.names() if n not in declared)
        return _texts([F.when(bag.has(n), message(F.lit(n))) for n in extra])
    known = F.array(*[F.lit(n) for n in declared]).cast("array<string>")
    return F.transform(F.array_sort(F.array_except(bag.keys(), known)), message)


def validate(df: DataFrame, schema: EntitySchema, id_norm=values.uuid_norm, required_only: bool = False) -> DataFrame:
    """Add ``errors``, ``warnings`` and ``is_valid``: required fields, types, undeclared properties
    (errors) and custom rules (warnings). Messages follow schema order, undeclared names last.
    """
    bag = Bag.of(df)
    none = F.lit(None).cast("string")
    errors, warnings = [], []
    for f in schema.fields:
        missing = F.lit(f"{f.name}: required field '{f.name}' is missing") if f.required else none
        if required_only or bag.type_of(f.name) is None:
            errors.append(_present_or(bag, f, missing, none))
            continue
        errors.append(_present_or(bag, f, missing, F.concat(F.lit(f"{f.name}: "), _type_error(bag, f, id_norm))))
        rule = _rule_warning(bag, f)
        if rule is not None:
            warnings.append(_present_or(bag, f, none, F.concat(F.lit(f"{f.name}: "), rule)))
    all_errors = _texts(errors)
    if not required_only:
        extra = _undeclared(bag, schema, lambda n: F.concat(n, F.lit(": property '"), n, F.lit("' is not defined in schema")))
        all_errors = F.concat(all_errors, extra)
    out = df.withColumn("errors", all_errors).withColumn("warnings", _texts(warnings))
    return out.withColumn("is_valid", F.size("errors") == 0)


def audit(df: DataFrame, schema: EntitySchema) -> DataFrame:
    """Check stored entities of a type: undeclared properties and odd timestamps only warn."""
    bag = Bag.of(df)
    none = F.lit(None).cast("string")
    errors, warnings = [], []
    wanted = {
        FieldType.STRING: ("a string", "string"),
        FieldType.INTEGER: ("an integer", "number"),
        FieldType.FLOAT: ("a float", "number"),
        FieldType.BOOLEAN: ("a boolean", "boolean"),
        FieldType.TIMESTAMP: ("a timestamp string", "string"),
    }
    for f in schema.fields:
        missing = F.lit(f"Required field '{f.name}' is missing") if f.required else none
        dtype = bag.type_of(f.name)
        if dtype is None:
            errors.append(missing)
            continue
        c = bag.value(f.name)
        check = none
        if f.type in wanted:
            what, kind = wanted[f.type]
            check = F.when(~_is_kind(c, dtype, kind), _message(f"Field '{f.name}' must be {what}, got ", _got(c, dtype)))
            if f.type is FieldType.TIMESTAMP and not isinstance(dtype, values.TIMES):
                odd = ~(bag.text(f.name).rlike(coerce.ZONED) & bag.text(f.name).try_cast("timestamp").isNotNull())
                warning = F.when(_is_kind(c, dtype, kind) & odd, F.lit(f"Field '{f.name}' timestamp format may be invalid"))
                warnings.append(_present_or(bag, f, none, warning))
        elif f.type is not FieldType.JSON:
            warnings.append(_present_or(bag, f, none, F.lit(f"Field '{f.name}' has unsupported type '{f.type.value}'")))
        errors.append(_present_or(bag, f, missing, check))
    extra = _undeclared(bag, schema, lambda n: F.concat(F.lit("Property '"), n, F.lit("' is not defined in schema")))
    out = df.withColumn("errors", _texts(errors)).withColumn("warnings", F.concat(_texts(warnings), extra))
    return out.withColumn("is_valid", F.size("errors") == 0)
