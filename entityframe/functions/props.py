"""One accessor over a property bag, whether it is a typed struct or a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import values


PROPERTY = "@"  # marks a property column in an entity frame that keeps its bag flat


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def variant_path(key: str) -> str:
    return f"$['{key}']" if "'" not in key else f'$["{key}"]'


class Bag:
    """Property bag ``col`` of Spark type ``dtype``.

    In a struct, a missing property and a null one are the same; a VARIANT keeps them apart.
    """

    def __init__(self, col: Column, dtype: T.DataType):
        if not isinstance(dtype, (T.StructType, T.VariantType)):
            raise TypeError(f"a property bag is a struct or a variant, not {dtype.simpleString()}")
        self.col = col
        self.dtype = dtype

    @classmethod
    def of(cls, df: DataFrame) -> Bag:
        """Bag of an entity frame: its ``properties`` column, or its ``@`` columns."""
        if "properties" in df.columns:
            return cls(F.col("properties"), df.schema["properties"].dataType)
        return FlatBag(df, PROPERTY)

    @property
    def is_struct(self) -> bool:
        return isinstance(self.dtype, T.StructType)

    def names(self) -> list[str]:
        """Property names a struct declares; a VARIANT declares none."""
        return self.dtype.names if self.is_struct else []

    def _field(self, key: str) -> Column:
        return self.col.getField(key)

    def type_of(self, key: str) -> T.DataType | None:
        if not self.is_struct:
            return T.VariantType()
        return self.dtype[key].dataType if key in self.dtype.names else None

    def value(self, key: str) -> Column:
        if self.is_struct:
            if key not in self.dtype.names:
                return F.lit(None).cast("string")
            return self._field(key)
        return F.try_variant_get(self.col, variant_path(key), "variant")

    def has(self, key: str) -> Column:
        if self.is_struct:
            return self.value(key).isNotNull() if key in self.dtype.names else F.lit(False)
        return self.value(key).isNotNull()

    def is_null(self, key: str) -> Column:
        """Absent, or present as JSON null."""
        value = self.value(key)
        if isinstance(self.type_of(key), T.VariantType):
            return value.isNull() | F.is_variant_null(value)
        return value.isNull()

    def text(self, key: str) -> Column:
        dtype = self.type_of(key)
        if dtype is None:
            return F.lit(None).cast("string")
        return values.text_of(self.value(key), dtype)

    def equals(self, key: str, text: str) -> Column:
        """Text equality; null for an absent property, so that the bare test can reach the scan."""
        dtype = self.type_of(key)
        if dtype is None:
            return F.lit(False)
        return values.equals_text(self.value(key), dtype, text)

    def isin(self, key: str, texts) -> Column:
        dtype = self.type_of(key)
        if dtype is None:
            return F.lit(False)
        if isinstance(dtype, T.StringType):
            return self.value(key).isin(list(texts))
        test = F.lit(False)
        for text in texts:
            test = test | self.equals(key, text)
        return test

    def typed(self, key: str, ddl: str) -> Column:
        dtype = self.type_of(key)
        if isinstance(dtype, T.VariantType):
            return F.try_variant_get(self.value(key), "$", ddl)
        return self.value(key).try_cast(ddl)

    def number(self, key: str) -> Column:
        """The value as a double if its JSON type is a number, else null; text never counts."""
        dtype = self.type_of(key)
        value = self.value(key)
        if isinstance(dtype, T.VariantType):
            return F.when(
                values.variant_is(value, *values.VARIANT_NUMBERS), F.try_variant_get(value, "$", "double")
            )
        if isinstance(dtype, (*values.INTEGRAL, *values.FLOATING, T.DecimalType)):
            return value.cast("double")
        return F.lit(None).cast("double")

    def string(self, key: str) -> Column:
        """The value if its JSON type is a string, else null."""
        dtype = self.type_of(key)
        if isinstance(dtype, T.VariantType):
            value = self.value(key)
            return F.when(values.variant_is(value, "STRING"), F.try_variant_get(value, "$", "string"))
        if isinstance(dtype, T.StringType):
            return self.value(key)
        if isinstance(dtype, values.TIMES):
            return self.text(key)
        return F.lit(None).cast("string")

    def texts(self, key: str) -> Column:
        dtype = self.type_of(key)
        if dtype is None:
            return F.array().cast("array<string>")
        return values.text_list(self.value(key), dtype)

    def ids(self, key: str, norm=values.uuid_norm) -> Column:
        dtype = self.type_of(key)
        if dtype is None:
            return F.array().cast("array<string>")
        return values.id_list(self.value(key), dtype, norm)

    def raw_items(self, key: str) -> Column:
        """Array elements as texts with duplicates kept; null unless the value is an array."""
        dtype = self.type_of(key)
        value = self.value(key)
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda x: values.text_of(x, dtype.elementType))
        if isinstance(dtype, T.VariantType):
            items = F.try_variant_get(value, "$", "array<variant>")
            return F.when(values.variant_is(value, "ARRAY"), F.transform(items, values.variant_text))
        return F.lit(None).cast("array<string>")

    def keys(self) -> Column:
        if self.is_struct:
            present = [
                F.when(self.value(name).isNotNull(), F.lit(name)) for name in self.dtype.names
            ]
            if not present:
                return F.array().cast("array<string>")
            return F.filter(F.array(*present), lambda x: x.isNotNull())
        return F.map_keys(F.try_variant_get(self.col, "$", "map<string,variant>"))

    def variant(self) -> Column:
        if not self.is_struct:
            return self.col
        return F.try_parse_json(self.json()) if self._has_times() else F.to_variant_object(self.col)

    def _has_times(self) -> bool:
        return any(isinstance(f.dataType, values.TIMES) for f in self.dtype.fields)

    def json(self) -> Column:
        """Compact JSON text of the bag; absent properties are left out."""
        if not self.is_struct:
            return F.to_json(self.col)
        if not self._has_times():
            return F.to_json(self.col)
        fields = [
            (values.time_text(self.value(f.name)) if isinstance(f.dataType, values.TIMES) else self.value(f.name)).alias(
                f.name
            )
            for f in self.dtype.fields
        ]
        return F.to_json(F.struct(*fields))

    def leaves(self) -> Column:
        """Leaves as ``array<struct<key, value>>``, values JSON-encoded."""
        if not self.is_struct:
            return values.flatten_variant(self.col)
        parts = [values.leaves_of(F.lit(n), self.value(n), self.type_of(n)) for n in self.names()]
        return F.concat(*parts) if parts else F.array().cast(values.LEAVES)

    def edited(self, keep=None, **changes: Column) -> Bag:
        """Struct bag with only ``keep`` (all when None), then ``changes`` set (None drops)."""
        if not self.is_struct:
            raise TypeError("only struct bags are edited in place; conform the variant first")
        names = [n for n in self.dtype.names if keep is None or n in keep]
        cols = {n: (self.value(n), self.dtype[n].dataType) for n in names}
        for name, change in changes.items():
            if change is None:
                cols.pop(name, None)
            else:
                cols[name] = (change, None)
        if not cols:
            return Bag(F.struct(), T.StructType())
        struct = F.struct(*[c.alias(n) for n, (c, _) in cols.items()])
        return Bag(struct, T.StructType([T.StructField(n, t or T.NullType()) for n, (_, t) in cols.items()]))


class FlatBag(Bag):
    """A struct bag whose properties are columns of their own, named ``prefix`` + property.

    Plain columns prune and push down in every plan; a struct built on the way only in some.
    """

    def __init__(self, df: DataFrame, prefix: str):
        fields = [f for f in df.schema.fields if f.name.startswith(prefix)]
        self.dtype = T.StructType([T.StructField(f.name[len(prefix) :], f.dataType) for f in fields])
        self.prefix = prefix

    @property
    def col(self) -> Column:
        """The properties as one struct."""
        return F.struct(*[self._field(n).alias(n) for n in self.dtype.names])

    def _field(self, key: str) -> Column:
        return F.col(quoted(self.prefix + key))
