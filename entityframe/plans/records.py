"""Records: a DataFrame holding one entity per alias, plus what is known about each alias.

An alias is kept flat, one column per envelope field and property, so that pruning and pushdown see
plain columns: ``alias#id``, ``alias#@property`` (or ``alias#*`` for a VARIANT bag), and a marker
``alias#?`` that is null where a record lacks the entity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions.props import Bag, FlatBag, quoted
from entityframe.model import COLUMNS, ENVELOPE
from entityframe.operators import ordinal, product

ENVELOPE_TYPES = {
    "id": T.StringType(),
    "organization_id": T.StringType(),
    "schema_id": T.StringType(),
    "entity_type": T.StringType(),
    "path": T.StringType(),
    "version": T.LongType(),
    "created_at": T.TimestampType(),
    "updated_at": T.TimestampType(),
}


def envelope_column(alias: str, name: str) -> str:
    return f"{alias}#{name}"


def property_prefix(alias: str) -> str:
    return f"{alias}#@"


def variant_column(alias: str) -> str:
    return f"{alias}#*"


def marker_column(alias: str) -> str:
    return f"{alias}#?"


def check_alias(alias: str) -> None:
    if not alias or "#" in alias:
        raise ValueError(f"alias {alias!r} may not be empty or hold '#'")


def load_expressions(df: DataFrame, alias: str) -> list[str]:
    """SQL expressions that lay an entity frame out as the flat columns of an alias."""
    check_alias(alias)

    def named(source: str, column: str) -> str:
        return f"{source} AS {quoted(column)}"

    out = [named("true", marker_column(alias))]
    out += [named(c, envelope_column(alias, c)) for c in ENVELOPE]
    bag = Bag.of(df)
    if not bag.is_struct:
        out.append(named("properties", variant_column(alias)))
    elif isinstance(bag, FlatBag):
        out += [named(quoted(bag.prefix + n), property_prefix(alias) + n) for n in bag.names()]
    else:
        out += [named(f"properties.{quoted(n)}", property_prefix(alias) + n) for n in bag.names()]
    return out


def entity_columns(alias: str, envelope: dict[str, Column], bag: Bag) -> list[Column]:
    """The flat columns of one entity."""
    check_alias(alias)
    cols = [F.lit(True).alias(marker_column(alias))]
    cols += [envelope[c].alias(envelope_column(alias, c)) for c in ENVELOPE]
    if bag.is_struct:
        cols += [bag.value(n).alias(property_prefix(alias) + n) for n in bag.names()]
    else:
        cols.append(bag.col.alias(variant_column(alias)))
    return cols


@dataclass(frozen=True)
class AliasInfo:
    """``types`` are the entity types the alias may hold (None: unknown); ``nullable`` says a
    record may lack the entity."""

    types: frozenset[str] | None
    nullable: bool = False


@dataclass
class Records:
    df: DataFrame | None
    aliases: dict[str, AliasInfo]
    order: list[tuple[str, bool]]  # hidden order columns and whether they ascend
    sorted: bool = False
    factors: list[Records] = field(default_factory=list)  # set instead of df for a cross product
    counter: Callable[[], DataFrame] | None = None

    def columns_of(self, alias: str) -> list[str]:
        return [c for c in self.df.columns if c.startswith(f"{alias}#")]

    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if "#" not in c]

    def bag(self, alias: str) -> Bag:
        name = variant_column(alias)
        if name in self.df.columns:
            return Bag(F.col(quoted(name)), T.VariantType())
        return FlatBag(self.df, property_prefix(alias))

    def envelope(self, alias: str, name: str) -> Column:
        return F.col(quoted(envelope_column(alias, name)))

    def envelopes(self, alias: str) -> dict[str, Column]:
        return {c: self.envelope(alias, c) for c in ENVELOPE}

    def present(self, alias: str) -> Column:
        if not self.aliases[alias].nullable:
            return F.lit(True)
        return F.col(quoted(marker_column(alias))).isNotNull()

    def having(self, alias: str) -> Records:
        """Only the records that have an entity under the alias."""
        if not self.aliases[alias].nullable:
            return self
        aliases = {**self.aliases, alias: replace(self.aliases[alias], nullable=False)}
        return replace(self, df=self.df.filter(self.present(alias)), aliases=aliases, counter=None)

    def resolve(self, wanted: str, what: str) -> str:
        """The wanted alias, or the only one there is."""
        if wanted and wanted in self.aliases:
            return wanted
        if len(self.aliases) == 1:
            return next(iter(self.aliases))
        if not wanted:
            raise ValueError(f"{what} node needs an alias: the records hold {sorted(self.aliases)}")
        raise ValueError(f"{what} alias {wanted!r} not found in {sorted(self.aliases)}")

    def order_columns(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_first() for c, up in self.order]

    def with_df(self, df: DataFrame, **changes) -> Records:
        return replace(self, df=df, **changes)

    def page(self, limit: int | None, offset: int) -> Records:
        if self.factors:
            parts = [product.Factor(f.df, f.order_columns()) for f in self.factors]
            return Records(product.page(parts, limit, offset), self.aliases, self.order, self.sorted)
        return replace(self, df=ordinal.page(self.df, self.order_columns(), limit, offset), counter=None)

    def total(self) -> DataFrame:
        """One-row exact count; products and literal joins count without forming their rows."""
        if self.counter is not None:
            return self.counter()
        if self.factors:
            return product.total([product.Factor(f.df, []) for f in self.factors])
        return self.df.agg(F.count("*").alias("total"))

    def entity(self, alias: str) -> Column:
        """The alias as one struct, null where the record lacks the entity."""
        cols = [
            self.bag(alias).col.alias(c) if c == "properties" else self.envelope(alias, c).alias(c) for c in COLUMNS
        ]
        whole = F.struct(*cols)
        return F.when(self.present(alias), whole) if self.aliases[alias].nullable else whole
