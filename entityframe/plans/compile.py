"""Compile a transformation into one lazy DataFrame plan.

Every node becomes DataFrame operations; limits apply only where a PAGINATE node or the caller asks
for them, over a total order: the stable sort the nodes describe, then creation time and id.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.functions import values
from entityframe.functions.props import Bag, quoted
from entityframe.model import ENVELOPE, FieldType, PropertyFilter
from entityframe.operators import joins, predicates, product
from entityframe.operators.joins import ANTI, INNER, LEFT, CartesianError
from entityframe.plans import nodes as N
from entityframe.plans.records import ENVELOPE_TYPES, AliasInfo, Records, entity_columns, load_expressions

# Names under which a MATERIALIZE field reads an envelope column.
SYSTEM_FIELDS = {
    "id": "id",
    "ID": "id",
    "organizationId": "organization_id",
    "organization_id": "organization_id",
    "schemaId": "schema_id",
    "schema_id": "schema_id",
    "entityType": "entity_type",
    "entity_type": "entity_type",
    "path": "path",
    "version": "version",
    "createdAt": "created_at",
    "created_at": "created_at",
    "updatedAt": "updated_at",
    "updated_at": "updated_at",
}
HOW = {"JOIN": INNER, "LEFT_JOIN": LEFT, "ANTI_JOIN": ANTI}


@dataclass(frozen=True)
class Options:
    """``key_norm`` normalises entity ids (strict UUIDs by default); ``null_safe`` lets null keys
    match in literal joins; ``allow_cartesian`` permits forming a whole cross product."""

    key_norm: object = values.uuid_norm
    null_safe: bool = True
    allow_cartesian: bool = False


class Compiler:
    def __init__(self, transformation: N.Transformation, store, options: Options = Options()):
        self.transformation = transformation
        self.store = store
        self.options = options
        self._fresh = 0

    def run(self) -> Records:
        done: dict[str, Records] = {}
        for node in self.transformation.ordered():
            inputs = [done[i] for i in node.inputs]
            done[node.id] = getattr(self, "_" + node.type.lower())(node, *inputs)
        return done[self.transformation.result_id()]

    def _name(self, stem: str) -> str:
        self._fresh += 1
        return f"__o{self._fresh}_{stem}"

    def _formed(self, r: Records) -> Records:
        """The records as a frame; a pending cross product is formed only when allowed."""
        if not r.factors:
            return r
        if not self.options.allow_cartesian:
            raise CartesianError("a whole cross product needs allow_cartesian=True; paginate it instead")
        parts = [product.Factor(f.df, f.order_columns()) for f in r.factors]
        return replace(r, df=product.whole(parts), factors=[])

    # --- one input ------------------------------------------------------------------------------

    def _load(self, node: N.Load) -> Records:
        df = self.store.load(node.entity_type)
        bag = Bag.of(df)
        if node.filters:
            df = df.filter(predicates.property_filters(bag, node.filters))
        created, key = self._name("created"), self._name("id")
        df = df.selectExpr(*load_expressions(df, node.alias), f"created_at AS {created}", f"id AS {key}")
        info = AliasInfo(frozenset([node.entity_type]))
        return Records(df, {node.alias: info}, [(created, False), (key, True)])

    def _filter(self, node: N.Filter, r: Records) -> Records:
        r = self._formed(r)
        alias = r.resolve(node.alias, "filter")
        r = r.having(alias)
        return r.with_df(r.df.filter(predicates.property_filters(r.bag(alias), node.filters)), counter=None)

    def _project(self, node: N.Project, r: Records) -> Records:
        r = self._formed(r)
        source = r.resolve(node.alias, "project")
        target = node.alias or source
        bag = r.bag(source)
        cols = []
        for c in r.df.columns:
            if not c.startswith(f"{source}#"):
                cols.append(F.col(quoted(c)))
                continue
            tail = c[len(source) :]
            if tail == "#*" and node.fields:
                parts = F.map_filter(
                    F.try_variant_get(bag.col, "$", "map<string,variant>"), lambda k, _: k.isin(list(node.fields))
                )
                cols.append(F.to_variant_object(parts).alias(target + tail))
            elif not tail.startswith("#@") or not node.fields or tail[2:] in node.fields:
                cols.append(F.col(quoted(c)).alias(target + tail))
        aliases = {target if a == source else a: info for a, info in r.aliases.items()}
        return r.with_df(r.df.select(*cols), aliases=aliases)

    def _sort(self, node: N.Sort, r: Records) -> Records:
        alias = r.resolve(node.alias, "sort")
        key = self._name("key")
        if r.factors:
            if alias in r.factors[0].aliases:  # sorting the leading factor sorts the product
                first = self._sorted(r.factors[0], alias, node, key)
                return replace(
                    r, factors=[first, *r.factors[1:]], order=[(key, _ascends(node)), *r.order], sorted=True
                )
            r = self._formed(r)
        return self._sorted(r, alias, node, key)

    def _sorted(self, r: Records, alias: str, node: N.Sort, key: str) -> Records:
        """Note the sort; it is carried out once, at a page or at the result."""
        bag = r.bag(alias)
        if node.typed:
            value = bag.value(node.field) if bag.is_struct else bag.text(node.field)
        else:
            value = F.coalesce(bag.text(node.field), F.lit("<nil>"))
            if r.aliases[alias].nullable:
                value = F.when(r.present(alias), value).otherwise(F.lit(""))
        return r.with_df(r.df.withColumn(key, value), order=[(key, _ascends(node)), *r.order], sorted=True)

    def _paginate(self, node: N.Paginate, r: Records) -> Records:
        if not node.limit:
            r = self._formed(r)
            if not node.offset:
                return r
        return r.page(node.limit, node.offset or 0)

    def _materialize(self, node: N.Materialize, r: Records) -> Records:
        r = self._formed(r)
        cols, aliases = [], {}
        for output in node.outputs:
            entity, info = self._output(output, r)
            cols += entity
            aliases[output.alias] = info
        hidden = [F.col(quoted(c)) for c in r.hidden()]
        return r.with_df(r.df.select(*cols, *hidden), aliases=aliases)

    def _output(self, output: N.Output, r: Records) -> tuple[list[Column], AliasInfo]:
        every = sorted(r.aliases)
        bag: dict[str, tuple[Column, T.DataType]] = {}
        suppliers: list[tuple[str, Column]] = []  # (alias, whether it gives some field)
        for f in output.fields:
            if not f.output_field:
                continue
            sources = every if f.source_alias in ("", N.ANY_ALIAS) else [f.source_alias]
            found = [(a, *v) for a in sources if a in r.aliases and (v := self._extract(r, a, f.source_field))]
            if not found:
                continue
            suppliers += [(a, present) for a, _, _, present in found]
            value = _first_value([(v, t, p) for _, v, t, p in found])
            if f.output_field in bag:  # mapped twice: the later mapping wins where it has a value
                value = _first_value([(*value, value[0].isNotNull()), (*bag[f.output_field], F.lit(True))])
            bag[f.output_field] = value
        seeds = []
        for f in output.fields:
            if f.source_alias == N.ANY_ALIAS:
                seeds += every
            elif f.source_alias in r.aliases:
                seeds.append(f.source_alias)
        if seeds:
            chosen = [(a, r.present(a)) for a in dict.fromkeys(seeds)]
        else:  # no named source: the envelope comes from whichever alias gives the first value
            chosen = suppliers
        sure = next((i for i, (a, _) in enumerate(chosen) if seeds and not r.aliases[a].nullable), None)
        if sure is not None:
            chosen = chosen[: sure + 1]
        envelope = {}
        for c in ENVELOPE:
            picked = None
            for i, (a, test) in enumerate(chosen):
                value = r.envelope(a, c)
                if i == sure:
                    picked = value if picked is None else picked.otherwise(value)
                else:
                    picked = F.when(test, value) if picked is None else picked.when(test, value)
            envelope[c] = F.lit(None).cast(ENVELOPE_TYPES[c]) if picked is None else picked
        types = frozenset()
        for a, _ in chosen:
            known = r.aliases[a].types
            types = None if types is None or known is None else types | known
        struct = F.struct(*[v.alias(name) for name, (v, _) in bag.items()])
        shape = T.StructType([T.StructField(name, t) for name, (_, t) in bag.items()])
        cols = entity_columns(output.alias, envelope, _Loose(struct, shape, {n: v for n, (v, _) in bag.items()}))
        return cols, AliasInfo(types or None)

    def _extract(self, r: Records, alias: str, name: str):
        """(value, type, whether present) of a system field or property; None if never there."""
        if name in SYSTEM_FIELDS:
            column = SYSTEM_FIELDS[name]
            value = r.envelope(alias, column)
            dtype = ENVELOPE_TYPES[column]
            if isinstance(dtype, T.StringType):
                value = F.when(value != "", value)
            elif isinstance(dtype, T.LongType):
                value = F.when(value != 0, value)
            return value, dtype, value.isNotNull()
        bag = r.bag(alias)
        dtype = bag.type_of(name)
        if dtype is None:
            return None
        return bag.value(name), dtype, bag.has(name)

    # --- joins ----------------------------------------------------------------------------------

    def _join(self, node, left: Records, right: Records) -> Records:
        how = HOW[node.type]
        if not node.on_field.strip():
            return self._cartesian(node, how, left, right)
        left, right = self._sides(node, left, right)
        parts = []
        for strategy, test in self._strategies(node, left, right):
            part = left if test is None else left.with_df(left.df.filter(test))
            parts.append(self._key_join(*strategy, node, part, right, how))
        df = reduce(DataFrame.unionByName, parts)
        if how == ANTI:
            return left.with_df(df, counter=None)
        return self._merged(df, how, left, right, self._literal_counter(node, left, right, how))

    _left_join = _join
    _anti_join = _join

    def _sides(self, node, left: Records, right: Records) -> tuple[Records, Records]:
        """Both inputs formed, without records that lack the join entity, and with distinct order
        columns so that a graph may join a node to itself."""
        left, right = self._formed(left), self._formed(right)
        for alias, r in ((node.left_alias, left), (node.right_alias, right)):
            if alias not in r.aliases:
                raise ValueError(f"join alias {alias!r} not found in {sorted(r.aliases)}")
        return left.having(node.left_alias), self._disjoint(right.having(node.right_alias))

    def _disjoint(self, right: Records) -> Records:
        renamed = {c: self._name("r") for c in right.hidden()}
        order = [(renamed[c], up) for c, up in right.order]
        return right.with_df(right.df.withColumnsRenamed(renamed), order=order)

    def _merged(self, df: DataFrame, how: str, left: Records, right: Records, counter=None) -> Records:
        """Aliases and order of a joined record: left then right, the right side wins a clash."""
        mine = {a: i for a, i in left.aliases.items() if a not in right.aliases}
        theirs = {a: replace(i, nullable=i.nullable or how == LEFT) for a, i in right.aliases.items()}
        order = [*left.order, *right.order]
        kept = [c for a in mine for c in left.columns_of(a)] + [c for a in theirs for c in right.columns_of(a)]
        df = df.select(*[quoted(c) for c in kept], *[quoted(c) for c, _ in order])
        return Records(df, {**mine, **theirs}, order, left.sorted or right.sorted, counter=counter)

    def _strategies(self, node, left: Records, right: Records):
        """(strategy, row test) pairs; one unless the left alias mixes types that differ in it."""
        types = left.aliases[node.left_alias].types
        if types is None:
            return [(("literal", None), None)]
        chosen: dict[tuple, list[str]] = {}
        for t in sorted(types):
            chosen.setdefault(self._strategy(node, t, right), []).append(t)
        if len(chosen) == 1:
            return [(next(iter(chosen)), None)]
        kind = left.envelope(node.left_alias, "entity_type")
        return [(s, kind.isin(ts)) for s, ts in chosen.items()]

    def _strategy(self, node, entity_type: str, right: Records) -> tuple:
        schema = self.store.schema_of(entity_type)
        found = schema.field(node.on_field) if schema is not None else None
        if found is None:
            return ("literal", None)
        if found.type in (FieldType.ENTITY_REFERENCE, FieldType.ENTITY_REFERENCE_ARRAY):
            return ("id", None)
        if found.type is FieldType.REFERENCE:
            if self._canonical(right, node.right_alias):
                return ("reference", found.reference_entity_type)
            return ("text", None)
        return ("literal", None)

    def _canonical(self, right: Records, alias: str) -> dict[str, str]:
        """Canonical reference field per entity type the right alias may hold."""
        out = {}
        for t in right.aliases[alias].types or ():
            schema = self.store.schema_of(t)
            if schema is not None and schema.canonical_reference:
                out[t] = schema.canonical_reference
        return out

    def _key_join(self, kind: str, target: str | None, node, left: Records, right: Records, how: str) -> DataFrame:
        field = node.on_field
        lbag, rbag = left.bag(node.left_alias), right.bag(node.right_alias)
        keys = _LeftKeys(lbag, field)
        # The right side wins an alias both have; only the left key of such an alias is still needed.
        clash = [c for a in left.aliases if a in right.aliases and how != ANTI for c in left.columns_of(a)]
        ldf, rdf = left.df, right.df
        if kind == "id":
            rkey = right.envelope(node.right_alias, "id")
            key = keys.ids(self.options.key_norm)
        elif kind == "reference":
            canonical = self._canonical(right, node.right_alias)
            if target:
                canonical = {t: f for t, f in canonical.items() if t == target}
            rtype = right.envelope(node.right_alias, "entity_type")
            rkey = F.lit(None).cast("string")
            for t, f in canonical.items():
                text = rbag.text(f)
                rkey = F.when((rtype == F.lit(t)) & (text != ""), text).otherwise(rkey)
            key = keys.texts()
        elif kind == "text":  # a reference with nothing to resolve against: blanks never match
            rkey = rbag.text(field)
            key = keys.texts()
        else:
            lkey, rkey = _literal_keys(lbag, rbag, field)
            return joins.key_join(ldf, rdf, lkey, rkey, how, self.options.null_safe, clash)
        if keys.scalar:
            return joins.key_join(ldf, rdf, key, rkey, how, False, clash)
        return joins.list_join(ldf, rdf, key, rkey, how, clash)

    def _literal_counter(self, node, left: Records, right: Records, how: str):
        """Exact size of a literal join from the two sides' key counts, whatever the fan-out."""
        strategies = self._strategies(node, left, right)
        if len(strategies) != 1 or strategies[0][0][0] != "literal":
            return None
        null_safe = self.options.null_safe

        def count() -> DataFrame:
            lkey, rkey = _literal_keys(left.bag(node.left_alias), right.bag(node.right_alias), node.on_field)
            ln = left.df.groupBy(lkey.alias("lk")).agg(F.count("*").alias("ln"))
            rn = right.df.groupBy(rkey.alias("rk")).agg(F.count("*").alias("rn"))
            match = F.col("lk").eqNullSafe(F.col("rk")) if null_safe else F.col("lk") == F.col("rk")
            size = F.col("ln") * (F.coalesce("rn", F.lit(1)) if how == LEFT else F.col("rn"))
            both = ln.join(rn, match, "left" if how == LEFT else "inner")
            return both.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"))

        return count

    def _cartesian(self, node, how: str, left: Records, right: Records) -> Records:
        """A blank join field pairs everything; the product stays pending until it is paged."""
        if how == INNER:
            fs = [*(left.factors or [left]), *(right.factors or [right])]
            for alias in (node.left_alias, node.right_alias):
                fs = [f.having(alias) if alias in f.aliases else f for f in fs]
            names = [a for f in fs for a in f.aliases]
            if len(set(names)) != len(names):
                raise ValueError("the sides of a cross product need different aliases")
            fs = [fs[0]] + [self._disjoint(f) for f in fs[1:]]
            aliases = {a: i for f in fs for a, i in f.aliases.items()}
            order = [o for f in fs for o in f.order]
            return Records(None, aliases, order, any(f.sorted for f in fs), factors=fs)
        left, right = self._sides(node, left, right)
        # Left rows that stay alone: all of them when there is nothing to pair them with, else none.
        empty = right.df.limit(1).agg(F.count("*").alias("__n"))
        alone = left.df.withColumn("__one", F.lit(0).cast("bigint")).join(empty, F.col("__one") == F.col("__n"))
        alone = alone.drop("__one", "__n")
        if how == ANTI:
            return left.with_df(alone, counter=None)
        if not self.options.allow_cartesian:
            raise CartesianError("a left join without a field needs allow_cartesian=True")
        clash = [c for a in left.aliases if a in right.aliases for c in left.columns_of(a)]
        sides = [product.Factor(left.df.drop(*clash), left.order_columns()), product.Factor(right.df, right.order_columns())]
        pairs = product.whole(sides).unionByName(alone.drop(*clash), allowMissingColumns=True)
        return self._merged(pairs, how, left, right)

    # --- union ----------------------------------------------------------------------------------

    def _union(self, node: N.Union, *inputs: Records) -> Records:
        """All input rows in input order, duplicates kept; an alias an input lacks is null there."""
        inputs = [self._formed(r) for r in inputs]
        inputs = [inputs[0], *[self._disjoint(r) for r in inputs[1:]]]
        names = list(dict.fromkeys(a for r in inputs for a in r.aliases))
        bags = {a: _common_bag([r.bag(a).dtype for r in inputs if a in r.aliases]) for a in names}
        turn = self._name("input")
        parts = []
        for i, r in enumerate(inputs):
            cols = [c for a in r.aliases for c in _aligned(r, a, bags[a])]
            parts.append(r.df.select(*cols, F.lit(i).alias(turn), *[quoted(c) for c in r.hidden()]))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        aliases = {}
        for a in names:
            infos = [r.aliases[a] for r in inputs if a in r.aliases]
            types = None if any(i.types is None for i in infos) else frozenset().union(*[i.types for i in infos])
            missing = len(infos) < len(inputs)
            aliases[a] = AliasInfo(types, missing or any(i.nullable for i in infos))
        order = [(turn, True), *dict.fromkeys(o for r in inputs for o in r.order)]
        return Records(df, aliases, order, any(r.sorted for r in inputs))


class _Loose(Bag):
    """A struct bag under construction: each property is an expression of its own."""

    def __init__(self, col: Column, dtype: T.StructType, parts: dict[str, Column]):
        super().__init__(col, dtype)
        self.parts = parts

    def _field(self, key: str) -> Column:
        return self.parts[key]


class _LeftKeys:
    """Join keys of a left property: one text, or a list where the value may be a list."""

    def __init__(self, bag: Bag, name: str):
        self.bag, self.name = bag, name
        dtype = bag.type_of(name)
        self.scalar = dtype is None or not isinstance(dtype, (T.ArrayType, T.VariantType))

    def ids(self, norm) -> Column:
        return norm(self.bag.text(self.name)) if self.scalar else self.bag.ids(self.name, norm)

    def texts(self) -> Column:
        text = self.bag.text(self.name)
        return F.when(text != "", text) if self.scalar else self.bag.texts(self.name)


def _rank_parts(r: Records) -> list[Column]:
    """The record order as values that ascend, nulls first in either direction."""
    return [F.col(c) if up else _turned(F.col(c), r.df.schema[c].dataType) for c, up in r.order]


def _turned(c: Column, dtype: T.DataType) -> Column:
    """A value that ascends where ``c`` descends."""
    if isinstance(dtype, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(dtype, T.BooleanType):
        return ~c
    if isinstance(dtype, values.INTEGRAL):
        return -c.cast("decimal(20,0)")
    if isinstance(dtype, (*values.FLOATING, T.DecimalType)):
        return -c
    # Texts order by their bytes: turn every digit of those, and let a text stand before its own beginnings.
    digits = "0123456789ABCDEF"
    return F.concat(F.translate(F.hex(c.cast("string")), digits, digits[::-1]), F.lit("~"))


def _ascends(node: N.Sort) -> bool:
    return node.direction.upper() != "DESC"


def _first_value(found: list[tuple[Column, T.DataType, Column]]) -> tuple[Column, T.DataType]:
    """Value of the first source that has the field."""
    if len({t for _, t, _ in found}) > 1:
        found = [(values.as_variant(v, t), T.VariantType(), p) for v, t, p in found]
    dtype = found[0][1]
    if len(found) == 1:
        return found[0][0], dtype
    picked = F.when(found[0][2], found[0][0])
    for value, _, present in found[1:]:
        picked = picked.when(present, value)
    return picked, dtype


def _literal_keys(lbag: Bag, rbag: Bag, name: str) -> tuple[Column, Column]:
    """Join keys as typed values where both sides agree on a plain type, else as text."""
    lt, rt = lbag.type_of(name), rbag.type_of(name)
    plain = (T.StringType, *values.INTEGRAL, T.BooleanType, T.TimestampType)
    if lt is not None and lt == rt and isinstance(lt, plain):
        return lbag.value(name), rbag.value(name)
    return lbag.text(name), rbag.text(name)


def _common_bag(types: list[T.DataType]) -> T.DataType:
    if any(isinstance(t, T.VariantType) for t in types):
        return T.VariantType()
    merged: dict[str, T.DataType] = {}
    for t in types:
        for f in t.fields:
            known = merged.get(f.name)
            merged[f.name] = f.dataType if known is None or known == f.dataType else T.VariantType()
    return T.StructType([T.StructField(n, t) for n, t in merged.items()])


def _aligned(r: Records, alias: str, shape: T.DataType) -> list[Column]:
    """The alias's columns with property types all union inputs share; what it lacks is left out."""
    bag = r.bag(alias)
    if bag.dtype == shape:
        return [F.col(quoted(c)) for c in r.columns_of(alias)]
    keep = [F.col(quoted(c)) for c in r.columns_of(alias) if not c.startswith((f"{alias}#@", f"{alias}#*"))]
    if isinstance(shape, T.VariantType):
        return [*keep, F.when(r.present(alias), bag.variant()).alias(f"{alias}#*")]
    for f in shape.fields:
        mine = bag.type_of(f.name)
        if mine is not None:
            value = bag.value(f.name) if mine == f.dataType else values.as_variant(bag.value(f.name), mine)
            keep.append(value.alias(f"{alias}#@{f.name}"))
    return keep


# --- results ------------------------------------------------------------------------------------


class Result:
    """A compiled transformation.

    ``filters`` maps an alias to property filters and ``sort`` is ``(alias, field, direction)``; both
    act on the whole result, before the page.
    """

    def __init__(self, transformation, store, options: Options = Options(), filters=None, sort=None):
        self.transformation = transformation
        self.compiler = Compiler(transformation, store, options)
        r = self.compiler.run()
        for alias, tests in (filters or {}).items():
            if not tests:
                continue
            r = self.compiler._filter(N.Filter("", ("",), alias, tuple(tests)), r)
        if sort is not None:
            r = self.compiler._sort(N.Sort("", ("",), *sort), r)
        self.records = r

    def frame(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Records as one struct column per alias; ordered if a sort or a page asks for it."""
        r = self.records.with_df(self._window(limit, offset))
        return r.df.select(*[r.entity(a).alias(a) for a in r.aliases])

    def _window(self, limit: int | None, offset: int) -> DataFrame:
        r = self.records
        if limit:
            return r.page(limit, offset).df
        r = self.compiler._formed(r)
        if offset or r.sorted:
            return r.page(None, offset).df
        return r.df

    def total(self) -> DataFrame:
        return self.records.total()

    def columns(self) -> list[tuple[str, N.OutputField]]:
        """(alias, field mapping) of every column of the flat form."""
        return [(o.alias, f) for o in self.transformation.materialized().outputs for f in o.fields if f.output_field]

    def flat(self, limit: int | None = None, offset: int = 0, separator: str = ".", text: bool = True) -> DataFrame:
        """One column ``alias.field`` per materialized field, as nullable text cells.

        ``text=False`` keeps the typed values.
        """
        r = self.records.with_df(self._window(limit, offset))
        cols = []
        for alias, f in self.columns():
            name = f"{alias}{separator}{f.output_field}"
            if alias not in r.aliases:
                cols.append(F.lit(None).cast("string").alias(name))
                continue
            bag = r.bag(alias)
            cols.append((bag.text(f.output_field) if text else bag.value(f.output_field)).alias(name))
        return r.df.select(*cols)

    def alias_summary(self) -> DataFrame:
        """Per alias and field: the sorted entity types seen and the field's value in the record
        that comes first."""
        r = self.compiler._formed(self.records)
        first = F.struct(*_rank_parts(r))
        aggs, names = [], []
        for a in sorted(r.aliases):
            aggs.append(F.array_sort(F.collect_set(r.envelope(a, "entity_type"))).alias(f"types:{a}"))
            for key in r.bag(a).names():
                value = r.bag(a).text(key)
                aggs.append(F.min_by(value, F.when(value.isNotNull(), first)).alias(f"first:{a}:{key}"))
                names.append((a, key))
        row = r.df.agg(*aggs)
        lines = [
            F.struct(
                F.lit(a).alias("alias"),
                F.col(quoted(f"types:{a}")).alias("entity_types"),
                F.lit(key).alias("field"),
                F.col(quoted(f"first:{a}:{key}")).alias("sample"),
            )
            for a, key in names
        ]
        return row.select(F.inline(F.array(*lines)))


def flat_filters(rows) -> dict[str, list[PropertyFilter]]:
    """Group ``(alias, PropertyFilter)`` pairs for ``Result``."""
    out: dict[str, list[PropertyFilter]] = {}
    for alias, f in rows:
        if alias.strip() and f.key.strip():
            out.setdefault(alias.strip(), []).append(f)
    return out
