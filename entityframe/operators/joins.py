"""Join strategies shared by DAG nodes and saved joins, and saved joins themselves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityframe.functions.props import Bag
from entityframe.model import EntitySchema, FieldType, PropertyFilter
from entityframe.operators import ordinal, predicates, product
from entityframe.plans.records import AliasInfo, Records, load_expressions

INNER, LEFT, ANTI = "inner", "left", "left_anti"


class CartesianError(ValueError):
    """A whole cross product was asked for without ``allow_cartesian=True``."""


def key_join(
    left: DataFrame, right: DataFrame, lkey: Column, rkey: Column, how: str, null_safe: bool = False, drop=()
) -> DataFrame:
    """Equi-join on two key expressions; with ``null_safe`` null keys match each other.

    ``drop`` names left columns that only the key needs. A left join is the inner join, whose hot keys
    can be split on either side, and the left rows without a match.
    """
    lhs = left.withColumn("__lk", lkey).drop(*drop)
    rhs = right.withColumn("__rk", rkey)
    match = F.col("__lk").eqNullSafe(F.col("__rk")) if null_safe else F.col("__lk") == F.col("__rk")
    if how != LEFT:
        return lhs.join(rhs, match, how).drop("__lk", "__rk")
    known = rhs.select("__rk").distinct()
    alone = lhs.join(known, match, "left_anti").drop("__lk")
    return lhs.join(rhs, match).drop("__lk", "__rk").unionByName(alone, allowMissingColumns=True)


def list_join(left: DataFrame, right: DataFrame, keys: Column, rkey: Column, how: str, drop=()) -> DataFrame:
    """Join each left row to the right rows whose key is among its distinct ``keys`` (an array).

    Whether a left row matches depends on its key list alone. Left and anti joins therefore find out
    once per distinct list whether any of its keys exists, and tell the rows; no row id is needed.
    """
    lhs = left.withColumn("__keys", keys).drop(*drop)
    rhs = right.withColumn("__rk", rkey)
    if how == INNER:
        opened = lhs.withColumn("__lk", F.explode("__keys")).drop("__keys")
        return opened.join(rhs, F.col("__lk") == F.col("__rk")).drop("__lk", "__rk")
    lists = lhs.select("__keys").distinct()
    hits = lists.withColumn("__lk", F.explode("__keys")).join(
        rhs.select("__rk"), F.col("__lk") == F.col("__rk"), "left_semi"
    )
    matched = hits.select(F.col("__keys").alias("__hit")).distinct()
    same = F.col("__keys") == F.col("__hit")
    if how == ANTI:
        return lhs.join(matched, same, "left_anti").drop("__keys")
    alone = lhs.join(matched, same, "left_anti").drop("__keys")
    opened = lhs.withColumn("__lk", F.explode("__keys")).drop("__keys")
    found = opened.join(rhs, F.col("__lk") == F.col("__rk")).drop("__lk", "__rk")
    return found.unionByName(alone, allowMissingColumns=True)


# --- saved joins --------------------------------------------------------------------------------

LEFT_SIDE, RIGHT_SIDE = "LEFT", "RIGHT"
DEFAULT_PAGE = 25

# Names a sort may use for envelope columns, compared without case.
SORT_ENVELOPE = {
    "createdat": "created_at",
    "updatedat": "updated_at",
    "path": "path",
    "entitytype": "entity_type",
    "id": "id",
}


@dataclass(frozen=True)
class JoinSort:
    side: str
    field: str
    direction: str = "ASC"

    @property
    def is_right(self) -> bool:
        return self.side.upper() == RIGHT_SIDE


@dataclass(frozen=True)
class SavedJoin:
    left_type: str
    right_type: str
    join_type: str = "REFERENCE"  # or CROSS
    join_field: str | None = None
    join_field_type: FieldType | None = None
    left_filters: tuple[PropertyFilter, ...] = field(default=())
    right_filters: tuple[PropertyFilter, ...] = field(default=())
    sorts: tuple[JoinSort, ...] = field(default=())


@dataclass
class JoinResult:
    """Edges as two struct columns ``l`` and ``r``, plus the exact total as a one-row frame."""

    edges: DataFrame
    total: DataFrame


def check_definition(join: SavedJoin, left_schema: EntitySchema) -> None:
    """A reference join needs a reference field on the left whose declared target agrees."""
    if join.join_type == "CROSS":
        return
    if join.join_type != "REFERENCE":
        raise ValueError(f"unsupported join type {join.join_type}")
    if not join.join_field:
        raise ValueError("join field is required for reference joins")
    found = left_schema.field(join.join_field)
    if found is None:
        raise ValueError(f"field {join.join_field} is not declared by {left_schema.name}")
    if found.type not in (FieldType.ENTITY_REFERENCE, FieldType.ENTITY_REFERENCE_ARRAY):
        raise ValueError(f"field {join.join_field} is no entity reference")
    target = found.reference_entity_type.strip()
    if target and target.lower() != join.right_type.lower():
        raise ValueError(f"field {join.join_field} refers to {target}, not {join.right_type}")


def run_saved_join(
    store,
    join: SavedJoin,
    left_filters=(),
    right_filters=(),
    sorts=(),
    limit: int | None = DEFAULT_PAGE,
    offset: int = 0,
    allow_cartesian: bool = False,
) -> JoinResult:
    """Run a saved join; run-time filters and sorts are added to the saved ones.

    ``limit=None`` returns every edge.
    """
    schema = store.schema_of(join.left_type)
    if schema is not None:
        check_definition(join, schema)
    left = _side(store.load(join.left_type), (*join.left_filters, *left_filters), "l")
    right = _side(store.load(join.right_type), (*join.right_filters, *right_filters), "r")
    criteria = [s for s in (*join.sorts, *sorts) if s.field]
    if join.join_type == "CROSS":
        return _cross(left, right, criteria, limit, offset, allow_cartesian)

    kind = join.join_field_type
    if kind is None:
        declared = schema.field(join.join_field) if schema is not None else None
        kind = declared.type if declared is not None else FieldType.ENTITY_REFERENCE
    bag = left.bag("l")
    if kind is FieldType.ENTITY_REFERENCE_ARRAY:
        lhs = left.df.withColumn("__lk", F.explode(bag.raw_items(join.join_field)))
    else:
        lhs = left.df.withColumn("__lk", bag.text(join.join_field))
    both = _both(left, right, lhs.join(right.df, F.col("__lk") == right.envelope("r", "id")))
    keys = [_sort_key(both, s, join.join_field) for s in criteria]
    page = both.df
    if limit is not None or keys or offset:
        page = ordinal.page(both.df, [*keys, *_newest(both, "l"), *_newest(both, "r")], limit, offset)
    return JoinResult(_edges(both, page), both.total())


def _side(df: DataFrame, filters, name: str) -> Records:
    if filters:
        df = df.filter(predicates.saved_join_filters(Bag.of(df), filters))
    return Records(df.selectExpr(*load_expressions(df, name)), {name: AliasInfo(None)}, [])


def _both(left: Records, right: Records, df: DataFrame) -> Records:
    return Records(df, {**left.aliases, **right.aliases}, [])


def _edges(both: Records, df: DataFrame) -> DataFrame:
    return df.select(both.entity("l").alias("l"), both.entity("r").alias("r"))


def _sort_value(r: Records, s: JoinSort, join_field: str | None = None) -> Column:
    alias = "r" if s.is_right else "l"
    column = SORT_ENVELOPE.get(s.field.lower())
    if column is not None:
        return r.envelope(alias, column)
    if join_field and not s.is_right and s.field.lower() == join_field.lower():
        return F.col("__lk")  # the value joined on: one array element where the field is an array
    return r.bag(alias).text(s.field)


def _sort_key(r: Records, s: JoinSort, join_field: str | None = None) -> Column:
    value = _sort_value(r, s, join_field)
    return value.desc_nulls_last() if s.direction.upper() == "DESC" else value.asc_nulls_last()


def _newest(r: Records, alias: str) -> list[Column]:
    return [r.envelope(alias, "created_at").desc_nulls_first(), r.envelope(alias, "id").asc()]


def _cross(left: Records, right: Records, criteria, limit, offset, allow_cartesian) -> JoinResult:
    """Every pair. A page is cut by position, so only the rows on it are ever paired.

    The side sorted first leads; pairs equal under all criteria follow the other side's order, then
    the leading side's, newest first.
    """
    total = product.total([product.Factor(left.df, []), product.Factor(right.df, [])])
    sides = [s.is_right for s in criteria]
    swap = bool(sides) and sides[0]
    first, second, names = (right, left, ("r", "l")) if swap else (left, right, ("l", "r"))
    lead = [s for s in criteria if s.is_right == swap]
    follow = [s for s in criteria if s.is_right != swap]
    contiguous = [s.is_right for s in lead + follow] == sides
    ways = [_sort_key(first, s) for s in lead]
    behind = product.Factor(second.df, [*[_sort_key(second, s) for s in follow], *_newest(second, names[1])])
    ties = _newest(first, names[0])
    if contiguous and limit is not None:
        if follow:
            keys = [_sort_value(first, s) for s in lead]
            page = product.grouped_page(first.df, keys, ways, ties, behind, limit, offset)
        else:
            page = product.page([product.Factor(first.df, [*ways, *ties]), behind], limit, offset)
        both = _both(left, right, page)
        return JoinResult(_edges(both, both.df), total)
    if not allow_cartesian:
        raise CartesianError("a whole cross join needs allow_cartesian=True; pass a limit to page it")
    pairs = product.whole([product.Factor(left.df, _newest(left, "l")), product.Factor(right.df, _newest(right, "r"))])
    both = _both(left, right, pairs)
    keys = [_sort_key(both, s) for s in criteria]
    rest = [*behind.order, *ties] if follow else [*ties, *behind.order]
    return JoinResult(_edges(both, ordinal.page(both.df, [*keys, *rest], limit, offset)), total)
