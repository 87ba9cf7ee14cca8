"""Tree queries over entity paths.

For one path each relation is a filter. For many anchors it is an equi-join: on the label prefixes
of a path (ancestors), on numbers in pre-order (descendants) or on its parent (children, siblings),
never a path comparison.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityframe.functions import paths
from entityframe.operators import ordinal
from entityframe.session import stage, tune

# --- one path -----------------------------------------------------------------------------------


def is_ancestor_of(path: Column, of: str) -> Column:
    labels = of.split(".")
    above = [".".join(labels[:n]) for n in range(1, len(labels))]
    return F.coalesce(path.isin(above), F.lit(False)) if above else F.lit(False)


def is_descendant_of(path: Column, of: str) -> Column:
    """The path itself counts, as zero further labels."""
    return F.coalesce((path == F.lit(of)) | path.startswith(of + "."), F.lit(False))


def is_child_of(path: Column, of: str) -> Column:
    return F.coalesce(path.startswith(of + ".") & (paths.parent(path) == F.lit(of)), F.lit(False))


def is_sibling_of(path: Column, of: str) -> Column:
    up = of.rpartition(".")[0]
    near = path.startswith(up + ".") if up else F.lit(True)
    return F.coalesce(near & (paths.parent(path) == F.lit(up)) & (path != F.lit(of)), F.lit(False))


def ancestors_of(df: DataFrame, path: str) -> DataFrame:
    return df.filter(is_ancestor_of(F.col("path"), path)).orderBy(paths.depth(F.col("path")))


def descendants_of(df: DataFrame, path: str) -> DataFrame:
    return df.filter(is_descendant_of(F.col("path"), path))


def children_of(df: DataFrame, path: str) -> DataFrame:
    return df.filter(is_child_of(F.col("path"), path))


def siblings_of(df: DataFrame, path: str) -> DataFrame:
    return df.filter(is_sibling_of(F.col("path"), path))


def hierarchy_of(df: DataFrame, path: str) -> DataFrame:
    """The entity at a path with its ancestors, children and siblings, marked by ``relation``.

    The four sets never overlap, so one pass over the entities decides each row.
    """
    at = F.col("path")
    relation = (
        F.when(at == F.lit(path), "current")
        .when(is_ancestor_of(at, path), "ancestor")
        .when(is_child_of(at, path), "child")
        .when(is_sibling_of(at, path), "sibling")
    )
    return df.withColumn("relation", relation).filter(F.col("relation").isNotNull())


# --- many anchors -------------------------------------------------------------------------------

CELL = 2048  # siblings of a parent that meet as many of its anchors in one place
PAIRS_PER_TASK = 32_000_000


def _anchors(anchors: DataFrame) -> DataFrame:
    return anchors.select(
        F.col("organization_id").alias("anchor_org"), F.col("id").alias("anchor_id"), F.col("path").alias("anchor_path")
    ).filter(F.col("anchor_path").isNotNull())


def _same_org() -> Column:
    return F.col("organization_id") == F.col("anchor_org")


def ancestors(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per (anchor, ancestor): depth-many rows per anchor."""
    steps = _anchors(anchors).withColumn("__at", F.explode(paths.prefixes(F.col("anchor_path"))))
    steps = steps.filter(F.col("__at") != F.col("anchor_path"))
    found = df.join(steps, (df["path"] == steps["__at"]) & _same_org())
    return found.withColumn("depth", paths.depth(F.col("path"))).drop("__at", "anchor_org")


def descendants(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per (anchor, entity at or below it)."""
    return TreeIndex(df).descendants(anchors)


def children(df: DataFrame, anchors: DataFrame) -> DataFrame:
    marks = _anchors(anchors)
    below = df.filter(F.col("path").contains(".")).withColumn("__up", paths.parent(F.col("path")))
    return below.join(marks, (F.col("__up") == F.col("anchor_path")) & _same_org()).drop("__up", "anchor_org")


def siblings(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Entities with an anchor's parent, the anchor's own path left out.

    The result holds every sibling of every anchor, so pass the anchors asked about, not a level. Under one parent it grows
    with both sides, so a parent is cut into cells of about ``CELL`` entities by ``CELL`` anchors, and the cells are dealt to
    as many tasks as the pairs need: no task's work grows with a parent.
    """
    tune(df.sparkSession)
    marks = _anchors(anchors).withColumn("__anchor_up", paths.parent(F.col("anchor_path")))
    near = df.withColumn("__up", paths.parent(F.col("path")))
    same_up = (F.col("__up") == F.col("__anchor_up")) & _same_org()
    sizes = near.groupBy("organization_id", "__up").agg(F.count("*").alias("__m"))
    asked = marks.groupBy("anchor_org", "__anchor_up").agg(F.count("*").alias("__n"))
    # One line per parent that has an anchor below it.
    crowds = stage(sizes.join(asked, same_up).select("organization_id", "__up", "__m", "__n"), "siblings")
    pairs = crowds.agg(F.sum(F.col("__m").cast("double") * F.col("__n"))).first()[0]
    tasks = max(1, math.ceil((pairs or 0) / PAIRS_PER_TASK))

    cells = crowds.select("organization_id", "__up", F.ceil(F.col("__m") / CELL).alias("__m"), F.ceil(F.col("__n") / CELL).alias("__n"))
    each = lambda n: F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))
    own = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)) + 1
    rows = near.join(cells, ["organization_id", "__up"]).withColumn("__i", own("__m", "id", "path")).withColumn("__j", each("__n")).drop("__m", "__n")
    here = cells.select(F.col("organization_id").alias("anchor_org"), F.col("__up").alias("__anchor_up"), "__m", "__n")
    to = marks.join(here, ["anchor_org", "__anchor_up"]).withColumn("__at_j", own("__n", "anchor_id", "anchor_path")).withColumn("__at_i", each("__m")).drop("__m", "__n")
    rows = rows.repartition(tasks, "organization_id", "__up", "__i", "__j")
    to = to.repartition(tasks, "anchor_org", "__anchor_up", "__at_i", "__at_j")
    match = same_up & (F.col("__i") == F.col("__at_i")) & (F.col("__j") == F.col("__at_j")) & (F.col("path") != F.col("anchor_path"))
    found = rows.join(to, match)
    return found.select(*df.columns, "anchor_id", "anchor_path")


def hierarchies(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per anchor and entity of its hierarchy, marked by ``relation`` as in ``hierarchy_of``."""
    marks = _anchors(anchors)
    own = df.join(marks, (F.col("path") == F.col("anchor_path")) & _same_org()).drop("anchor_org")
    parts = {"current": own, "ancestor": ancestors(df, anchors).drop("depth"), "child": children(df, anchors), "sibling": siblings(df, anchors)}
    marked = [part.withColumn("relation", F.lit(name)) for name, part in parts.items()]
    return reduce(DataFrame.unionByName, marked)


# --- nested intervals ---------------------------------------------------------------------------

SPAN = 1024  # paths in a block of an interval


class TreeIndex:
    """The paths of a tree numbered in pre-order, each with the last number of its subtree.

    Built from one range sort of the distinct paths and the ends of their subtrees, staged, and then used by any number of
    queries: what lies below a path is a range of numbers, so the store is joined by number and never opened by label.
    """

    def __init__(self, df: DataFrame):
        tune(df.sparkSession)
        self.df = df
        self.paths = stage(self._numbered(df), "tree-index")

    @staticmethod
    def _known(df: DataFrame) -> DataFrame:
        """``organization_id, path, there``: all paths of entities, and those between them that no entity has itself.

        Parents that are missing are added level by level, which takes one look at a tree that has them all.
        """
        new = stage(df.select("organization_id", "path").filter(F.col("path").isNotNull()).distinct().withColumn("there", F.lit(1)), "tree-paths")
        every = new
        while True:
            up = new.select("organization_id", paths.parent(F.col("path")).alias("path")).filter("path <> ''").distinct()
            new = stage(up.join(every, ["organization_id", "path"], "left_anti").withColumn("there", F.lit(0)), "tree-paths")
            if new.isEmpty():
                return every
            every = every.unionByName(new)

    @classmethod
    def _numbered(cls, df: DataFrame) -> DataFrame:
        """``organization_id, path, there, first, last``: the first and last number of a path's subtree, its own if an entity
        has it; numbers count from 1."""
        # With the lowest character between labels a subtree stands together, right behind its root, whatever the labels hold;
        # the next higher character closes it.
        key = F.translate("path", ".", "\x01")
        marks = F.array(F.struct(key.alias("key"), F.col("there").alias("opens")), F.struct(F.concat(key, F.lit("\x02")).alias("key"), F.lit(-1).alias("opens")))
        both = cls._known(df).withColumn("__m", F.explode(marks)).select("organization_id", "path", "there", "__m.key", "__m.opens")
        counts = {"__n": F.greatest(F.col("opens"), F.lit(0)).cast("bigint")}
        counted = ordinal.running_totals(both, [], ["organization_id", "key", "opens"], counts)
        at = lambda opens: F.max(F.when(opens, F.col("__n")))
        found = counted.groupBy("organization_id", "path", "there").agg(at(F.col("opens") >= 0).alias("first"), at(F.col("opens") < 0).alias("last"))
        return found.withColumn("first", F.col("first") + 1 - F.col("there"))

    def sizes(self) -> DataFrame:
        """``organization_id, path, n_below``: how many different paths lie below each."""
        return self.paths.filter("there = 1").select("organization_id", "path", (F.col("last") - F.col("first")).alias("n_below"))

    def descendants(self, anchors: DataFrame) -> DataFrame:
        """One row per (anchor, entity at or below it).

        An anchor's range is cut into whole blocks of ``SPAN`` numbers and single numbers at both ends; every piece names
        entities of the result, so both joins make no row beyond it. An anchor need not be an entity's path.
        """
        place = ["anchor_org", "anchor_path"]
        here = self.paths.select(F.col("organization_id").alias("anchor_org"), F.col("path").alias("anchor_path"), "first", "last")
        ranges = _anchors(anchors).join(here, place).filter("first <= last").drop("anchor_org")
        start, end = F.ceil(F.col("first") / SPAN), F.floor((F.col("last") + 1) / SPAN)
        whole = _between(start, end - 1)
        ends = F.concat(_between(F.col("first"), start * SPAN - 1), _between(end * SPAN, F.col("last")))
        single = F.when(start < end, ends).otherwise(F.sequence("first", "last"))

        number = self.paths.filter("there = 1").select(F.col("organization_id").alias("__org"), F.col("path").alias("__path"), F.col("first").alias("__n"))
        rows = self.df.join(number, (F.col("organization_id") == F.col("__org")) & (F.col("path") == F.col("__path")))
        in_blocks = rows.join(ranges.withColumn("__at", F.explode(whole)), F.floor(F.col("__n") / SPAN) == F.col("__at"))
        alone = rows.join(ranges.withColumn("__at", F.explode(single)), F.col("__n") == F.col("__at"))
        kept = [*self.df.columns, "anchor_id", "anchor_path"]
        return in_blocks.select(*kept).unionByName(alone.select(*kept))


def _between(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


# --- order of paths -----------------------------------------------------------------------------


def page_by_path(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Rows ``[offset, offset + limit)`` in the order of their paths, label by label as numbers.

    A sort works its expressions out again in each comparison, so the key of a path is made a column first.
    """
    keyed = df.withColumn("__order", paths.order_key(F.col("path")))
    return ordinal.page(keyed, [F.col("__order")], limit, offset).drop("__order")


# --- new paths ----------------------------------------------------------------------------------


def generate_paths(df: DataFrame, parent: str, order: list[str], name: str = "path", chunk: Column | None = None) -> DataFrame:
    """Number the rows under each parent path 1..n in the given order."""
    ranked = ordinal.rank_in_group(df, [parent], order, "__index", chunk)
    return ranked.withColumn(name, paths.child_path(F.col(parent), F.col("__index"))).drop("__index")


def next_paths(df: DataFrame) -> DataFrame:
    """Per parent of numeric-labelled paths, the path the next child would take."""
    at = F.col("path")
    label = paths.last_label(at).try_cast("bigint")
    return (
        df.select("organization_id", paths.parent(at).alias("parent"), label.alias("__label"))
        .filter(F.col("__label").isNotNull())
        .groupBy("organization_id", "parent")
        .agg((F.max("__label") + 1).alias("next_index"))
        .withColumn("next_path", paths.child_path(F.col("parent"), F.col("next_index")))
    )
