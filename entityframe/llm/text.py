"""Text measures as Spark column expressions, shared by the quality operators.

A word is a run of characters other than ASCII white space. All measures read the whole text; a null text counts as
an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the four languages the rules are written for.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he this are or his from at which but have an had".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o".split(),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACES), "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(whole(text), "\n"), lambda line: line.rlike(HAS_WORD))


def count_of(text: Column, pattern: str) -> Column:
    """How many matches of a pattern the text has."""
    return F.regexp_count(whole(text), F.lit(pattern)).cast("long")


def long_size(items: Column) -> Column:
    return F.size(items).cast("long")


def repeats(items: Column) -> Column:
    """How many items of an array equal an earlier one."""
    return long_size(items) - long_size(F.array_distinct(items))


def covered_by_repeats(items: Column, width: int) -> Column:
    """How many items lie in a run of ``width`` items that the array holds twice or more.

    Runs are compared by a 64-bit hash. Only arrays with an equal pair of runs go on to the sort that finds them, so the
    common case costs one pass; both cost n log n at most, whatever the text.
    """

    def runs(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def repeated_starts(placed: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(placed, j)["h"] == x["h"], F.lit(False))
        found = F.filter(placed, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def of_runs(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(let(placed, repeated_starts), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    def of_items(hashes: Column) -> Column:
        return F.when(F.size(hashes) <= width, F.lit(0).cast("long")).otherwise(let(runs(hashes), of_runs))

    return let(F.transform(items, lambda w: F.xxhash64(w)), of_items)


def ratio(part: Column, total: Column) -> Column:
    """A share as a double; 0 where there is nothing to share."""
    return F.when(total > 0, part.cast("double") / total.cast("double")).otherwise(F.lit(0.0))
