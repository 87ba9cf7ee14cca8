"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of equally many documents, and time into periods of P slots. By the end of period j a
source with share w has had ⌊jPw⌋ or ⌈jPw⌉ blocks: those due by then, and of the blocks released before then the ones due
first as far as slots go. So rounding never adds up, however many periods there are. Within a period, block k of a
source with n blocks there may run from slot ⌊kP/n⌋ on (its release) and must have run before slot ⌈(k+1)P/n⌉ (its
deadline); taking the earliest deadline among released blocks meets them all. After any number t of slots a source that
has not run out has had t·w blocks, up to less than one for the shares and less than one within the period.

Only the counts per period and source meet on the driver. Periods are laid out on their own, and every document finds
its slot by a join on source and block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityframe.llm import ship

BLOCK_DOCS = 8
PERIOD = 256
MAX_SOURCES = 100_000
MAX_PERIODS = 4096
UNITS = 1 << 53  # shares are counted in these, as finely as a double holds them
ROWS_PER_CHUNK = 20_000


def integer_weights(targets: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights in whole slots that add up to the period (or to one slot each, if there are more sources than slots).

    Every source gets one slot at least; the rest goes by largest remainder, ties to the first name.
    ``schedule`` does not use it: it keeps to the targets themselves.
    """
    total = float(sum(targets.values()))
    free = max(0, period - len(targets))
    exact = {s: free * v / total if total > 0 else 0.0 for s, v in targets.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = free - sum(int(x) for x in exact.values()) if total > 0 else 0
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:rest]:
        out[s] += 1
    return out


def pfair_period(weights: Mapping[str, int], held: Mapping[str, int] | None = None) -> list[tuple[str, int, int, int, int]]:
    """``(source, block, release, deadline, slot)`` for one period, by earliest deadline first.

    ``held`` says how many blocks a source really has; slots of the others may stay empty.
    """
    period = sum(weights.values())
    held = weights if held is None else held
    waiting = [(0, s, 0) for s in sorted(weights) if min(held[s], weights[s]) > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out, slot = [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, release, deadline, slot))
        slot += 1
        if k + 1 < min(held[s], weights[s]):
            heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
    return out


def shares(targets: Mapping[str, float]) -> dict[str, int]:
    """Targets, all above 0, as shares of ``UNITS`` by largest remainder; the least is 1."""
    most = max(targets.values())
    scaled = {s: v / most for s, v in targets.items()}
    total = sum(scaled.values())
    out = {s: max(1, int(v / total * UNITS)) for s, v in scaled.items()}
    out[max(out, key=lambda s: (out[s], s))] += UNITS - sum(out.values())
    return out


def period_counts(units: Mapping[str, int], period: int, periods: int) -> Iterator[dict[str, int]]:
    """Blocks of each source in each period: all that are due by its end, then the released ones due first."""
    had = dict.fromkeys(units, 0)
    for j in range(1, periods + 1):
        t = j * period
        now = {s: max(had[s], t * u // UNITS) for s, u in units.items()}
        early = [s for s, u in units.items() if now[s] * UNITS < t * u]
        early.sort(key=lambda s: (-(-(now[s] + 1) * UNITS // units[s]), s))
        for s in early[: t - sum(now.values())]:
            now[s] += 1
        yield {s: now[s] - had[s] for s in units}
        had = now


def _plan(targets: Mapping[str, float], blocks: Mapping[str, int], period: int, start: int) -> tuple[list[tuple], int]:
    """``(start, source, n, first, held)`` of every period and source that has blocks there, and the slot after the last."""
    units = shares(targets)
    slots = max(-(-blocks[s] * UNITS // u) for s, u in units.items())
    length = max(period, 4 * len(units), -(-slots // MAX_PERIODS))
    periods = -(-slots // length)
    out, had = [], dict.fromkeys(units, 0)
    for j, counts in enumerate(period_counts(units, length, periods)):
        held = {s: max(0, min(n, blocks[s] - had[s])) for s, n in counts.items()}
        if any(held.values()):
            out += [(start + j * length, s, n, had[s], held[s]) for s, n in counts.items() if n]
        for s, n in counts.items():
            had[s] += n
    return out, start + periods * length


def _laid_out(part: pd.DataFrame) -> pd.DataFrame:
    rows = {s: (n, first, held) for s, n, first, held in zip(part["s"], part["n"].tolist(), part["first"].tolist(), part["held"].tolist(), strict=True)}
    at = int(part["start"].iloc[0])
    found = pfair_period({s: n for s, (n, _, _) in rows.items()}, {s: held for s, (_, _, held) in rows.items()})
    return pd.DataFrame([(s, rows[s][1] + k, at + r, at + d, at + t) for s, k, r, d, t in found], columns=["__s", "__k", "release", "deadline", "slot"])


def tempered(counts: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights that flatten the sources' natural shares."""
    return {s: float(n) ** power for s, n in counts.items()}


def schedule(docs: DataFrame, targets: Mapping[str, float] | None = None, doc_id: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """The rows with ``block``, ``release``, ``deadline``, ``slot`` and ``in_block``; ``(slot, in_block)`` is their order.

    ``targets`` gives each source its weight (default: the square root of its number of documents). Sources it leaves out
    or gives 0 come after all others, in equal shares; if no target is above 0, all are equal. ``period`` is the least
    number of slots in a period; it grows with the number of sources and to keep the periods few. Within a source documents come in the order of a hash of their id. Every
    row is scheduled once; when a source runs out its later slots stay empty and the others keep their proportions.
    A null source is a source of its own. Rows with equal ids (null ones too) are scheduled one after another in no fixed
    order. Columns of the input named like the new ones are replaced; an empty table stays empty.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    rows = docs.withColumns({"__source": name, "__hash": F.xxhash64(F.lit("mix"), F.col(doc_id))})
    counted = rows.groupBy("__source").count().limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    counts = {r["__source"]: r["count"] for r in counted}
    wanted = tempered(counts) if targets is None else {s: float(targets.get(s[1:], 0.0)) for s in counts}
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    plan, end = [], 0
    for own in ({s: v for s, v in wanted.items() if v > 0}, {s: 1.0 for s, v in wanted.items() if not v > 0}):
        if own:
            more, end = _plan(own, blocks, period, end)
            plan += more
    spark = ship(docs.sparkSession)
    counted_periods = spark.createDataFrame(plan, "start long, s string, n long, first long, held long")
    times = counted_periods.groupBy("start").applyInPandas(_laid_out, "__s string, __k long, release long, deadline long, slot long")
    chunks = max(1, -(-sum(counts.values()) // ROWS_PER_CHUNK))
    rows = rows.drop("block", "release", "deadline", "slot", "in_block").withColumn("__chunk", F.pmod("__hash", F.lit(chunks)))
    placed = _numbered(rows, chunks).withColumn("block", F.floor(F.col("__index") / block_docs)).withColumn("in_block", F.col("__index") % block_docs)
    out = placed.join(times, (F.col("__source") == F.col("__s")) & (F.col("block") == F.col("__k")))
    return out.drop("__source", "__hash", "__chunk", "__index", "__s", "__k")


def _numbered(rows: DataFrame, chunks: int) -> DataFrame:
    """``__index`` of each row in its source, counted within hash chunks of bounded size and carried over them."""
    sizes = rows.groupBy("__source", "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(F.col("__source").alias("__cs"), F.col("__chunk").alias("__cc"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__source", "__chunk").orderBy("__hash")
    own = rows.withColumn("__rank", F.row_number().over(within))
    joined = own.join(carried, (F.col("__source") == F.col("__cs")) & (F.col("__chunk") == F.col("__cc")))
    return joined.withColumn("__index", F.col("__before") + F.col("__rank") - 1).drop("__cs", "__cc", "__before", "__rank")


def in_order() -> list[Column]:
    return [F.col("slot"), F.col("in_block")]
