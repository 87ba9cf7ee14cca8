"""Fuzzy line deduplication with DataFrame functions only.

A line is normalised (lower case, white space runs to one blank, trimmed). Its shingles are its 12-character strings: those
at every character with ``whole``, else only those that start at a word, which leave the rest of long words, the end of the
line and scripts without blanks unread. Different lines are opened into a row per shingle, and an aggregate that needs no
shuffle keeps 36 of the hashes. Short lines: each hash is put through 18 permutations (rotations of two independent hashes),
and the smallest and the largest value under each are kept. Long lines (``LONG`` shingles or more), to which nearly all
shingles belong: each hash falls into one of 36 bins, and the smallest of each bin is kept. Three such values make a band, so
two lines share a band with the third power of their similarity, whatever their length. Sets a quarter larger than the
border, and long lines that leave a bin empty (they repeat few shingles), take part in both ways, so that the lines of a
similar pair always meet in one.

Lines that share a band are only proposed. First every line of a bucket is held against the line of the bucket with the
most copies. Lines of buckets that still hold several components are then joined on their rarest shingles (a prefix
filter): a similar pair shares one of the rarest of both, and a line that shares too few with any other falls out at once.
The work follows the shingles and the pairs so found, not the square of a bucket. All links are exact Jaccard similarities
of the shingle sets. Components come from alternating stars; the first line of each (smallest id, then line number) stays.

Equal lines are recognised by a 64-bit hash: among n different lines the chance of any false match is about n²/2^65.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityframe.llm.components import components
from entityframe.llm.text import let
from entityframe.session import discard, stage

MIN_CHARS = 24
SHINGLE_CHARS = 12
BANDS = 12
PERMUTATIONS = 18  # each gives two values, so that every band has three
ROTATION = 7  # bits between two permutations of one hash
LONG = 24  # shingles from which a line is put in bins
PERCENT = 80
BLOCK = 256  # lines of a shingle from which they meet by classes of size
SIZE_CLASSES = 8  # between a size and the largest similar one
_LAST = (1 << 63) - 1
_ODD_SPACE = ("  ", "\t", "\x0b", "\x0c", "\r", "\n")


def normalised(line: Column) -> Column:
    """Only lines that hold other white space than single blanks go through the regular expression."""
    odd = functools.reduce(lambda x, y: x | y, [line.contains(c) for c in _ODD_SPACE])
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")).otherwise(line)))


def _at_words(norm: Column) -> Column:
    pattern = rf"(?s)(?<![^ ])(?=([^ ].{{{SHINGLE_CHARS - 1}}}))"
    return F.transform(F.regexp_extract_all(norm, F.lit(pattern), F.lit(1)), lambda s: F.xxhash64(s))


def _at_characters(norm: Column) -> Column:
    """Slices of fixed size: linear in the line, whatever its length."""
    cut = lambda wide, flat: F.transform(_starts(wide, flat), lambda i: _slice_hash(wide, flat, i))
    narrow = let(F.encode(norm, "UTF-16BE"), lambda wide: cut(wide, True))
    return F.when(_flat(norm), narrow).otherwise(let(F.encode(norm, "UTF-32"), lambda wide: cut(wide, False)))


def _flat(norm: Column) -> Column:
    """Whether every character has two bytes in UTF-16; the characters of other lines have four in UTF-32."""
    return F.octet_length(F.encode(norm, "UTF-16BE")) == 2 * F.length(norm)


def _starts(wide: Column, flat: bool) -> Column:
    """The first bytes, from 1, of a line's shingles; a line shorter than one has none."""
    step = 2 if flat else 4
    last = F.octet_length(wide) - (step * SHINGLE_CHARS - 1)
    return F.when(last > 0, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _slice_hash(wide: Column, flat: bool, start: Column) -> Column:
    """The hash of a shingle's UTF-16, the same whichever form its line is in."""
    if flat:
        return F.xxhash64(F.substring(wide, start, F.lit(2 * SHINGLE_CHARS)))
    # The mark of the byte order goes first: a decoder takes it away, and would take away one that belongs to the line.
    marked = F.concat(F.unhex(F.lit("0000FEFF")), F.substring(wide, start, F.lit(4 * SHINGLE_CHARS)))
    return F.xxhash64(F.encode(F.decode(marked, "UTF-32"), "UTF-16BE"))


def shingle_hashes(norm: Column, distinct: bool = True, whole: bool = False) -> Column:
    """Sorted hashes of the shingles; a signature does not mind repeated ones."""
    hashes = _at_characters(norm) if whole else _at_words(norm)
    return F.sort_array(F.array_distinct(hashes) if distinct else hashes)


def shingle_set(norm: Column, whole: bool = False) -> Column:
    """The hashes of the shingles, each once, in no order."""
    return F.array_distinct(_at_characters(norm) if whole else _at_words(norm))


def hashed(lines: DataFrame, whole: bool = False) -> DataFrame:
    """``(key, h)``: a row per shingle of ``(key, norm)``. Every shingle is a slice of fixed size."""
    if not whole:
        pattern = rf"(?s)(?<![^ ])(?=([^ ].{{{SHINGLE_CHARS - 1}}}))"
        return lines.select("key", F.explode(F.regexp_extract_all("norm", F.lit(pattern), F.lit(1))).alias("s")).select("key", F.xxhash64("s").alias("h"))
    # Lines that are not flat are opened into their hashes at once: what is done to each row stays short. The places are a
    # column of their own: a function on arrays within the generator would keep it, and all rows, from being compiled.
    norm, u, i, flat = F.col("norm"), F.col("u"), F.col("i"), F.col("flat")
    wide = lines.select("key", _flat(norm).alias("flat"), F.encode(norm, "UTF-16BE").alias("u"), norm)
    places = F.when(flat, _starts(u, True).cast("array<long>")).otherwise(_at_characters(norm))
    opened = wide.select("key", "flat", "u", places.alias("places")).select("key", "flat", "u", F.explode("places").alias("i"))
    return opened.select("key", F.when(flat, _slice_hash(u, True, i.cast("int"))).otherwise(i).alias("h"))


def bands(shingles: DataFrame) -> DataFrame:
    """``key`` and its bands ``b0`` … from ``(key, h)``; rows of a key may be spread, and shingles may repeat."""
    turned = lambda h, bits: F.col(h) if not bits else F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))
    half = PERMUTATIONS // 2
    both = shingles.select("key", "h", F.xxhash64("h").alias("g"))
    turns = both.select("key", *[turned("hg"[k // half], ROTATION * (k % half)).alias(f"p{k}") for k in range(PERMUTATIONS)])
    kept = [f(f"p{k}").alias(f"v{k + PERMUTATIONS * n}") for n, f in enumerate((F.min, F.max)) for k in range(PERMUTATIONS)]
    band = lambda j: F.xxhash64(F.lit(j), *[f"v{k}" for k in range(j, 2 * PERMUTATIONS, BANDS)])
    return turns.groupBy("key").agg(*kept).select("key", *[band(j).alias(f"b{j}") for j in range(BANDS)])


def binned_bands(shingles: DataFrame) -> DataFrame:
    """``key``, its bands ``b0`` … from ``(key, h)``, and ``full``: no bin is empty. Empty bins of two sets count as equal; a
    band of empty bins is null."""
    n = PERMUTATIONS
    # The low half of a hash names the bin, the high half the order within it.
    bin_of = lambda h: F.expr(f"cast(shiftright(({h} & 4294967295) * {n}, 32) as int)")
    both = shingles.select("key", "h", F.xxhash64("h").alias("g")).select("key", "h", "g", bin_of("h").alias("h_bin"), bin_of("g").alias("g_bin"))
    least = lambda k: F.expr(f"min({'hg'[k // n]}) filter (where {'hg'[k // n]}_bin = {k % n})").alias(f"v{k}")
    kept = both.groupBy("key").agg(*[least(k) for k in range(2 * n)])
    all_of = lambda found: functools.reduce(lambda x, y: x & y, found)

    def band(j: int) -> Column:
        of = [F.col(f"v{k}") for k in range(j, 2 * n, BANDS)]
        return F.when(~all_of([v.isNull() for v in of]), F.xxhash64(F.lit(BANDS + j), *[F.coalesce(v, F.lit(0).cast("long")) for v in of]))

    full = all_of([F.col(f"v{k}").isNotNull() for k in range(2 * n)])
    return kept.select("key", *[band(j).alias(f"b{j}") for j in range(BANDS)], full.alias("full"))


def fits(na: Column, nb: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def similar(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two arrays of distinct hashes, with the sizes looked at first."""
    na, nb = F.size(a), F.size(b)
    inter = F.size(F.array_intersect(a, b))
    return F.when(fits(na, nb), (100 + PERCENT) * inter >= PERCENT * (na + nb)).otherwise(F.lit(False))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every row with ``__id`` (rows without one come last) and ``__hash`` of its text; equal rows are one document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), "__hash": F.xxhash64(whole), "__lines": F.split(whole, "\n")})


def _lines(rows: DataFrame, whole: bool) -> DataFrame:
    """``__id, __hash, __no, norm, key`` of each line that takes part: with ``whole`` all that are not blank, else long ones."""
    # No text is without a line; the outer form keeps Spark from splitting every text once more, in a filter on their number.
    lines = rows.select("__id", "__hash", F.posexplode_outer("__lines").alias("__no", "__line"))
    taken = lines if whole else lines.filter(F.length("__line") >= MIN_CHARS)
    # Opened from an array of one, a line is normalised once, not in the filter too.
    normal = taken.select("__id", "__hash", "__no", F.explode_outer(F.array(normalised(F.col("__line")))).alias("norm"))
    return normal.filter(F.length("norm") >= (1 if whole else MIN_CHARS)).withColumn("key", F.xxhash64("norm"))


def _linked(pairs: DataFrame, texts: DataFrame, whole: bool) -> DataFrame:
    """Of pairs ``(a, b)`` of keys, those whose lines are similar."""
    first, second = (texts.select(F.col("key").alias(k), F.col("norm").alias(f"{k}_norm")) for k in "ab")
    both = F.struct(shingle_set(F.col("a_norm"), whole).alias("x"), shingle_set(F.col("b_norm"), whole).alias("y"))
    # Opened from an array of one, the sets are made once and compared by compiled code.
    opened = pairs.join(second, "b").join(first, "a").select("a", "b", F.explode(F.array(both)).alias("sets"))
    return opened.filter(similar(F.col("sets")["x"], F.col("sets")["y"])).select("a", "b")


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Few bytes and much work: as many tasks as a shuffle has, not as few as its bytes would fill."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """``h, key, component, n, most_n`` of the rarest shingles of each line of ``(key, component, hashes)``.

    The shingles of a line stand in the order of how many lines have them, rarest first. Two similar lines share one that
    stands so early in both that the rest of either can still hold what they must have in common; ``most_n`` is the size up
    to which another line may meet this one there. Shingles of one line or one component alone are left out.
    """
    # No set is empty; the outer form keeps Spark from making every set once more, in a filter on its size.
    shingles = sets.select("key", "component", F.size("hashes").alias("n"), F.explode_outer("hashes").alias("h"))
    shared = shingles.groupBy("h").agg(F.count("*").alias("lines"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = stage(shared.filter("lines > 1").select("h", "lines", (F.col("low") < F.col("high")).alias("mixed")), "line-shared", "zstd")
    of_line = Window.partitionBy("key", "component", "n")
    found = shingles.join(shared.hint("shuffle_hash"), "h").withColumn("i", F.row_number().over(of_line.orderBy("lines", "h")) - 1)
    left = F.count("*").over(of_line).cast("int") - F.col("i")
    # The smallest partner has PERCENT of the line's size, all of it in common: what stands later is of no use.
    opened = found.withColumn("left", left).filter(F.col("mixed") & (F.col("left") >= _least_size(F.col("n"))))
    most = F.floor(((100 + PERCENT) * F.col("left") - PERCENT * F.col("n")) / PERCENT).cast("int")
    return opened.select("h", "key", "component", "n", most.alias("most_n"))


def _least_size(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100).cast("int")


def candidates(sets: DataFrame) -> DataFrame:
    """``a, b``: the pairs of lines of ``(key, component, hashes)`` in different components that may be similar, by their
    rarest shingles. No similar pair is left out."""
    rare = stage(_rare_shingles(sets), "line-rare", "zstd")
    # Most lines of a frequent shingle are of one component: its other lines meet all, its own lines only those others.
    counts = rare.groupBy("h", "component").agg(F.count("*").alias("c")).groupBy("h")
    tops = counts.agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.count("*").alias("k"), F.sum("c").alias("c"))
    rows = rare.join(tops.filter("k > 1").select("h", "top", (F.col("c") > BLOCK).alias("often")), "h").withColumn("own", F.col("component") == F.col("top"))

    step = math.log(100 / PERCENT) / SIZE_CLASSES
    of_size = lambda n: F.floor(F.log(n) / step).cast("int")
    # Shingles of more than BLOCK lines are met by classes of size; the others need none.
    size = F.when(F.col("often"), of_size(F.col("n"))).otherwise(0)
    sizes = lambda low, high: F.explode(F.when(F.col("often"), F.sequence(of_size(low), of_size(high))).otherwise(F.array(F.lit(0))))
    n, most = F.col("n"), F.col("most_n")
    small = rows.filter(most >= n).select("h", size.alias("sx"), sizes(n, most).alias("sy"), F.col("own").cast("int").alias("side"), F.struct("key", "component", "n", "most_n").alias("x"))
    sides = rows.select("*", F.explode(F.when(F.col("own"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    large = sides.select("h", sizes(_least_size(n), F.least(most, n)).alias("sx"), size.alias("sy"), "side", F.struct("key", "component", "n", "most_n").alias("y"))
    x, y = F.col("x"), F.col("y")
    met = _dealt(small, "h", "sx", "sy", "side").join(_dealt(large, "h", "sx", "sy", "side"), ["h", "sx", "sy", "side"])
    met = met.filter((x["component"] != y["component"]) & (x["n"] <= y["n"]) & (y["n"] <= x["most_n"]) & (x["n"] <= y["most_n"]))
    return met.select(F.least(x["key"], y["key"]).alias("a"), F.greatest(x["key"], y["key"]).alias("b")).distinct()


def _more_links(members: DataFrame, texts: DataFrame, whole: bool) -> DataFrame:
    """Links between components that still share a bucket; ``members`` has ``bucket, key, component``, without the buckets'
    hubs, which every other member was held against."""
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    lines = stage(members.join(mixed.select("bucket"), "bucket").select("key", "component").distinct(), "line-mixed", "zstd")
    sets = lines.join(texts, "key").select("key", "component", F.explode(F.array(shingle_set(F.col("norm"), whole))).alias("hashes"))
    return _linked(_dealt(candidates(sets), "a", "b"), texts, whole)


def _components(lines: DataFrame, whole: bool) -> DataFrame:
    """``key, component`` of every long line that is linked to a different line; the staged ``lines`` are used up."""
    long = lines.filter(F.length("norm") >= MIN_CHARS)
    # Copies are reduced to one before the shuffle. What is opened into shingles stands by key already, so the bands need no
    # further one, and the second use of the different lines reads the same shuffle.
    distinct = long.groupBy("key").agg(F.first("norm").alias("norm"))
    copies = long.groupBy("key").agg(F.count("*").alias("copies"))
    names = [f"b{k}" for k in range(BANDS)]
    n = F.length("norm") - SHINGLE_CHARS + 1
    small = n * PERCENT < 100 * LONG  # no line of fewer shingles than LONG is similar to one that is not small
    whose = lambda made: made.join(distinct, "key").join(copies, "key")
    if whole:
        in_bins = whose(binned_bands(hashed(distinct.filter(n >= LONG), whole))).withColumn("once", F.lit(True))
        short = whose(bands(hashed(distinct.filter(small), whole)).withColumn("full", F.lit(True))).withColumn("once", n < LONG)
        known = stage(in_bins.union(short.select(in_bins.columns)), "line-bands", "zstd")
        again = known.filter(~F.col("full") & ~small)
        again = stage(bands(hashed(again, whole)).join(again.select("key", "copies"), "key"), "line-bands-again", "zstd")
        banded = known.select("key", "copies", *names).union(again.select("key", "copies", *names))
        lines_once = known.filter("once").select("key", "norm")
    else:
        known = banded = stage(whose(bands(hashed(distinct, whole))), "line-bands", "zstd")
        lines_once = known.select("key", "norm")
    discard(lines)

    rank = F.col("copies") * (1 << 16) + F.pmod("key", F.lit(1 << 16))
    rows = banded.select("key", rank.alias("rank"), F.explode(F.array(*names)).alias("bucket")).filter("bucket is not null and rank is not null")
    # Few buckets hold two lines, so nothing is gained by aggregating before the shuffle; hubs and members read the same one,
    # for which both must ask for the same columns.
    rows = _dealt(rows, "bucket")
    hubs = rows.groupBy("bucket").agg(F.max_by("key", "rank").alias("hub"), F.max("rank").alias("most"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(hubs.hint("shuffle_hash"), "bucket").filter("rank <= most")
    members = stage(joined.select("bucket", "key", "hub"), "line-buckets", "zstd")
    texts = stage(lines_once.join(members.select("key").distinct(), "key"), "line-texts", "zstd")
    discard(known)

    pairs = members.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    links = stage(_linked(pairs, texts, whole), "line-links")

    first_round = components(links).withColumnRenamed("id", "key")
    placed = members.filter("key <> hub").select("bucket", "key").join(first_round, "key", "left").withColumn("component", F.coalesce("component", "key"))
    more = _more_links(stage(placed, "line-places", "zstd"), texts, whole)
    return components(links.union(more)).withColumnRenamed("id", "key")


def line_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``key, component`` of every line that is linked to a different line."""
    return _numbered(_identified(docs.select(doc_id, text), doc_id, text), whole)[1]


def _numbered(rows: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """``__id, __hash, __no, key`` of the lines that take part, and the components of the long ones."""
    lines = stage(_lines(rows, whole), "lines", "zstd")
    numbers = stage(lines.drop("norm"), "line-numbers", "zstd")
    linked = _components(lines, whole)
    return numbers, linked


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """The rows with ``text`` reduced to the lines that stay, plus ``n_lines`` and ``n_removed``.

    Of all lines in one component, or equal once normalised, the first stays, in order of id and line number; the line
    break of a removed line goes with it. Lines under 24 characters are too short to be called similar. ``whole`` takes
    shingles at every character and removes equal short lines too, all but blank ones; without it short lines stay. Null
    texts stay null, with no line. Rows without an id take part after all others. Equal rows (same id, same text) are one
    document and are all treated alike. Other columns are kept; columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    rows = _identified(docs, doc_id, text)
    lines, linked = _numbered(rows.select("__id", "__hash", "__lines"), whole)
    # The first place of a line, then of its component: hot lines and components are reduced before each shuffle.
    at = F.struct("__id", "__hash", "__no")
    places = lines.groupBy("key").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    joined = places.join(linked.hint("shuffle_hash"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    joined = stage(joined, "line-places", "zstd")
    first = joined.groupBy("component").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter(F.col("first") != F.col("last"))
    of_key = joined.select("key", "component").join(first.select("component", "first"), "component").select("key", "first")
    gone = lines.select("__id", "__hash", "__no", "key").join(of_key, "key").filter(at != F.col("first"))
    gone = gone.groupBy("__id", "__hash").agg(F.collect_set("__no").alias("__gone"))

    joined = rows.join(gone.hint("shuffle_hash"), ["__id", "__hash"], "left")
    stays = F.filter("__lines", lambda line, i: ~F.array_contains(F.col("__gone"), i))
    none = F.lit(0).cast("long")
    return joined.withColumns(
        {
            text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n")),
            "n_lines": F.when(F.col(text).isNull(), none).otherwise(F.size("__lines").cast("long")),
            "n_removed": F.coalesce(F.size("__gone").cast("long"), none),
        }
    ).drop("__id", "__hash", "__lines", "__gone")
