"""Whole-store comparison by digests: what is equal is never opened.

A snapshot's digests are kept per entity and per bucket of keys. Two snapshots compare their bucket digests first (one row a
bucket), then the entities of unequal buckets, and only entities whose digests differ are flattened and compared key by
key. A snapshot that was digested before is not hashed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityframe.functions.props import Bag
from entityframe.operators import versions
from entityframe.session import stage
from entityframe.sources.tables import packed

BUCKETS = 4096
ENVELOPE = ("organization_id", "schema_id", "entity_type", "path")


class Digests:
    """The digests of a snapshot: ``entities`` (the key, ``bucket``, ``digest``) and ``buckets`` (``bucket, n, sum``).

    A digest is 128 bits, from two hashes of the entity's property bag as JSON and, with ``envelope``, of its place. Bags that
    are equal but written differently (fields in another order) have different digests, which costs a look at their keys
    and changes no result. The key must be unique.
    """

    def __init__(self, snapshot: DataFrame, on: tuple[str, ...] = ("id",), buckets: int = BUCKETS, envelope: bool = False):
        self.snapshot, self.on, self.count = packed(snapshot), on, buckets
        text = Bag.of(self.snapshot).json()
        place = [F.coalesce(c, F.lit("\0")) for c in ENVELOPE] if envelope else []
        digest = F.struct(*[F.xxhash64(F.lit(n), *place, text).alias(f"h{n}") for n in (1, 2)])
        bucket = F.pmod(F.xxhash64(*on), F.lit(buckets)).cast("int")
        rows = self.snapshot.select(*on, bucket.alias("bucket"), digest.alias("digest"))
        self.entities = stage(rows.repartitionByRange("bucket").sortWithinPartitions("bucket"), "digests")
        both = F.xxhash64(*on, "digest.h1", "digest.h2").cast("decimal(38,0)")
        self.buckets = stage(self.entities.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(both).alias("sum")), "bucket-digests")

    def unequal_buckets(self, other: Digests) -> DataFrame:
        """``bucket`` of those whose entities or digests are not the same on both sides."""
        theirs = other.buckets.select("bucket", F.col("n").alias("__n"), F.col("sum").alias("__sum"))
        both = self.buckets.join(theirs, "bucket", "full_outer")
        return both.filter(~(F.col("n").eqNullSafe(F.col("__n")) & F.col("sum").eqNullSafe(F.col("__sum")))).select("bucket")

    def changed(self, other: Digests) -> DataFrame:
        """The keys that stand on one side only or have different digests."""
        if (self.on, self.count) != (other.on, other.count):
            raise ValueError("digests of different keys or numbers of buckets do not compare")
        # At most one row a bucket: the list is bounded by the number of buckets.
        wanted = [r["bucket"] for r in self.unequal_buckets(other).collect()]
        sides = [d.entities.filter(F.col("bucket").isin(wanted)).select(*d.on, F.col("digest").alias(name)) for d, name in ((self, "__a"), (other, "__b"))]
        return sides[0].join(sides[1], list(self.on), "full_outer").filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(*self.on)

    def diff(self, newer: Digests) -> DataFrame:
        """Key-level differences from this snapshot to a newer one, as ``versions.diff`` gives them for all entities."""
        keys = stage(self.changed(newer), "changed-keys")
        base, target = (d.snapshot.join(keys, list(self.on), "left_semi") for d in (self, newer))
        return versions.diff(base, target, list(self.on))
