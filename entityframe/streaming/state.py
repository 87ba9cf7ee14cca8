"""Versioned entities under a stream of changes: base files, deltas merged on read, compaction by key range.

Every entity has one state row: its live image if it has one, the highest sequence number applied to it, its highest
archived version and when it was first created. A batch appends the state rows it changed as one delta, the images it
archived, the changes it refused, and the changes themselves to a log; then one commit names what counts. Readers go by the
newest commit, so a batch shows whole or not at all, and a batch run again writes its own folders again.

Ids are dealt into key ranges of their hash. A range whose deltas have grown to a share of its base is merged into a new
base; deltas of one level are merged into one of the next once there are ``FAN`` of them. So each row is written again a
bounded number of times, and what a batch writes follows the batch, not the store.

A change whose number is not above the entity's highest came before, and is dropped if the log has it, or came late. The
chain of an entity with late changes is worked out anew from the log, and what earlier batches archived or refused for that
entity no longer counts: the result is that of all changes in order.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityframe.model import COLUMNS
from entityframe.operators import versions
from entityframe.session import stage
from entityframe.sources.tables import packed

FAN = 8  # deltas of a level that are merged into one
SHARE = 0.5  # deltas against base, by rows, at which a range is merged
ROWS_PER_RANGE = 1_000_000
FEWEST_RANGES = 16
START = "START"
LOST = "late change of an entity whose log was removed"

_MARKS = "live boolean, high bigint, past bigint, born timestamp, bucket int, batch bigint"
_CHANGE = ("seq", "op", "id", *versions.IMAGE, "changed_at", "reason", "original_created_at")
_START = ("version", "created_at", "updated_at")


class HistoryStore:
    """The folder ``out``: ``create`` it once from the live entities, then ``apply`` batches of changes."""

    def __init__(self, spark: SparkSession, out: str, fan: int = FAN, share: float = SHARE):
        self.spark, self.out, self.fan, self.share = spark, out.rstrip("/"), fan, share

    # --- files and commits

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{path}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def _done(self) -> list[int]:
        """Numbers of the batches that are committed; the start is -1."""
        out = []
        for name in self._names("commits"):
            fs, mark = self._fs(f"commits/{name}/_SUCCESS")
            if fs.exists(mark):
                out.append(int(name))
        return out

    def _commit(self, before: int | None = None) -> dict | None:
        done = [n for n in self._done() if before is None or n < before]
        if not done:
            return None
        text = self.spark.read.schema("content string").parquet(f"{self.out}/commits/{max(done)}").first()["content"]
        found = json.loads(text)
        found["ranges"] = {int(b): r for b, r in found["ranges"].items()}
        return found

    def _write_commit(self, commit: dict, number: int) -> None:
        row = [(json.dumps({**commit, "number": number}),)]
        self.spark.createDataFrame(row, "content string").coalesce(1).write.mode("overwrite").parquet(f"{self.out}/commits/{number}")

    def _schema(self, commit: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(commit["schema"]))

    def _bucket(self, ranges: int, column: str = "id") -> Column:
        return F.pmod(F.xxhash64(column), F.lit(ranges)).cast("int")

    def _write(self, df: DataFrame, table: str, number: int) -> None:
        """A batch's rows, sorted by key range and id, so that readers skip files by their statistics."""
        key = "entity_id" if "entity_id" in df.columns else "id"
        rows = df.repartitionByRange("bucket", key).sortWithinPartitions("bucket", key)
        rows.write.mode("overwrite").parquet(f"{self.out}/{table}/batch={number}")

    def _table(self, table: str, commit: dict) -> DataFrame:
        """Rows that committed batches wrote, with the number of their ``batch``."""
        numbers = sorted(int(n.removeprefix("batch=")) for n in self._names(table))
        paths = [f"{self.out}/{table}/batch={n}" for n in numbers if n <= commit["number"]]
        shape = T.StructType([*self.spark.read.parquet(paths[0]).schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(shape).option("basePath", f"{self.out}/{table}").parquet(*paths)

    # --- the store

    def create(self, start: DataFrame, ranges: int | None = None) -> None:
        """Write the live entities once, by key range. Does nothing where the store exists."""
        if self._done():
            return
        start = packed(start).select(*COLUMNS)
        if ranges is None:
            ranges = max(FEWEST_RANGES, math.ceil(start.count() / ROWS_PER_RANGE))
        marks = {"live": F.lit(True), "high": F.lit(None).cast("bigint"), "past": F.lit(0).cast("bigint"), "born": F.col("created_at"), "batch": F.lit(-1).cast("bigint")}
        rows = start.withColumns(marks).withColumn("bucket", self._bucket(ranges))
        schema = T.StructType([*start.schema.fields, *T._parse_datatype_string(_MARKS).fields])
        self._write_base(rows.select(*schema.names), -1)
        counts = self._base_counts(-1)
        none = self.spark.createDataFrame([], schema)
        image = none.select("id", *versions.IMAGE, F.col("updated_at").alias("changed_at"), F.lit("").alias("reason"), F.col("born").alias("original_created_at"), F.col("high").alias("seq"), F.lit("").alias("op"), *_START, "past", "bucket")
        self._write(image.select(*_CHANGE, *_START, "past", "bucket"), "log", -1)
        archived = versions.apply_changes(none.select(*COLUMNS), image.select(*_CHANGE)).archived
        self._write(archived.withColumn("bucket", F.lit(0)), "history", -1)
        self._write(none.select("high", "id", F.lit("").alias("op"), F.lit("").alias("reason"), "bucket").withColumnRenamed("high", "seq"), "refused", -1)
        self._write(none.select("id", "bucket"), "rebuilt", -1)
        commit = {"schema": schema.json(), "ranges": {b: [-1, -1, counts.get(b, 0), 0] for b in range(ranges)}, "deltas": []}
        self._write_commit(commit, -1)

    def _write_base(self, rows: DataFrame, number: int) -> None:
        rows.withColumn("range", F.col("bucket")).repartition("range").sortWithinPartitions("range", "id").write.mode("overwrite").partitionBy("range").parquet(f"{self.out}/base/{number}")

    def _base_counts(self, number: int) -> dict[int, int]:
        """Rows per key range of a base; one line per range."""
        rows = self.spark.read.schema("bucket int").parquet(f"{self.out}/base/{number}").groupBy("bucket").count()
        return {r["bucket"]: r["count"] for r in rows.collect()}

    def _deltas(self, commit: dict, names: list[str], ranges: list[int] | None = None) -> DataFrame:
        """The newest row of each entity in some deltas, where its range's base is not newer."""
        rows = self.spark.read.schema(self._schema(commit)).parquet(*[f"{self.out}/deltas/{n}" for n in names])
        if ranges is not None and len(ranges) < len(commit["ranges"]):
            rows = rows.filter(F.col("bucket").isin(ranges))
        since = [(b, r[1]) for b, r in commit["ranges"].items() if ranges is None or b in set(ranges)]
        if len({s for _, s in since}) > 1:
            bases = self.spark.createDataFrame(since, "bucket int, since bigint")
            rows = rows.join(bases, "bucket").filter("batch > since").drop("since")
        else:
            rows = rows.filter(F.col("batch") > since[0][1])
        names_of = self._schema(commit).names
        return rows.groupBy("id").agg(F.max_by(F.struct(*names_of), "batch").alias("r")).select("r.*")

    def _state(self, commit: dict, ranges: list[int] | None = None) -> DataFrame:
        """State rows of some key ranges, or all: the base, but for entities that a delta has newer."""
        wanted = sorted(commit["ranges"] if ranges is None else ranges)
        paths = [f"{self.out}/base/{commit['ranges'][b][0]}/range={b}" for b in wanted if commit["ranges"][b][2]]
        schema = self._schema(commit)
        base = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if not commit["deltas"]:
            return base
        newest = self._deltas(commit, [d["name"] for d in commit["deltas"]], None if ranges is None else wanted)
        return base.join(newest.select("id"), "id", "left_anti").unionByName(newest)

    # --- batches

    def apply(self, changes: DataFrame, number: int) -> None:
        """Apply one batch. Rows that share an id and a sequence number are one change."""
        commit = self._commit(number)
        ranges = len(commit["ranges"])
        stamped = changes if "original_created_at" in changes.columns else changes.withColumn("original_created_at", F.lit(None).cast("timestamp"))
        own = stamped.select(F.col("seq").cast("bigint").alias("seq"), *_CHANGE[1:]).dropDuplicates(["id", "seq"])
        batch = stage(own.withColumn("bucket", self._bucket(ranges)), "changes")
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        if not touched:
            self._write_commit(commit, number)
            return
        ids = batch.select("id").distinct()
        known = stage(self._state(commit, touched).join(ids, "id", "left_semi"), "touched")
        placed = batch.join(known.select("id", "high"), "id", "left")
        ahead = placed.filter("high is null or seq > high").drop("high")
        late = self._late(commit, placed.filter("seq <= high").drop("high"))
        if late is None:
            done, rebuilt, lost = self._chained(known, ahead), None, None
        else:
            done, rebuilt, lost, ahead = self._rechained(commit, known, ahead, late)
        self._write(done.archived.withColumn("bucket", self._bucket(ranges, "entity_id")), "history", number)
        refused = done.refused if lost is None else done.refused.unionByName(lost)
        self._write(refused.withColumn("bucket", self._bucket(ranges)), "refused", number)
        self._write((ids.limit(0) if rebuilt is None else rebuilt).withColumn("bucket", self._bucket(ranges)), "rebuilt", number)
        self._log_batch(commit, known, ahead, number)
        self._write_delta(commit, known, ahead, done.current, number)
        self._settle(commit, number)
        self._write_commit(commit, number)

    def _late(self, commit: dict, behind: DataFrame) -> DataFrame | None:
        """Changes below an entity's highest number that the log does not have yet."""
        if behind.isEmpty():
            return None
        told = self._table("log", commit).select("id", "seq", "bucket")
        # The key range is part of the key, so that both sides' files are skipped by it.
        late = stage(behind.join(told, ["bucket", "id", "seq"], "left_anti"), "late")
        return None if late.isEmpty() else late

    def _chained(self, known: DataFrame, changes: DataFrame) -> versions.Applied:
        """Apply changes to the state as it stands; an entity that comes back keeps its first creation time."""
        back = known.filter("not live and born is not null").select("id", F.col("born").alias("__born"))
        changes = changes.join(back, "id", "left").withColumn("original_created_at", F.coalesce("__born", "original_created_at"))
        past = known.filter("past > 0").select(F.col("id").alias("entity_id"), F.col("past").alias("version"))
        return versions.apply_changes(known.filter("live").select(*COLUMNS), changes.select(*_CHANGE), past)

    def _rechained(self, commit: dict, known: DataFrame, ahead: DataFrame, late: DataFrame):
        """As ``_chained``; entities with late changes start again from their first image and take all their changes."""
        ids = late.select("bucket", "id").distinct()
        log = stage(self._table("log", commit).join(ids, ["bucket", "id"], "left_semi").drop("batch"), "logged")
        begin = log.filter(F.col("op") == START)
        whole = stage(ids.join(begin.select("id"), "id", "left_semi"), "rebuilt").select("id")
        lost = late.join(whole, "id", "left_anti").select("seq", "id", "op", F.lit(LOST).alias("reason"))
        late = late.join(whole, "id", "left_semi")
        on_time = self._chained(known.join(whole, "id", "left_anti"), ahead.join(whole, "id", "left_anti"))
        every = log.filter(F.col("op") != START).join(whole, "id", "left_semi").select(*_CHANGE)
        every = every.unionByName(ahead.join(whole, "id", "left_semi").select(*_CHANGE)).unionByName(late.select(*_CHANGE))
        first = begin.filter("version is not null").select(*COLUMNS)
        past = begin.filter("past > 0").select(F.col("id").alias("entity_id"), F.col("past").alias("version"))
        again = versions.apply_changes(first, every, past)
        both = lambda name: getattr(on_time, name).unionByName(getattr(again, name))
        done = versions.Applied(both("current"), both("archived"), both("refused"))
        return done, whole, lost, ahead.unionByName(late.select(*ahead.columns))

    def _log_batch(self, commit: dict, known: DataFrame, accepted: DataFrame, number: int) -> None:
        """The accepted changes, and the image of every entity as it was before its first change."""
        seen = known.filter("batch >= 0").select("id")
        ids = accepted.select("id", "bucket").distinct().join(seen, "id", "left_anti")
        first = ids.join(known.filter("live").drop("bucket"), "id", "left")
        start = {
            "seq": F.lit(None).cast("bigint"), "op": F.lit(START), "changed_at": F.lit(None).cast("timestamp"), "reason": F.lit(None).cast("string"),
            "original_created_at": F.lit(None).cast("timestamp"), "past": F.coalesce("past", F.lit(0)).cast("bigint"),
        }
        rows = first.withColumns(start).select(*_CHANGE, *_START, "past", "bucket")
        nothing = {"version": F.lit(None).cast("bigint"), "created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp"), "past": F.lit(0).cast("bigint")}
        self._write(rows.unionByName(accepted.withColumns(nothing).select(*rows.columns)), "log", number)

    def _write_delta(self, commit: dict, known: DataFrame, accepted: DataFrame, current: DataFrame, number: int) -> None:
        """A new state row for every entity with an accepted change."""
        schema = self._schema(commit)
        archived = self.spark.read.parquet(f"{self.out}/history/batch={number}")
        past = archived.groupBy(F.col("entity_id").alias("id")).agg(F.max("version").alias("__past"), F.min("created_at").alias("__born"))
        highest = accepted.groupBy("id", "bucket").agg(F.max("seq").alias("__high"))
        before = known.select("id", F.col("high").alias("__before"), F.col("past").alias("__had"), F.col("born").alias("__first"))
        images = current.select(F.lit(True).alias("live"), *COLUMNS)
        rows = highest.join(images, "id", "left").join(past, "id", "left").join(before, "id", "left")
        rows = rows.withColumns(
            {
                "live": F.coalesce("live", F.lit(False)),
                "high": F.greatest("__high", "__before"),
                "past": F.greatest(F.coalesce("__past", F.lit(0)), F.coalesce("__had", F.lit(0))).cast("bigint"),
                "born": F.coalesce("created_at", "__born", "__first"),
                "batch": F.lit(number).cast("bigint"),
            }
        )
        name = f"{number}-0"
        rows = rows.select(*schema.names).repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
        rows.write.mode("overwrite").parquet(f"{self.out}/deltas/{name}")
        # One line per key range.
        for r in self.spark.read.schema("bucket int").parquet(f"{self.out}/deltas/{name}").groupBy("bucket").count().collect():
            commit["ranges"][r["bucket"]][3] += r["count"]
        commit["deltas"].append({"name": name, "level": 0, "last": number})

    # --- compaction

    def _settle(self, commit: dict, number: int) -> None:
        """Merge ranges whose deltas have grown, then levels that are full."""
        grown = [b for b, (_, _, rows, fresh) in commit["ranges"].items() if fresh and fresh >= self.share * rows]
        if grown:
            self._write_base(self._state(commit, grown), number)
            counts = self._base_counts(number)
            for b in grown:
                commit["ranges"][b] = [number, number, counts.get(b, 0), 0]
        oldest = min(r[1] for r in commit["ranges"].values() if r[3]) if any(r[3] for r in commit["ranges"].values()) else number
        commit["deltas"] = [d for d in commit["deltas"] if d["last"] > oldest]
        level = 0
        while len(full := [d for d in commit["deltas"] if d["level"] == level]) >= self.fan:
            name = f"{number}-{level + 1}"
            rows = self._deltas(commit, [d["name"] for d in full]).repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
            rows.write.mode("overwrite").parquet(f"{self.out}/deltas/{name}")
            merged = {"name": name, "level": level + 1, "last": max(d["last"] for d in full)}
            commit["deltas"] = [d for d in commit["deltas"] if d["level"] != level] + [merged]
            level += 1

    def vacuum(self, keep_log_from: int | None = None) -> None:
        """Delete what the newest commit does not name: old bases, merged deltas, old commits; on request also the log of
        batches before a number, after which late changes of entities first changed there are refused."""
        commit = self._commit()
        named = {d["name"] for d in commit["deltas"]}
        for name in self._names("deltas"):
            if name not in named and int(name.split("-")[0]) <= commit["number"]:
                self._delete(f"deltas/{name}")
        for name in self._names("commits"):
            if int(name) < commit["number"]:
                self._delete(f"commits/{name}")
        bases = {(str(r[0]), b) for b, r in commit["ranges"].items()}
        for name in self._names("base"):
            for part in self._names(f"base/{name}"):
                if part.startswith("range=") and (name, int(part[6:])) not in bases:
                    self._delete(f"base/{name}/{part}")
        if keep_log_from is not None:
            for name in self._names("log"):
                if 0 <= int(name.removeprefix("batch=")) < min(keep_log_from, commit["number"] + 1):
                    self._delete(f"log/{name}")

    def _delete(self, path: str) -> None:
        fs, place = self._fs(path)
        fs.delete(place, True)

    # --- reading

    def current(self) -> DataFrame:
        """The live entities as of the newest commit."""
        return self._state(self._commit()).filter("live").select(*COLUMNS)

    def _standing(self, table: str, key: str) -> DataFrame:
        """Rows that a later rebuild of their entity has not replaced."""
        commit = self._commit()
        rebuilt = self._table("rebuilt", commit).groupBy(F.col("id").alias("__id")).agg(F.max("batch").alias("__from"))
        rows = self._table(table, commit)
        kept = rows.join(rebuilt, F.col(key) == F.col("__id"), "left").filter("__from is null or batch >= __from")
        return kept.drop("__id", "__from", "bucket", "batch")

    def history(self) -> DataFrame:
        """The archived images."""
        return self._standing("history", "entity_id")

    def refused(self) -> DataFrame:
        """The refused changes: ``seq, id, op, reason``."""
        return self._standing("refused", "id")
