"""Collections of keyed rows that are changed in place of being written anew, while readers go on reading what they opened.

A collection is a folder of immutable segments, each with its rows in folders by a hash of the key, and of numbered manifests. A manifest says for each
bucket which segments hold its rows, oldest first. A change writes a segment with the changed rows only (a deleted key is a row with a mark), and
then the next manifest, which appears by one rename and only if nobody else has taken its number; else the change is made again on top of
what the other one did. Whoever fails before the rename has changed nothing, and a manifest's segments stay as long as it does.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import located, remove


@dataclass(frozen=True)
class Manifest:
    """``segments``: for each bucket that has rows the names of its segments, oldest first."""

    version: int = 0
    buckets: int = 64
    segments: dict[int, list[str]] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Others changed the collection again and again meanwhile."""


def _hash(rows: DataFrame, names: list[str]) -> Column:
    """A hash of some columns; maps, which have none, by what they hold. A column that is not there is null."""
    kinds = dict(rows.dtypes)
    return F.xxhash64(*(F.lit(None) if c not in kinds else F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in names))


class Collection:
    """Rows with a unique ``key`` under ``path``. ``buckets`` counts for a new collection only."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc", buckets: int = 64):
        self.spark, self.path, self.key, self._buckets = spark, path, key, buckets

    # manifests

    def versions(self) -> list[int]:
        where, files = located(self.spark, f"{self.path}/manifests")
        found = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(name) for name in found if name.isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or an older one; an empty one for a collection that is none yet."""
        version = version or max(self.versions(), default=0)
        if not version:
            return Manifest(buckets=self._buckets)
        where, files = located(self.spark, f"{self.path}/manifests/{version:012d}")
        stream = files.open(where)
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Manifest(version, told["buckets"], {int(b): names for b, names in told["segments"].items()})

    def _publish(self, made: Manifest) -> bool:
        """Puts a manifest in its place; false if its number is taken."""
        target, files = located(self.spark, f"{self.path}/manifests/{made.version:012d}")
        draft, _ = located(self.spark, f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps({"buckets": made.buckets, "segments": made.segments}).encode()))
        stream.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            return False
        return True

    def _change(self, change, tries: int = 10) -> Manifest:
        """Publishes what ``change`` makes of the newest manifest's segments, again if another change came first."""
        for _ in range(tries):
            now = self.manifest()
            made = Manifest(now.version + 1, now.buckets, change(now))
            if made.segments == now.segments:
                return now
            if self._publish(made):
                return made
        raise Conflict(f"{self.path}: {tries} changes came first")

    # rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, each key's newest ones. Buckets with one segment are read as they are, only others are merged by key."""
        m = self.manifest(version)
        if not m.segments:
            raise FileNotFoundError(f"{self.path} holds no collection")
        newest = sorted({s for names in m.segments.values() for s in names}, key=lambda s: int(s.split("-")[0]))
        alone = {b for b, names in m.segments.items() if len(names) == 1}

        def of(segment: str, single: bool) -> DataFrame | None:
            mine = [b for b, names in m.segments.items() if segment in names and (b in alone) == single]
            return self._segment(segment).where(F.col("__bucket").isin(mine)).withColumn("__age", F.lit(newest.index(segment))) if mine else None

        union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        plain, layered = ([x for s in newest if (x := of(s, single)) is not None] for single in (True, False))
        parts = []
        if plain:
            parts.append(union(plain))
        if layered:
            rows = union(layered)
            rest = [c for c in rows.columns if c != self.key]
            last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "__age").alias("r"))
            parts.append(last.select(self.key, *(F.col(f"r.{c}").alias(c) for c in rest)))
        return union(parts).where(~F.col("__gone")).drop("__gone", "__bucket", "__age")

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{name}")

    def _write(self, rows: DataFrame, gone: Column, m: Manifest) -> tuple[str, list[int]]:
        """A segment of ``rows``: its name, and its buckets."""
        name = f"{m.version + 1}-{uuid.uuid4().hex[:12]}"
        dealt = rows.withColumn("__gone", gone).withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(m.buckets)).cast("int"))
        dealt.repartition("__bucket", F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(4))).write.partitionBy("__bucket").parquet(f"{self.path}/segments/{name}")
        where, files = located(self.spark, f"{self.path}/segments/{name}")
        return name, sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(where) if f.isDirectory() and "=" in f.getPath().getName())

    def _add(self, rows: DataFrame, gone: Column) -> Manifest:
        name, touched = self._write(rows, gone, self.manifest())
        return self._change(lambda now: now.segments | {b: [*now.segments.get(b, []), name] for b in touched})

    def upsert(self, rows: DataFrame) -> Manifest:
        """Adds the rows; a row takes the place of the stored one of its key. Of rows with one key, the one with the greatest hash is taken."""
        rest = [c for c in rows.columns if c != self.key]
        one = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), _hash(rows, rest)).alias("r"))
        return self._add(one.select(self.key, *(F.col(f"r.{c}").alias(c) for c in rest)), F.lit(False))

    def changed(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` that the newest snapshot lacks or has with other values."""
        if not self.versions():
            return rows
        names = sorted(set(rows.columns) - {self.key})
        stored = self.read()
        have = stored.select(F.col(self.key), _hash(stored, names).alias("__have"))
        return rows.withColumn("__want", _hash(rows, names)).join(have, self.key, "left").where(~F.col("__want").eqNullSafe(F.col("__have"))).drop("__want", "__have")

    def delete(self, keys: DataFrame) -> Manifest:
        """Marks the keys (a column named as the key) as deleted."""
        return self._add(keys.select(self.key).distinct(), F.lit(True)) if self.versions() else self.manifest()

    def compact(self, most: int = 4) -> Manifest:
        """Writes buckets with more than ``most`` segments anew, as one; the rows stay the same. A bucket that is changed meanwhile is left for the next time."""
        m = self.manifest()
        many = {b: names for b, names in m.segments.items() if len(names) > most}
        if not many:
            return m
        rows = self.read(m.version).where(F.pmod(F.xxhash64(self.key), F.lit(m.buckets)).isin(list(many)))
        name, filled = self._write(rows, F.lit(False), m)

        def change(now: Manifest) -> dict[int, list[str]]:
            same = {b for b, names in many.items() if now.segments.get(b) == names}
            kept = {b: names for b, names in now.segments.items() if b not in same}
            return dict(sorted((kept | {b: [name] for b in same if b in filled}).items()))

        return self._change(change)

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but for the last ``keep``, and segments that none of these names; returns how many segments went. Not to be run beside a change."""
        versions = self.versions()
        live = {s for v in versions[-keep:] for names in self.manifest(v).segments.values() for s in names}
        where, files = located(self.spark, f"{self.path}/segments")
        dead = [f.getPath().getName() for f in files.listStatus(where) if f.getPath().getName() not in live] if versions else []
        for v in versions[:-keep]:
            remove(self.spark, f"{self.path}/manifests/{v:012d}")
        for name in dead:
            remove(self.spark, f"{self.path}/segments/{name}")
        return len(dead)
