"""Stored tables that change: touched partitions are written anew, and one small file names what the table now consists of.

A table is a folder with `data/` (parquet folders that are never changed) and `versions/` (one JSON file per version, which lists the
folders of every partition). A change reads the partitions it touches, writes their successors, and then creates the next version's
file, which only one writer can do; a writer that comes second starts again from the new version. Readers keep the version they began
with. A failure before the last step leaves folders that no version names: the table is as it was, and `vacuum` removes them.

Partitions are hash buckets of the key, so that a change finds its rows without an index; with a time column also days, so that old
days leave without being read. The file system must create files exclusively (HDFS and local disks do)."""

from __future__ import annotations

import json
import time as clock
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PART = "__part"
#: A version file that cannot be read counts as one being written for so many seconds.
GRACE = 60.0


class Conflict(Exception):
    """Another writer made the next version first."""


class Files:
    """The few file operations a table needs, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def listed(self, name: str) -> list[tuple[str, float]]:
        """Names and ages in seconds of what a folder holds."""
        at = self.path(name)
        now = clock.time() * 1000
        return [(s.getPath().getName(), (now - s.getModificationTime()) / 1000) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Fails if the file is there."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as ex:
            if "AlreadyExists" in str(ex):
                raise Conflict(name) from None
            raise
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Table:
    """A stored table, found by its folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    # versions ----------------------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self.files.listed("versions") if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> dict:
        """What a version consists of; by default the newest."""
        if version is not None:
            return json.loads(self.files.read(f"versions/{version:010d}.json"))
        ages = dict(self.files.listed("versions"))
        for v in reversed(self.versions()):
            name = f"{v:010d}.json"
            try:
                return json.loads(self.files.read(f"versions/{name}"))
            except ValueError:
                if ages.get(name, 0) < GRACE:
                    raise Conflict(name) from None  # being written
        raise FileNotFoundError(f"no table in {self.path}")

    def exists(self) -> bool:
        return bool(self.versions())

    def _commit(self, old: dict, parts: dict[str, list[str]], token: tuple[str, int] | None, seen: Sequence[int] = ()) -> dict:
        """Create the next version's file: the moment of the change. seen: the versions listed before `old` was read, so that a version
        made since then has the same number and one of the two writers starts again."""
        new = old | {"version": max([old["version"], *seen]) + 1, "parts": {p: f for p, f in parts.items() if f}}
        if token:
            new["done"] = old["done"] | {token[0]: token[1]}
        self.files.create(f"versions/{new['version']:010d}.json", json.dumps(new))
        return new

    def _change(self, step: Callable[[dict], dict[str, list[str]] | None], token: tuple[str, int] | None, attempts: int = 10) -> dict:
        """Run a step on the newest version until its result can be committed. A token (stream, batch) is applied once."""
        for attempt in range(attempts):
            try:
                seen = self.versions()
                old = self.snapshot()
                if token and old["done"].get(token[0], -1) >= token[1]:
                    return old
                parts = step(old)
                return old if parts is None and not token else self._commit(old, old["parts"] if parts is None else parts, token, seen)
            except Conflict:
                if attempt + 1 == attempts:
                    raise
                clock.sleep(min(2.0, 0.05 * 2**attempt))
        raise AssertionError

    # partitions --------------------------------------------------------------------------------------------------------------------

    @staticmethod
    def _part(spec: dict) -> Column:
        bucket = F.pmod(F.xxhash64(*spec["key"]), F.lit(spec["buckets"])).cast("string")
        return F.concat(F.lit("b"), bucket) if spec["time"] is None else F.concat(F.coalesce(F.to_date(spec["time"]).cast("string"), F.lit("none")), F.lit("-b"), bucket)

    def _write(self, spec: dict, rows: DataFrame) -> dict[str, str]:
        """Write rows into fresh folders; the folder of every partition that got any."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PART, self._part(spec)).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        return {n.removeprefix(f"{PART}="): f"{folder}/{n}" for n, _ in self.files.listed(folder) if n.startswith(f"{PART}=")}

    def _rows(self, snap: dict, parts: Sequence[str] | None = None) -> DataFrame:
        folders = [f for p, fs in snap["parts"].items() if parts is None or p in parts for f in fs]
        schema = T.StructType.fromJson(snap["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _holding(self, snap: dict, keys: DataFrame) -> list[str]:
        """Partitions that may hold rows with these keys: their buckets; with days, those whose key column has one."""
        if snap["time"] is None:
            found = keys.select(self._part(snap).alias("p")).distinct().collect()
            return sorted({r["p"] for r in found} & set(snap["parts"]))
        buckets = {r["p"] for r in keys.select(self._part(snap | {"time": None}).alias("p")).distinct().collect()}
        parts = [p for p in snap["parts"] if p.rsplit("-", 1)[1] in buckets]
        part = F.regexp_extract(F.col("_metadata.file_path"), f"{PART}=([^/]+)/", 1)
        held = self._rows(snap, parts).select(part.alias("p"), *[F.col(k) for k in snap["key"]])
        return sorted(r["p"] for r in held.join(keys, self._same(snap["key"], held, keys), "left_semi").select("p").distinct().collect())

    @staticmethod
    def _same(key: Sequence[str], a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])

    def _replaced(self, snap: dict, touched: Sequence[str], rows: DataFrame) -> dict[str, list[str]]:
        """Parts with the touched ones replaced by what `rows` give."""
        parts = {p: list(f) for p, f in snap["parts"].items() if p not in set(touched)}
        for p, folder in self._write(snap, rows).items():
            parts.setdefault(p, []).append(folder)
        return parts

    # what a user does --------------------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str | Sequence[str], buckets: int = 16, time: str | None = None) -> Table:
        """A new table. buckets: so many that a bucket (of a day, with a time column) is what one task should rewrite."""
        table = cls(rows.sparkSession, path)
        spec = {"version": 0, "key": [key] if isinstance(key, str) else list(key), "buckets": buckets, "time": time, "schema": rows.schema.jsonValue(), "parts": {}, "done": {}}
        table._commit(spec, {p: [f] for p, f in table._write(spec, rows).items()}, None)
        return table

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. It stays readable while later ones are made, until it is vacuumed."""
        return self._rows(self.snapshot(version))

    def append(self, rows: DataFrame, token: tuple[str, int] | None = None) -> None:
        """Add rows as they are; nothing is read."""
        self._change(lambda snap: self._replaced(snap, (), rows.select(*self._columns(snap))), token)

    def _columns(self, snap: dict) -> list[str]:
        return [f["name"] for f in snap["schema"]["fields"]]

    def insert_once(self, rows: DataFrame, token: tuple[str, int] | None = None) -> int:
        """Add one row for each key that the table does not have yet; returns how many. Only the keys of the buckets that the load
        falls into are read, and of two loaders of the same keys one finds the other's."""
        added = 0

        def step(snap: dict) -> dict[str, list[str]] | None:
            nonlocal added
            fresh = rows.select(*self._columns(snap)).dropDuplicates(snap["key"])
            held = self._rows(snap, self._holding(snap, fresh.select(*snap["key"]))).select(*snap["key"])
            written = self._write(snap, fresh.join(held, self._same(snap["key"], fresh, held), "left_anti"))
            added = self.spark.read.parquet(*[f"{self.path}/{f}" for f in written.values()]).count() if written else 0
            return {p: [*snap["parts"].get(p, []), *([written[p]] if p in written else [])] for p in {*snap["parts"], *written}} if written else None

        self._change(step, token)
        return added

    def upsert(self, changes: DataFrame, order: str | None = None, token: tuple[str, int] | None = None) -> None:
        """Rows of `changes` replace those with the same key or are added. Of several changes of a key the one with the largest
        `order` counts; without it, or in a tie, the largest row."""

        def step(snap: dict) -> dict[str, list[str]] | None:
            key, columns = snap["key"], self._columns(snap)
            rest = [c for c in columns if c not in key]
            rank = F.struct(*([F.col(order).alias("__order")] if order else []), *rest)
            new = changes.groupBy(*key).agg(F.max(rank).alias("__c")).select(*key, *[F.col(f"__c.{c}").alias(c) for c in rest]).select(*columns)
            touched = self._holding(snap, new.select(*key))
            old = self._rows(snap, touched)
            return self._replaced(snap, touched, old.join(new, self._same(key, old, new), "left_anti").unionByName(new))

        self._change(step, token)

    def update(self, changes: DataFrame, order: str | None = None, clear: str | None = None, token: tuple[str, int] | None = None) -> None:
        """Set the non-null columns of `changes` on the rows with the same key (see operators.maintenance.update_by_id); keys that the
        table does not have change nothing."""
        from tidemark.operators.maintenance import update_by_id

        def step(snap: dict) -> dict[str, list[str]] | None:
            (key,) = snap["key"]
            touched = self._holding(snap, changes.select(key))
            return self._replaced(snap, touched, update_by_id(self._rows(snap, touched), changes, key, order, clear)) if touched else None

        self._change(step, token)

    def delete(self, ids: DataFrame, token: tuple[str, int] | None = None) -> None:
        """Take out the rows with these keys; partitions without any are not read beyond the keys."""

        def step(snap: dict) -> dict[str, list[str]] | None:
            gone = ids.select(*snap["key"]).distinct()
            touched = self._holding(snap, gone)
            old = self._rows(snap, touched)
            return self._replaced(snap, touched, old.join(gone, self._same(snap["key"], old, gone), "left_anti")) if touched else None

        self._change(step, token)

    def retain(self, as_of: str, days: int) -> tuple[int, int]:
        """Take out rows older than the retention period or without a time; returns rows kept and deleted.

        Whole days leave by being named no more, and only the day that the limit falls into is written anew."""
        report = (0, 0)

        def step(snap: dict) -> dict[str, list[str]] | None:
            nonlocal report
            if snap["time"] is None:
                raise ValueError("the table has no time column")
            limit = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
            edge = self.spark.range(1).select(F.to_date(limit).cast("string").alias("d")).first()["d"]
            day = {p: p.rsplit("-", 1)[0] for p in snap["parts"]}
            gone, split = [p for p, d in day.items() if d == "none" or d < edge], [p for p, d in day.items() if d == edge]
            before = self._rows(snap).count()
            parts = {p: f for p, f in snap["parts"].items() if p not in gone}
            if split:
                parts = self._replaced(snap | {"parts": parts}, split, self._rows(snap, split).where(F.col(snap["time"]) >= limit))
            kept = self._rows(snap | {"parts": parts}).count()
            report = (kept, before - kept)
            return parts if kept < before else None

        self._change(step, None)
        return report

    def vacuum(self, keep: int = 2, age: float = 3600.0) -> int:
        """Remove all but the newest `keep` versions and the folders that none of those names, if older than `age` seconds (a change
        that is being written has folders that no version names yet); returns the number of folders removed."""
        versions = self.versions()
        stay = versions[-keep:]
        named = {f.split("/")[1] for v in stay for fs in self.snapshot(v)["parts"].values() for f in fs}
        for v in versions[:-keep]:
            self.files.remove(f"versions/{v:010d}.json")
        old = [n for n, seconds in self.files.listed("data") if n not in named and seconds >= age]
        for n in old:
            self.files.remove(f"data/{n}")
        return len(old)
