"""Keyed tables that change together.

A table is a list of segments, each a folder of sorted Parquet files by bucket.  Later
segments override earlier ones key by key, and may say that a key is gone; reading merges
them.  Which segments make up which tables is written in a manifest, one file a change,
numbered, written after all data and moved into place in one step.  Readers begin with the
latest manifest, so they see all tables before a change or all after it, never half of it.

Segments are merged as they add up: WIDTH neighbours of one level become one of the next, so a
table has fewer than WIDTH segments a level, and every row is rewritten once a level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 8
DIGITS = 12


class Conflict(Exception):
    """Another writer has published the manifest's number first."""


@dataclass(frozen=True)
class Table:
    """Columns, the key among them, the column by whose hash rows lie in buckets, and the order within a bucket, if it isn't the key's."""

    schema: str
    key: tuple[str, ...]
    by: str
    buckets: int = 16
    order: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c.split()[0].rstrip(":") for c in self.schema.split(", ")]


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


class Store:
    """The tables under ``path``, which all executors must reach."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests.

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """The latest manifest, or the one with a number."""
        numbers = self._numbers() if number is None else [number]
        if not numbers:
            return {"number": -1, "tables": {name: [] for name in self.tables}, "done": {}}
        stream = self._fs.open(self._at(f"manifests/{numbers[-1]:0{DIGITS}d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Write the manifest under a name of its own and move it to its number, if nobody has that number yet."""
        own, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{manifest['number']:0{DIGITS}d}")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(own), self._fs.makeQualified(final), none)
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(final):
                raise Conflict(manifest["number"]) from e
            raise

    def _change(self, change: Callable[[dict], dict | None], attempts: int = 20) -> int:
        """Publish what ``change`` makes of the latest manifest, anew if another writer was faster."""
        for _ in range(attempts):
            before = self.manifest()
            after = change(before)
            if after is None:
                return before["number"]
            try:
                self._publish(after | {"number": before["number"] + 1})
            except Conflict:
                continue
            return before["number"] + 1
        raise Conflict(f"no number was free in {attempts} attempts")

    # Writing.

    def _write(self, name: str, rows: DataFrame) -> str:
        """A segment's folder: a file for each bucket, sorted."""
        t = self.tables[name]
        folder = f"data/{name}/{uuid.uuid4().hex}"
        placed = rows.withColumn("_bucket", _bucket(F.col(t.by), t.buckets))
        placed.repartition(F.col("_bucket")).sortWithinPartitions("_bucket", *(t.order or t.key)).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, changes: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, stream: str | None = None, batch: int | None = None) -> int:
        """Rows to put in, and keys to take out, of any tables, all at once; returns the manifest's number.

        A row takes the place of the one with its key.  Rows of one table must differ in key.  With
        ``stream`` and ``batch``, a batch that was committed before changes nothing.
        """
        if stream is not None and self.manifest()["done"].get(stream, -1) >= batch:
            return self.manifest()["number"]
        folders = {}
        for name in [*changes, *(n for n in gone or {} if n not in changes)]:
            t = self.tables[name]
            rows = []
            if name in changes:
                rows.append(changes[name].select(*t.columns, F.lit(False).alias("_gone")))
            if gone and name in gone:
                empty = self.spark.createDataFrame([], t.schema)
                keys = gone[name].select(*t.key, *([t.by] if t.by not in t.key else [])).distinct()
                rows.append(empty.withColumn("_gone", F.lit(True)).unionByName(keys.withColumn("_gone", F.lit(True)), allowMissingColumns=True))
            folders[name] = self._write(name, rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]))

        def change(m: dict) -> dict | None:
            if stream is not None and m["done"].get(stream, -1) >= batch:
                return None
            tables = {n: m["tables"].get(n, []) + ([{"folder": folders[n], "level": 0}] if n in folders else []) for n in {*m["tables"], *self.tables}}
            return {"tables": tables, "done": m["done"] | ({stream: batch} if stream is not None else {})}

        number = self._change(change)
        for name in folders:
            self.compact(name)
        return number

    # Reading.

    def _merged(self, name: str, folders: Iterable[str], buckets: Column | None, where: Column | None, keep_gone: bool) -> DataFrame:
        t = self.tables[name]
        parts = []
        for place, folder in enumerate(folders):
            rows = self.spark.read.schema(f"{t.schema}, _gone boolean, _bucket int").parquet(f"{self.path}/{folder}")
            rows = rows if buckets is None else rows.filter(buckets)
            rows = rows if where is None else rows.filter(where)
            parts.append(rows.drop("_bucket").withColumn("_place", F.lit(place)))
        if not parts:
            return self.spark.createDataFrame([], f"{t.schema}, _gone boolean")
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        if len(parts) > 1:
            rest = [c for c in t.columns if c not in t.key] + ["_gone"]
            whole = whole.groupBy(*t.key).agg(F.max_by(F.struct(*rest), "_place").alias("_x")).select(*t.key, "_x.*")
        whole = whole.select(*t.columns, "_gone")
        return whole if keep_gone else whole.filter("not _gone")

    def read(self, name: str, of: Iterable | DataFrame | None = None, at: int | None = None) -> DataFrame:
        """A table's rows; of the latest manifest, or of the one numbered ``at``.

        ``of``: only rows whose bucketing column is among these values, or in the first column of
        this table; no bucket is read but theirs.
        """
        t = self.tables[name]
        folders = [s["folder"] for s in self.manifest(at)["tables"].get(name, [])]
        if of is None:
            return self._merged(name, folders, None, None, False).drop("_gone")
        if isinstance(of, DataFrame):
            keys = of.select(F.col(of.columns[0]).alias(t.by)).distinct()
            found = [r[0] for r in keys.select(_bucket(F.col(t.by), t.buckets).alias("b")).distinct().collect()]  # no more than there are buckets
            return self._merged(name, folders, F.col("_bucket").isin(found), None, False).drop("_gone").join(keys, t.by, "left_semi").select(*t.columns)
        values = list(of)
        own = F.lit(False)
        for v in values:
            own = own | (F.col("_bucket") == _bucket(F.lit(v), t.buckets))
        # The bucketing column of a key never changes, so it may be asked for before merging.
        return self._merged(name, folders, own, F.col(t.by).isin(values), False).drop("_gone")

    # Upkeep.

    def compact(self, name: str, width: int = WIDTH) -> bool:
        """Merge the last segments as long as ``width`` of one level stand together; whether any did."""
        done = False
        while True:
            segments = self.manifest()["tables"].get(name, [])
            level = segments[-1]["level"] if segments else 0
            run = next((i for i, s in enumerate(reversed(segments)) if s["level"] != level), len(segments))
            if run < width:
                return done
            old = segments[-run:]
            names = [s["folder"] for s in old]
            merged = self._merged(name, names, None, None, keep_gone=run < len(segments))
            new = {"folder": self._write(name, merged), "level": level + 1}

            def change(m: dict, names=names, new=new) -> dict | None:
                now = m["tables"][name]
                at = [s["folder"] for s in now]
                first = at.index(names[0]) if names[0] in at else None
                if first is None or at[first : first + len(names)] != names:
                    return None  # somebody else has merged them
                return m | {"tables": m["tables"] | {name: [*now[:first], new, *now[first + len(names) :]]}}

            self._change(change)
            done = True

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the last ``keep`` and all data that these don't name; how many folders went.  Not while others write."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"manifests/{n:0{DIGITS}d}"), False)
        named = {s["folder"] for n in numbers[-keep:] for segments in self.manifest(n)["tables"].values() for s in segments}
        went = 0
        for name in self.tables:
            for folder in self._names(f"data/{name}"):
                if f"data/{name}/{folder}" not in named:
                    self._fs.delete(self._at(f"data/{name}/{folder}"), True)
                    went += 1
        return went
