"""A folder of tables that change together: a version file names the data files of every table.

Data files are written first, under names of their own, and never changed. The version file is
written last, in one rename, and read first. So a run that fails anywhere leaves the last version of
all tables whole, readers see either the old tables or the new ones, and a table that a run does
not touch, or a bucket of a keyed table, keeps its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.operators.merging import last_writes, upsert

BUCKETS = 64
_BUCKET = "__bucket"


class Store:
    """Tables under one folder that every executor reaches.

    A version is {table: {"parts": {bucket: path}, "keys": [...], "buckets": n, "schema": json}};
    a table without keys has the one part "".
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self._fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions ----

    def _numbers(self) -> list[int]:
        root = self._path("_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """The tables of the newest version, or of the one numbered."""
        numbers = self._numbers()
        if not numbers:
            return {}
        path = f"{self.folder}/_versions/{numbers[-1] if number is None else number}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _commit(self, changed: Mapping[str, dict]) -> int:
        """Make the next version; of two writers at once the second fails and leaves the first's."""
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 1
        text = json.dumps({**self.version(), **changed}, ensure_ascii=False)
        draft = self._path(f"_versions/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._path(f"_versions/{number}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"{self.folder}: version {number} was written by another run")
        return number

    # ---- reading ----

    def _read(self, table: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        parts = table["parts"]
        paths = [f"{self.folder}/{p}" for b, p in sorted(parts.items()) if buckets is None or b in buckets]
        known = StructType.fromJson(json.loads(table["schema"]))
        if not paths:
            return self.spark.createDataFrame([], known)
        # Columns that name folders come last when read.
        stored = self.spark.read.schema(known).parquet(*paths)
        return stored.select(*[F.col(f"`{c}`") for c in known.names])

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        """A table of the newest version, or None if it has not been published."""
        table = self.version(number).get(name)
        return None if table is None else self._read(table)

    def files(self, name: str) -> dict[str, str]:
        """Where each part of a table lies."""
        return dict(self.version().get(name, {}).get("parts", {}))

    # ---- writing ----

    def _stage(
        self, name: str, df: DataFrame, keys: Sequence[str], buckets: int,
        partition_by: Sequence[str] = (),
    ) -> dict:
        """Write the rows under a new name; nothing sees them before a commit."""
        place = f"{name}/{uuid.uuid4().hex}"
        table = {"keys": list(keys), "buckets": buckets if keys else 0, "schema": df.schema.json()}
        if not keys:
            df.write.partitionBy(*partition_by).parquet(f"{self.folder}/{place}")
            return {**table, "parts": {"": place}}
        bucketed = df.withColumn(_BUCKET, _bucket_of(keys, buckets))
        # AQE cuts large buckets over several tasks and puts small ones together.
        bucketed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{place}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(place))]
        parts = {n.split("=")[1]: f"{place}/{n}" for n in made if n.startswith(f"{_BUCKET}=")}
        return {**table, "parts": parts}

    def publish(
        self, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None,
        buckets: int = BUCKETS, partition_by: Mapping[str, Sequence[str]] | None = None,
    ) -> int:
        """Replace all given tables in one step; plans may read their old versions.

        Tables with keys are stored in buckets of their keys, for upserts.
        """
        staged = {n: self._stage(n, df, (keys or {}).get(n, ()), buckets, (partition_by or {}).get(n, ()))
                  for n, df in tables.items()}
        return self._commit(staged)

    def upsert(
        self, name: str, updates: DataFrame, sequence: str | None = None, insert: bool = True
    ) -> int:
        """Insert or update rows of a keyed table by the last write of each key.

        Only the buckets that the updates' keys fall into are read and written.
        """
        table = self.version()[name]
        keys, buckets = table["keys"], table["buckets"]
        last = last_writes(updates, keys, sequence)
        touched = [str(r[0]) for r in last.select(_bucket_of(keys, buckets)).distinct().collect()]
        merged = upsert(self._read(table, touched), last, keys, insert=insert)
        staged = self._stage(name, merged, keys, buckets)
        kept = {b: p for b, p in table["parts"].items() if b not in touched}
        return self._commit({name: {**staged, "parts": {**kept, **staged["parts"]}}})

    def vacuum(self, versions: int = 2) -> None:
        """Delete all but the newest versions, and the data that these do not name.

        Data being written by a run that has not committed goes as well, so none may be at work.
        """
        numbers = self._numbers()
        named = [t for n in numbers[-versions:] for t in self.version(n).values()]
        kept = {p.split("/")[1] for t in named for p in t["parts"].values()}
        for n in numbers[:-versions]:
            self._fs.delete(self._path(f"_versions/{n}.json"), False)
        for status in self._fs.listStatus(self._path(".")):
            name = status.getPath().getName()
            if name == "_versions":
                continue
            for place in self._fs.listStatus(status.getPath()):
                if place.getPath().getName() not in kept:
                    self._fs.delete(place.getPath(), True)


def refresh_tables(tables: Mapping[str, DataFrame], folder: str) -> int:
    """Full refresh: all given tables are replaced in one step, edge tables included."""
    return Store(next(iter(tables.values())).sparkSession, folder).publish(tables)


def _bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
