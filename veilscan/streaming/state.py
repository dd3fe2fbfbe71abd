"""Keyed state of a stream as a log of Parquet files.

A state table is one base, folded by key, and the deltas of the batches since.
Every batch commits a small pointer file that names the folders which make up
the state after it; a batch reads the newest pointer before its own, so a replay
sees what the first run saw. Once ``fold_every`` deltas have piled up, the batch
that adds the next one folds them into a new base. A read therefore opens at most
``fold_every`` + 1 folders of at most ``buckets`` files each, however many batches
have run, and folders that neither this pointer nor the one before names are
deleted. Rows are bucketed by the hash of their key, so a batch reads only the
buckets of its own keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, FOLD_EVERY = 16, 8


class Pointers:
    """Pointer files ``<number>.json`` of a folder; the newest two are kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def newest(self, before: int | None = None) -> dict | None:
        found = [n for n in self.numbers() if before is None or n < before]
        return self.load(found[-1]) if found else None

    def load(self, number: int) -> dict:
        text = "".join(r[0] for r in self.spark.read.text(f"{self.folder}/{number:012d}.json", wholetext=True).collect())
        return json.loads(text)

    def save(self, number: int, content: dict) -> None:
        """Written aside and renamed, so a reader sees a whole pointer or none."""
        made, final = self.path(f"{self.folder}/_{number:012d}"), self.path(f"{self.folder}/{number:012d}.json")
        out = self.fs.create(made, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self.fs.delete(final, False)
        if not self.fs.rename(made, final):
            raise OSError(f"could not commit {final}")

    def prune(self, upto: int) -> None:
        """Delete the pointers before the newest two up to ``upto``."""
        for number in [n for n in self.numbers() if n <= upto][:-2]:
            self.fs.delete(self.path(f"{self.folder}/{number:012d}.json"), False)


class StateTable:
    """State of one stream: columns ``schema`` (keys included), one row for each key after ``merge``.

    ``merge`` folds rows of several batches (they carry ``batch_id``) to one row
    a key, and must give the same for rows it has folded before.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, fold_every: int = FOLD_EVERY):
        self.spark, self.root, self.schema, self.keys, self.merge = spark, root.rstrip("/"), schema, list(keys), merge
        self.buckets, self.fold_every = buckets, fold_every
        self.pointers = Pointers(spark, f"{self.root}/commits")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def rows(self, folders: Sequence[str]) -> DataFrame:
        kind = f"{self.schema}, batch_id BIGINT, bucket INT"
        if not folders:
            return self.spark.createDataFrame([], kind)
        found = self.spark.read.schema(f"{kind}, log STRING").option("basePath", f"{self.root}/data")
        return found.parquet(*[f"{self.root}/{f}" for f in folders]).drop("log")

    def read(self, before: int, keys: DataFrame | None = None) -> DataFrame:
        """The state that batch ``before`` starts from; with ``keys`` only their rows (and buckets)."""
        found = self.pointers.newest(before)
        rows = self.rows(found["folders"] if found else [])
        if keys is not None and found:
            own = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(own)) if own else rows.limit(0)
            rows = rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        return self.merge(rows.drop("bucket"))

    def meta(self, before: int) -> dict:
        found = self.pointers.newest(before)
        return found["meta"] if found else {}

    def write(self, batch_id: int, delta: DataFrame, meta: dict | None = None, replace: bool = False) -> None:
        """Commit the state after ``batch_id``: what was before plus ``delta`` (or, with ``replace``, ``delta`` alone)."""
        before = self.pointers.newest(batch_id)
        folders = [] if replace or not before else list(before["folders"])
        columns = [c.split()[0] for c in self.schema.split(", ")]
        added = delta.select(*columns).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        self._put(f"delta-{batch_id:012d}", added, folders)
        if len(folders) > self.fold_every + 1:
            whole = self.merge(self.rows(folders).drop("bucket"))
            folders = []
            self._put(f"base-{batch_id:012d}", whole, folders)
        self.pointers.save(batch_id, {"folders": folders, "meta": meta or {}})
        self.pointers.prune(batch_id)
        self._sweep({*folders, *(before["folders"] if before else [])}, batch_id)

    def _put(self, name: str, rows: DataFrame, folders: list[str]) -> None:
        path = f"{self.root}/data/log={name}"
        rows.withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        if any(s.isDirectory() for s in self.pointers.fs.listStatus(self.pointers.path(path))):  # else it has no row
            folders.append(f"data/log={name}")

    def _sweep(self, named: set[str], batch_id: int) -> None:
        for s in self.pointers.fs.listStatus(self.pointers.path(f"{self.root}/data")):
            name = s.getPath().getName()
            if f"data/{name}" not in named and int(name.rsplit("-", 1)[1]) <= batch_id:
                self.pointers.fs.delete(s.getPath(), True)


def newest_row(keys: Sequence[str], columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: of each key the row of its last batch."""
    rest = [c for c in columns if c not in keys]

    def merge(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "batch_id"), "batch_id").alias("_r"))
        return last.select(*keys, *[f"_r.{c}" for c in rest], "_r.batch_id")
    return merge


def distinct_keys(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: each key once, with the batch that saw it first."""
    return lambda rows: rows.groupBy(*keys).agg(F.min("batch_id").alias("batch_id"))
