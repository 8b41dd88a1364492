"""State that a batch changes for a few users only: tables in hash buckets of the user, each bucket in versions.

A batch reads the buckets of its own users and writes these buckets anew, under its own number. Which version of a
bucket counts is a list of one number for each bucket. A batch that runs again replaces what it wrote and reads what
the batches before it left, so repeats change nothing; and a batch costs what its users' state costs, however many
batches came before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256
START = -1  # number of the state before the first batch


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def numbers_under(spark: SparkSession, path: str, name: str = "batch") -> list[int]:
    """The numbers n of the finished folders `name`=n under `path`, in order."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    found = [entry.getPath().getName() for entry in files.listStatus(place)]
    numbers = sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}="))
    return [n for n in numbers if exists(spark, f"{path}/{name}={n}/_SUCCESS")]


def forget_folders(spark: SparkSession, path: str, batch: int) -> None:
    """Delete what is older than the version before `batch` of a table that every batch writes whole."""
    files, _ = _files(spark, path)
    earlier = [n for n in numbers_under(spark, path) if n < batch]
    for number in earlier[:-1]:
        files.delete(_files(spark, f"{path}/batch={number}")[1], True)


class BucketedTable:
    """One table of state under `root`; `key` decides the bucket of a row."""

    def __init__(self, root: str, schema: StructType, key: str = "user_id", buckets: int = BUCKETS) -> None:
        self.root, self.schema, self.key, self.buckets = root, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys in `rows`: at most as many numbers as there are buckets."""
        return sorted(r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def versions(self, spark: SparkSession, before: int) -> dict[int, int]:
        """The batch that wrote each bucket last, of the batches before this one."""
        earlier = [n for n in numbers_under(spark, f"{self.root}/versions") if n < before]
        if not earlier:
            return {}
        rows = spark.read.schema("bucket int, version int").parquet(f"{self.root}/versions/batch={earlier[-1]}").collect()
        return {r.bucket: r.version for r in rows}  # one row for each bucket

    def read(self, spark: SparkSession, before: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """The state before a batch, of all buckets or of some; no other bucket's files are opened."""
        versions = self.versions(spark, before)
        paths = [f"{self.root}/data/batch={v}/bucket={b}" for b, v in versions.items() if buckets is None or b in set(buckets)]
        paths = [path for path in paths if exists(spark, path)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, batch: int, touched: Sequence[int] | None = None) -> None:
        """The new state of the touched buckets (of all at the start). Other buckets keep their version."""
        spark = rows.sparkSession
        placed = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/batch={batch}")
        kept = self.versions(spark, batch)
        kept |= {b: batch for b in (range(self.buckets) if touched is None else touched)}
        listed = spark.createDataFrame(sorted(kept.items()), "bucket int, version int").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.root}/versions/batch={batch}")

    def forget(self, spark: SparkSession, batch: int) -> None:
        """Delete versions of buckets, and lists, that neither the state after `batch` nor the one before it refers to."""
        files, _ = _files(spark, self.root)
        needed = {(v, b) for n in (batch, batch + 1) for b, v in self.versions(spark, n).items()}
        for version in numbers_under(spark, f"{self.root}/data"):
            folder = _files(spark, f"{self.root}/data/batch={version}")[1]
            listed = [p for p in (entry.getPath() for entry in files.listStatus(folder)) if p.getName().startswith("bucket=")]
            stale = [p for p in listed if version <= batch and (version, int(p.getName()[7:])) not in needed]
            for path in [folder] if len(stale) == len(listed) and version < batch else stale:
                files.delete(path, True)
        forget_folders(spark, f"{self.root}/versions", batch)
