"""Structured Streaming jobs: import, de-duplication, sliding counts and burst sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coinweir import schemas
from coinweir.operators import summaries
from coinweir.plans import state
from coinweir.plans.imports import STORED, import_transactions
from coinweir.session import fresh_path

# For `run_available`: sessions of one key are merged before the shuffle, so a busy key sends few partial sessions.
MERGE_SESSIONS_FIRST = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str | None = None, settings: dict[str, str] | None = None) -> None:
    """Append everything available now to `out`; the checkpoint makes a restart continue where it stopped.

    A query keeps the settings that it is started with, so `settings` are put back at once.
    """
    spark = stream.sparkSession
    before = {key: spark.conf.get(key, None) for key in settings or {}}
    try:
        for key, value in (settings or {}).items():
            spark.conf.set(key, value)
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", checkpoint or f"{out}-checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()


def drain(stream: DataFrame, label: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what is available and read the result back."""
    spark = stream.sparkSession
    out = fresh_path(spark, label)
    run_available(stream, out, settings=settings)
    return spark.read.schema(stream.schema).parquet(out)


def stream_dedup(stream: DataFrame, keys: Sequence[str], ts: str = "created_at", delay: str = "1 day") -> DataFrame:
    """First row of each key and day; repeats are recognised while they arrive within `delay`.

    The day is part of the key: state outlives `delay` until a batch evicts it, and a later charge of the same
    key must not be taken for a repeat meanwhile.
    """
    dated = stream.withColumn("_day", F.to_date(ts)).withWatermark(ts, delay)
    return dated.dropDuplicatesWithinWatermark([*keys, "_day"]).drop("_day")


def stream_freq_windows(
    stream: DataFrame, keys: Sequence[str], ts: str = "created_at", delay: str = "1 day", width: str = "7 days", slide: str = "1 day"
) -> DataFrame:
    """Closed sliding windows with their row count per key.

    Rows are counted once, in panes as long as the slide; a second stateful count adds up the panes of each window,
    so only counts are copied into the windows they belong to. `width` is a multiple of `slide`.
    """
    panes = stream.withWatermark(ts, delay).groupBy(F.window(ts, slide).alias("pane"), *keys).agg(F.count(F.lit(1)).alias("n"))
    windows = panes.groupBy(F.window(F.window_time("pane"), width, slide).alias("window"), *keys).agg(F.sum("n").alias("n_rows"))
    return windows.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_rows")


def stream_burst_sessions(
    stream: DataFrame, keys: Sequence[str], ts: str = "created_at", delay: str = "1 day", gap: str = "1 hour", min_rows: int = 5
) -> DataFrame:
    """Closed sessions of a key with at least `min_rows` rows; best run with MERGE_SESSIONS_FIRST."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap), *keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("total"))
        .where(F.col("n_rows") >= min_rows)
        .select(
            *keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_rows", "total"
        )
    )


PROGRESS = "last_id bigint, newest timestamp"


class ImportStream:
    """Each micro-batch of import rows runs the import job against the state that the earlier ones left.

    State lives under `root`. Each user's newest rows and the merchant cache are kept in hash buckets of the user, in
    versions (`state.BucketedTable`): a batch reads and writes the buckets of its own users, so its cost does not grow
    with the number of batches. The largest id and the newest time so far are one row, the categories one small table.
    Everything else is one folder per batch, written by overwrite: a batch that is run again after a failure replaces
    its own output and never sees it as history.

    Rows older than the newest time of the batches before by more than `late_after` are late: they are imported like
    others and also kept in the table `late`.
    """

    TABLES = ("transactions", "uploads", "quarantine", "rejected")

    def __init__(
        self,
        root: str,
        uploads: DataFrame,
        cache: DataFrame,
        answers: DataFrame,
        categories: DataFrame,
        stored: DataFrame,
        now: Column,
        to_rows: Callable[[DataFrame], DataFrame] = lambda batch: batch,
        late_after: str = "1 day",
        scorer=None,
        buckets: int = state.BUCKETS,
    ) -> None:
        self.root, self.uploads, self.answers, self.now = root, uploads, answers, now
        self.first = {"cache": cache, "categories": categories, "transactions": stored.select(*STORED)}
        self.to_rows, self.late_after, self.scorer = to_rows, late_after, scorer
        self.recent = state.BucketedTable(f"{root}/recent", summaries.recent_arrays(self.first["transactions"]).schema, buckets=buckets)
        self.cache = state.BucketedTable(f"{root}/cache", schemas.MERCHANT_CACHE, buckets=buckets)

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch={batch_id}"

    def _last(self, spark: SparkSession, table: str, before: int) -> DataFrame:
        """A table that is written whole, as the batch before left it."""
        earlier = [n for n in state.numbers_under(spark, f"{self.root}/{table}") if n < before]
        return spark.read.parquet(self._path(table, earlier[-1]))

    def begin(self, spark: SparkSession) -> None:
        """Write the state before the first batch, unless it is there. The stored rows are read here and never again."""
        if state.numbers_under(spark, f"{self.root}/progress"):
            return
        stored = self.first["transactions"]
        self.recent.write(summaries.recent_arrays(stored), state.START)
        self.cache.write(self.first["cache"], state.START)
        self.first["categories"].write.mode("overwrite").parquet(self._path("categories", state.START))
        progress = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"), F.lit(None).cast("timestamp").alias("newest"))
        progress.write.mode("overwrite").parquet(self._path("progress", state.START))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.begin(spark)
        rows = self.to_rows(batch)
        touched = self.recent.touched(rows)
        progress = self._last(spark, "progress", batch_id).first()
        recent = self.recent.read(spark, batch_id, touched)
        result = import_transactions(
            rows, self.uploads, self.cache.read(spark, batch_id, touched), self.answers, self._last(spark, "categories", batch_id),
            summaries.recent_rows(recent).select(*STORED), self.now, scorer=self.scorer, last_id=progress.last_id, recent=recent,
        )
        for table in self.TABLES:
            result[table].write.mode("overwrite").parquet(self._path(table, batch_id))
        written = spark.read.schema(result["transactions"].schema).parquet(self._path("transactions", batch_id))
        bound = F.lit(progress.newest).cast("timestamp") - F.expr(f"INTERVAL {self.late_after}")
        written.where(F.col("created_at") < bound).write.mode("overwrite").parquet(self._path("late", batch_id))
        self.recent.write(summaries.merge_recent(recent, result["newest"]), batch_id, touched)
        self.cache.write(result["cache"], batch_id, touched)
        result["categories"].write.mode("overwrite").parquet(self._path("categories", batch_id))
        newest = F.greatest(F.max("created_at"), F.lit(progress.newest).cast("timestamp")).alias("newest")
        done = written.agg(F.coalesce(F.max("id"), F.lit(progress.last_id)).cast("bigint").alias("last_id"), newest)
        done.write.mode("overwrite").parquet(self._path("progress", batch_id))
        for table in (self.recent, self.cache):
            table.forget(spark, batch_id)
        for name in ("categories", "progress"):
            state.forget_folders(spark, f"{self.root}/{name}", batch_id)

    def run(self, stream: DataFrame) -> None:
        self.begin(stream.sparkSession)
        query = (
            stream.writeStream.foreachBatch(self)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The cache, the newest rows or the categories as they are now; of other tables the rows of all batches."""
        if table in ("cache", "recent"):
            return getattr(self, table).read(spark, 1 << 62)
        return self._last(spark, table, 1 << 62) if table == "categories" else spark.read.parquet(f"{self.root}/{table}")
