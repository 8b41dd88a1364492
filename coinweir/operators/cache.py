"""The merchant classification cache and the category dimension: lookups, misses, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.plans.skew import attach, sorted_index
from coinweir.session import cut_lineage

KEY = ["user_id", "normalized_merchant", "transaction_type"]
PAYLOAD = ["category_name", "normalized_category", "confidence", "reason"]


def _usable(cache: DataFrame) -> DataFrame:
    """An empty merchant key never matches."""
    return cache.where(F.col("normalized_merchant") != "")


def cache_join(rows: DataFrame, cache: DataFrame, spread: Column) -> DataFrame:
    """Rows with their cache entry, nulls on a miss; a popular merchant of one user is salted."""
    entry = _usable(cache).select(*KEY, *PAYLOAD, F.lit(True).alias("cache_hit"))
    return attach(rows, entry, KEY, spread).withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def cache_join_alt_type(rows: DataFrame, cache: DataFrame, spread: Column) -> DataFrame:
    """As `cache_join`, but an entry of the other type serves when the row's own type has none."""
    entry = F.struct(F.col("transaction_type").alias("cached_type"), *PAYLOAD)
    both = (
        _usable(cache)
        .groupBy("user_id", "normalized_merchant")
        .agg(*[F.max(F.when(F.col("transaction_type") == kind, entry)).alias(f"_{kind}") for kind in V.TRANSACTION_TYPES])
    )
    is_expense = F.col("transaction_type") == "expense"
    found = F.when(is_expense, F.coalesce("_expense", "_income")).otherwise(F.coalesce("_income", "_expense"))
    return (
        attach(rows, both, ["user_id", "normalized_merchant"], spread)
        .withColumn("_found", found)
        .select("*", "_found.*")
        .drop("_expense", "_income", "_found")
    )


def distinct_keys(rows: DataFrame, order: str) -> DataFrame:
    """Distinct keys with the first place each appears at."""
    return rows.groupBy(*KEY).agg(F.min(order).alias("first_seen"))


def unknown(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key the cache does not have."""
    return rows.join(_usable(cache).select(*KEY), KEY, "left_anti")


def cache_misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    return unknown(rows.select(*KEY).distinct(), cache)


def cache_hits(rows: DataFrame, cache: DataFrame) -> DataFrame:
    return rows.select(*KEY).distinct().join(_usable(cache).select(*KEY), KEY, "left_semi")


def representative_rows(rows: DataFrame, cache: DataFrame, order: str) -> DataFrame:
    """The first row of every missed key: one classification call per key."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(order))
    ranked = rows.withColumn("_first", first).where(F.col("_first") == 1).drop("_first")
    return ranked.join(_usable(cache).select(*KEY), KEY, "left_anti")


def cache_stats(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows, distinct keys, hits and misses."""
    keys = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    marked = keys.join(_usable(cache).select(*KEY, F.lit(1).alias("hit")), KEY, "left")
    return marked.agg(
        F.sum("n").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.count("hit").alias("hits"),
        (F.count(F.lit(1)) - F.count("hit")).alias("misses"),
    )


def merge_results(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """One classification per key: the cache first, an answer of this run where the cache has none."""
    known = _usable(cache).select(*KEY, F.col("transaction_type").alias("answer_type"), *PAYLOAD)
    fresh = answers.select(*KEY, "answer_type", *PAYLOAD).join(known.select(*KEY), KEY, "left_anti")
    return known.unionByName(fresh)


def broadcast_results_back(rows: DataFrame, results: DataFrame, spread: Column, counted: DataFrame | None = None) -> DataFrame:
    """Every row, repeats included, gets its key's classification or the fallback; `counted` as in `attach`."""
    joined = attach(rows, results.select(*KEY, "answer_type", *PAYLOAD), KEY, spread, counted)
    return joined.withColumns(
        {
            "answer_type": F.coalesce("answer_type", "transaction_type"),
            **{name: F.coalesce(name, F.lit(value)) for name, value in V.IMPORT_FALLBACK.items()},
        }
    )


def cache_upsert(existing: DataFrame, answers: DataFrame, now: Column, order: str = "answer_no", min_confidence: float = 0.0) -> DataFrame:
    """The cache after an import: a new entry per key, replaced only by a strictly higher confidence.

    The key uses the answer's own type. Empty keys and answers at or below `min_confidence` are not stored.
    """
    fresh = answers.where((F.col("normalized_merchant") != "") & (F.col("confidence") > min_confidence)).select(
        "user_id",
        "normalized_merchant",
        F.coalesce("answer_type", "transaction_type").alias("transaction_type"),
        *PAYLOAD,
        F.lit("ai").alias("source"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(False).alias("_old"),
        F.col(order).cast("bigint").alias("_order"),
    )
    stored = existing.select(
        *KEY, *PAYLOAD, "source", "created_at", "updated_at", F.lit(True).alias("_old"), F.lit(0).cast("bigint").alias("_order")
    )
    rank = F.struct(F.col("confidence").alias("c"), F.col("_old").alias("o"), (-F.col("_order")).alias("n"))
    best = F.max_by(F.struct(*PAYLOAD, "source", "updated_at"), rank)  # combined on the map side, however hot a key is
    return (
        stored.unionByName(fresh)
        .groupBy(*KEY)
        .agg(best.alias("b"), F.min("created_at").alias("created_at"))
        .select(*KEY, "b.*", "created_at")
    )


def category_resolve(requests: DataFrame, categories: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(categories with the new ones appended, requests' keys with their category id and name).

    New ids continue after the largest one, in order of name and type; the first request names a category.
    """
    key = ["normalized_name", "transaction_type"]
    wanted = cut_lineage(requests.groupBy(*key).agg(F.min_by("name", order).alias("name")))  # one row per category, read twice
    new = sorted_index(wanted.join(categories.select(*key), key, "left_anti"), key, "_n")
    last = F.coalesce(categories.agg(F.max("id").alias("m")).scalar(), F.lit(0))
    added = new.select((last + F.col("_n") + 1).cast("bigint").alias("id"), "name", *key)
    everything = categories.select("id", "name", *key).unionByName(added)
    resolved = wanted.select(*key).join(
        everything.select(*key, F.col("id").alias("category_id"), F.col("name").alias("resolved_name")), key
    )
    return everything, resolved


def owner_check(rows: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose upload belongs to their user, the others)."""
    owned = uploads.select(F.col("id").alias("upload_id"), "user_id")
    return rows.join(owned, ["upload_id", "user_id"], "left_semi"), rows.join(owned, ["upload_id", "user_id"], "left_anti")


def import_counts(checked: DataFrame) -> DataFrame:
    """Per upload: rows sent, imported, failed and the final status; `error` is null for a good row."""
    return checked.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count(F.when(F.col("error").isNull(), 1)).alias("imported_transactions"),
        F.count("error").alias("failed_transactions"),
        F.lit("imported").alias("status"),
    )


def concat_users(frames: Sequence[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
