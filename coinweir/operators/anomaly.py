"""Scoring of a batch against each user's recent history.

A history is at most `HISTORY_ROWS` rows per user, so it travels as one array per user and every batch row
is scored by expressions over that array: one salted join, no row-by-row pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.operators.reports import top_n_per_user
from coinweir.plans.skew import attach
from coinweir.session import written_once

WEEK_US = 7 * 86_400_000_000


def history_exclude_batch(txns: DataFrame, batch: DataFrame, n: int = V.HISTORY_ROWS, exclude_first: bool = False) -> DataFrame:
    """Newest `n` rows per user without the batch's own rows.

    The limit comes first, so a large fresh batch can crowd out the history; `exclude_first` avoids that.
    """
    ids = batch.select("id")
    if exclude_first:
        return top_n_per_user(txns.join(ids, "id", "left_anti"), n)
    return top_n_per_user(txns, n).join(ids, "id", "left_anti")


def history_plus_target(history: DataFrame, target: DataFrame) -> DataFrame:
    return history.withColumn("is_target", F.lit(False)).unionByName(target.withColumn("is_target", F.lit(True)))


def profile_entry(created_at: Column, amount: Column, category: Column, transaction_type: Column) -> Column:
    """What a profile keeps of a row of the history."""
    return F.struct(
        F.unix_micros(created_at).alias("us"),
        amount.alias("amount"),
        F.coalesce(category, F.lit("")).alias("category"),
        (F.lower(transaction_type) == "expense").alias("spent"),
    )


def history_profile(history: DataFrame, n: int = V.HISTORY_ROWS) -> DataFrame:
    """One row per user: its newest `n` rows as a sorted array, so no array grows past `n`."""
    rows = history.withColumnsRenamed({"transaction_id": "id", "transaction_date": "created_at"})
    entry = profile_entry(*map(F.col, ("created_at", "amount", "category", "transaction_type")))
    return (
        top_n_per_user(rows, n)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("history"))
    )


def batch_against_history(batch: DataFrame, history: DataFrame, n: int = V.HISTORY_ROWS) -> DataFrame:
    """Batch rows with counts, mean and largest amount of the user's expense history in the row's category."""
    joined = attach(batch, history_profile(history, n), ["user_id"], F.col("transaction_id"))
    joined = joined.withColumn("history", F.coalesce("history", F.array().cast("array<struct<us:bigint,amount:double,category:string,spent:boolean>>")))
    spent = F.filter("history", lambda h: h["spent"])
    joined = joined.withColumn("_spent", spent)
    joined = joined.withColumn(
        "_same", F.transform(F.filter("_spent", lambda h: h["category"] == F.coalesce("category", F.lit(""))), lambda h: h["amount"])
    )
    total = F.aggregate("_same", F.lit(0.0), lambda acc, x: acc + x)
    size = F.size("_same")
    return (
        joined.withColumn("n_expense", F.size("_spent").cast("bigint"))
        .withColumn("n_category", size.cast("bigint"))
        .withColumn("category_mean", total / F.nullif(size, F.lit(0)))
        .withColumn("category_max", F.array_max("_same"))
        .withColumn("same_amount", F.exists("_same", lambda a: F.abs(F.col("amount") - a) < V.SAME_AMOUNT))
        .drop("_spent", "_same")
    )


def _near(reference: Column) -> Column:
    """Within the tolerance band of a positive reference amount."""
    gap = F.abs(F.col("amount") - reference) / F.nullif(reference, F.lit(0.0))
    return F.when(reference > 0, gap <= V.TOLERANCE).otherwise(False)


def safeguard_rule() -> Column:
    """First safeguard that applies, null when the model has to decide."""
    return (
        F.when(F.col("amount").isNull() | F.isnan("amount") | (F.abs("amount") == float("inf")), "unusable_row")
        .when(F.col("n_expense") < V.COLD_START_TOTAL, "cold_start_total")
        .when(F.col("n_category") < V.COLD_START_CATEGORY, "cold_start_category")
        .when(F.col("same_amount"), "same_amount")
        .when(_near(F.col("category_mean")) | _near(F.col("category_max")), "tolerance")
    )


def safeguard_status() -> Column:
    """The outcome of the safeguard that applies."""
    unknown = F.col("safeguard").isin("unusable_row", "cold_start_total", "cold_start_category")
    return F.when(unknown, "insufficient_history").when(F.col("safeguard").isNotNull(), "normal")


def anomaly_safeguards(batch: DataFrame, history: DataFrame, n: int = V.HISTORY_ROWS) -> DataFrame:
    """`safeguard` names the rule; `anomaly_status` is its outcome, null where the model decides."""
    checked = batch_against_history(batch, history, n).withColumn("safeguard", safeguard_rule())
    return checked.withColumn("anomaly_status", safeguard_status())


def group_safeguards(batch: DataFrame, profile: DataFrame) -> DataFrame:
    """The batch with `safeguard` and `anomaly_status` as `anomaly_safeguards` gives them, from profiles of its users.

    A history is looked through once for each user and category of the batch, not for each row; rows meet what they are
    compared with only, the amounts of their category.
    """
    keys = ["user_id", "_category"]
    rows = batch.withColumn("_category", F.coalesce("category", F.lit("")))
    groups = written_once(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")))
    spent = groups.join(profile, "user_id").select(*keys, F.filter("history", lambda h: h["spent"]).alias("_spent"))
    same = F.transform(F.filter("_spent", lambda h: h["category"] == F.col("_category")), lambda h: h["amount"])
    found = spent.select(*keys, F.size("_spent").cast("bigint").alias("n_expense"), same.alias("_same"))
    total = F.aggregate("_same", F.lit(0.0), lambda acc, x: acc + x)
    lookup = found.withColumns(
        {
            "n_category": F.size("_same").cast("bigint"),
            "category_mean": total / F.nullif(F.size("_same"), F.lit(0)),
            "category_max": F.array_max("_same"),
        }
    )
    none = F.lit(0).cast("bigint")
    return (
        attach(rows, lookup, keys, F.col("transaction_id"), counted=groups)
        .withColumns({name: F.coalesce(name, none) for name in ("n_expense", "n_category")})
        .withColumn("same_amount", F.exists("_same", lambda a: F.abs(F.col("amount") - a) < V.SAME_AMOUNT))
        .withColumn("safeguard", safeguard_rule())
        .withColumn("anomaly_status", safeguard_status())
        .select(*batch.columns, "safeguard", "anomaly_status")
    )


def features_against_history(rows: DataFrame) -> DataFrame:
    """Features of each row within its own history plus itself; needs the `history` array.

    The row itself is scored even when it is older than its history.
    """
    same = F.filter("history", lambda h: h["category"] == F.coalesce("category", F.lit("")))
    x = F.col("amount")
    amounts = F.col("_amounts")
    n = F.size("_amounts") + 1
    mean = (F.aggregate("_amounts", F.lit(0.0), lambda acc, a: acc + a) + x) / n
    squares = F.aggregate("_amounts", F.pow(x - F.col("_mean"), F.lit(2.0)), lambda acc, a: acc + F.pow(a - F.col("_mean"), F.lit(2.0)))
    flat = ~F.exists("_amounts", lambda a: a != x)
    lower = F.size(F.filter("_amounts", lambda a: a < x))
    equal = F.size(F.filter("_amounts", lambda a: a == x))
    us = F.unix_micros("transaction_date")
    week = F.size(F.filter("_same", lambda h: (h["us"] >= us - WEEK_US) & (h["us"] <= us)))
    day = F.weekday("transaction_date")
    return (
        rows.withColumn("_same", same)
        .withColumn("_amounts", F.transform("_same", lambda h: h["amount"]))
        .withColumn("_mean", mean)
        .withColumn("_std", F.sqrt(squares / F.nullif(n - 1, F.lit(0))))
        .withColumn("amount_zscore", F.when(flat, 0.0).otherwise(F.coalesce((x - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0)), F.lit(0.0))))
        .withColumn("category_percentile", (lower + (equal + 2) / F.lit(2.0)) / n)
        .withColumn("spending_freq_7d", (week + 1).cast("bigint"))
        .withColumn("log_amount", F.log1p(x))
        .withColumns(
            {
                "day_of_week": day,
                "day_of_month": F.dayofmonth("transaction_date"),
                "month": F.month("transaction_date"),
                "hour": F.hour("transaction_date"),
                "is_weekend": (day >= 5).cast("int"),
            }
        )
        .drop("_same", "_amounts", "_mean", "_std")
    )


def anomaly_reason(is_anomaly: Column | None = None) -> Column:
    """Sentence for a flagged row from its features, null for a normal one."""
    high = (F.col("amount_zscore") > 2.0) | (F.col("category_percentile") > 0.95)
    often = F.col("spending_freq_7d") > 5
    late = F.col("hour").between(1, 4)
    category, count = F.coalesce("category", F.lit("this category")), F.col("spending_freq_7d")
    sentence = (
        F.when(high & often & late, F.format_string(V.REASON_ALL, category, count))
        .when(often & late, F.format_string(V.REASON_FREQ_TIME, count, category))
        .when(high & late, F.format_string(V.REASON_HIGH_TIME, category))
        .when(high & often, F.format_string(V.REASON_HIGH_FREQ, category, count))
        .when(late, F.lit(V.REASON_TIME))
        .when(often, F.format_string(V.REASON_FREQ, count, category))
        .when(high, F.format_string(V.REASON_HIGH, category))
        .otherwise(F.lit(V.REASON_GENERIC))
    )
    return sentence if is_anomaly is None else F.when(is_anomaly, sentence)


def batch_summary(scores: DataFrame) -> DataFrame:
    """Size of a scored batch, its anomalies and the model version of its first row."""
    return scores.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("is_anomaly"), 1)).alias("anomaly_count"),
        F.min_by("model_version", F.col("transaction_id")).alias("model_version"),
    )
