"""Lists, dashboards and insights over stored transactions, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.functions.text import format_money
from coinweir.plans.skew import DAY_US, running_index, time_cell

NEWEST_FIRST = ("created_at", "id")


def newest_first() -> list[Column]:
    return [F.desc(name) for name in NEWEST_FIRST]


def list_transactions(txns: DataFrame, user_id: str | None = None) -> DataFrame:
    """Newest first; of one user, or of every user in turn. A range-partitioned sort, so no user fills a task."""
    if user_id is not None:
        return txns.where(F.col("user_id") == user_id).orderBy(*newest_first())
    return txns.orderBy("user_id", *newest_first())


def transaction_by_id(txns: DataFrame, transaction_id: int, user_id: str) -> DataFrame:
    return txns.where((F.col("id") == transaction_id) & (F.col("user_id") == user_id)).limit(1)


def transactions_by_id(txns: DataFrame, requests: DataFrame) -> DataFrame:
    """Transactions asked for by (id, user_id); another user's transaction is not found."""
    return txns.join(requests.select("id", "user_id"), ["id", "user_id"], "left_semi")


def search_transactions(txns: DataFrame, query: str = "", kind: str = "All") -> DataFrame:
    """Case-insensitive literal match on merchant or category, and a type filter (All, Expenses, Income)."""
    wanted = F.lit(True)
    if query.strip():
        needle = F.lit(query.lower())
        wanted = F.contains(F.lower("merchant"), needle) | F.contains(F.lower("category_name"), needle)
    types = {"Expenses": "expense", "Income": "income"}
    if kind in types:
        wanted = wanted & (F.col("transaction_type") == types[kind])
    return txns.where(wanted)


def _flagged(txns: DataFrame) -> DataFrame:
    status = F.col("anomaly_status")
    return txns.where(F.col("is_anomaly") & ((status == "confirmed_anomaly") | status.isNull()))


def flagged_transactions(txns: DataFrame) -> DataFrame:
    return _flagged(txns).orderBy("user_id", *newest_first())


def severity(score: str | Column) -> Column:
    value = F.col(score) if isinstance(score, str) else score
    return F.when(value.isNull() | (value < 0.5), "low").when(value < 0.8, "medium").otherwise("high")


def insight_type(name: str | Column) -> Column:
    value = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.when(value == "tip", "SUGGESTION").when(value == "pattern", "PATTERN").otherwise("UNUSUAL")


def _insight_columns() -> list[str | Column]:
    money = format_money("amount")
    fallback = F.concat(F.lit("Your "), money, F.lit(" "), F.col("merchant"), F.lit(" transaction was flagged as unusual."))
    return [
        "user_id",
        F.lit("unusual").alias("type"),
        F.concat(F.lit("Unusual "), F.col("category_name"), F.lit(" transaction")).alias("title"),
        F.coalesce(F.nullif(F.col("anomaly_reason"), F.lit("")), fallback).alias("description"),
        money.alias("value"),
        F.col("id").alias("transaction_id"),
        severity("anomaly_score").alias("severity"),
        "created_at",
    ]


def insight_projection(flagged: DataFrame) -> DataFrame:
    return flagged.select(*_insight_columns())


def insight_ids(flagged: DataFrame) -> DataFrame:
    """`insight_id` counts a user's flagged transactions from 1, newest first."""
    return running_index(
        flagged, ["user_id"], time_cell("created_at", DAY_US), newest_first(), "insight_id", descending_cells=True
    )


def insights(txns: DataFrame) -> DataFrame:
    return insight_ids(_flagged(txns)).select(F.col("insight_id").alias("id"), *_insight_columns())


def insight_summary(txns: DataFrame) -> DataFrame:
    return (
        _flagged(txns)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total_insights"))
        .select(
            "user_id",
            "total_insights",
            F.col("total_insights").alias("unusual_count"),
            F.lit(0).cast("bigint").alias("tips_count"),
            F.lit(0).cast("bigint").alias("pattern_count"),
        )
    )


def _total(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("transaction_type") == kind, F.col("amount"))), F.lit(0.0))


def dashboard_totals(txns: DataFrame) -> DataFrame:
    return txns.groupBy("user_id").agg(
        F.round(_total("expense"), 2).alias("total_expense"), F.round(_total("income"), 2).alias("total_income")
    )


def net_balance(txns: DataFrame) -> DataFrame:
    return dashboard_totals(txns).select(
        "user_id", F.round(F.col("total_income") - F.col("total_expense"), 2).alias("balance")
    )


def category_breakdown(txns: DataFrame) -> DataFrame:
    """Expense per user and category; the share is of the unrounded total, the name that of the newest row."""
    # By name first: sums and a latest time fit a hash aggregation, a name carried along would mean sorting every row.
    per_name = (
        txns.where(F.col("transaction_type") == "expense")
        .groupBy("user_id", "category_id", "category_name")
        .agg(F.sum("amount").alias("_amount"), F.max("created_at").alias("_last"))
    )
    per_category = per_name.groupBy("user_id", "category_id").agg(
        F.sum("_amount").alias("_amount"),
        F.max_by("category_name", F.struct("_last", "category_name")).alias("category_name"),
    )
    # One row per category from here on: the windows never see raw transactions.
    total = F.sum("_amount").over(Window.partitionBy("user_id"))
    share = F.when(total > 0, F.round(F.col("_amount") / F.nullif(total, F.lit(0.0)) * 100, 2)).otherwise(0.0)
    position = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("_amount"), "category_id"))
    return per_category.select(
        "user_id",
        "category_id",
        "category_name",
        F.round("_amount", 2).alias("amount"),
        share.alias("percentage"),
        position.cast("bigint").alias("position"),
    )


def top_category(txns: DataFrame) -> DataFrame:
    """Name of the largest category of every user, '' for a user without expenses."""
    best = category_breakdown(txns).groupBy("user_id").agg(
        F.max_by("category_name", F.struct(F.abs("amount"), -F.col("position"))).alias("_top")
    )
    users = txns.select("user_id").distinct()
    return users.join(best, "user_id", "left").select("user_id", F.coalesce("_top", F.lit("")).alias("top_category"))


def top_n_per_user(txns: DataFrame, n: int) -> DataFrame:
    """Newest `n` rows of every user. The limit is applied before the shuffle too (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*newest_first()))
    return txns.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def recent_transactions(txns: DataFrame) -> DataFrame:
    return top_n_per_user(txns, V.RECENT_ROWS)


def recent_history(txns: DataFrame) -> DataFrame:
    return top_n_per_user(txns, V.HISTORY_ROWS)


def dashboard(txns: DataFrame) -> dict[str, DataFrame]:
    return {
        "totals": dashboard_totals(txns),
        "breakdown": category_breakdown(txns),
        "recent": recent_transactions(txns),
    }


def number_by_time(txns: DataFrame, name: str = "seq") -> DataFrame:
    """Position of each row of a user in (time, id) order."""
    return running_index(txns, ["user_id"], time_cell("created_at", DAY_US), [F.asc("created_at"), F.asc("id")], name)


def preview_totals(rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """Expense and income of signed preview rows."""
    amount = F.col("amount")
    return rows.groupBy(key).agg(
        F.round(F.coalesce(F.sum(F.when(amount < 0, -amount)), F.lit(0.0)), 2).alias("expense"),
        F.round(F.coalesce(F.sum(F.when(amount >= 0, amount)), F.lit(0.0)), 2).alias("income"),
    )


def expense_income_counts(rows: DataFrame, key: str = "statement_id") -> DataFrame:
    return rows.groupBy(key).agg(
        F.count(F.when(F.col("amount") < 0, 1)).alias("expense_count"),
        F.count(F.when(F.col("amount") >= 0, 1)).alias("income_count"),
    )


def ml_input(txns: DataFrame) -> DataFrame:
    return txns.select(
        F.col("id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.coalesce("created_at", F.current_timestamp()).alias("transaction_date"),
        "merchant",
        "amount",
        F.col("category_name").alias("category"),
        "transaction_type",
        F.nullif(F.col("notes"), F.lit("")).alias("notes"),
    )


def ml_output(scores: DataFrame) -> DataFrame:
    return scores.select(
        "transaction_id",
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        "anomaly_status",
        F.col("confidence").alias("anomaly_score"),
        F.col("reason").alias("anomaly_reason"),
        F.col("model_version").alias("ml_model_version"),
    )


# ---- labelled sets -----------------------------------------------------------------------------------------


def dataset_profile(labelled: DataFrame) -> DataFrame:
    rows, anomalies = F.count(F.lit(1)), F.sum(F.col("is_anomaly").cast("bigint"))
    users = F.count_distinct("user_id")
    return labelled.agg(
        rows.alias("n_rows"),
        users.alias("n_users"),
        anomalies.alias("n_anomalies"),
        (rows - anomalies).alias("n_normal"),
        F.round(anomalies / F.nullif(rows, F.lit(0)) * 100, 1).alias("anomaly_percent"),
        F.floor(rows / F.nullif(users, F.lit(0))).cast("bigint").alias("rows_per_user"),
    )


def anomaly_label_counts(labelled: DataFrame, labels: list[str] = V.ANOMALY_LABELS) -> DataFrame:
    """Anomalous rows whose notes contain each label. One pass, one counter per label."""
    notes = F.lower(F.coalesce("notes", F.lit("")))
    counters = [
        F.count(F.when(F.contains(notes, F.lit(label.lower())), 1)).alias(f"c{i}") for i, label in enumerate(labels)
    ]
    counted = labelled.where(F.col("is_anomaly") == 1).agg(*counters)
    pairs = [F.struct(F.lit(label).alias("label"), F.col(f"c{i}").alias("n_rows")) for i, label in enumerate(labels)]
    return counted.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.label", "pair.n_rows")


def user_anomaly_rate(labelled: DataFrame, n: int = 10) -> DataFrame:
    total, anomalies = F.count("is_anomaly"), F.sum(F.col("is_anomaly").cast("bigint"))
    return (
        labelled.groupBy("user_id")
        .agg(
            total.alias("total"),
            anomalies.alias("anomalies"),
            F.round(anomalies / F.nullif(total, F.lit(0)) * 100, 1).alias("percent"),
        )
        .orderBy("user_id")
        .limit(n)
    )


def confusion_matrix(scored: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    def cell(actual: int, guess: int, name: str) -> Column:
        return F.count(F.when((F.col(truth) == actual) & (F.col(predicted) == guess), 1)).alias(name)

    return scored.agg(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def binary_metrics(scored: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Accuracy, precision, recall, F1, F2; an empty denominator counts as 0."""
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    rates = confusion_matrix(scored, truth, predicted).select(
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    )
    precision, recall = F.col("precision"), F.col("recall")
    return rates.select(
        "accuracy",
        "precision",
        "recall",
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        _ratio(5 * precision * recall, 4 * precision + recall).alias("f2"),
    )


def class_report(scored: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    cells = confusion_matrix(scored, truth, predicted)
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))

    def entry(label: int, hit: Column, false_alarm: Column, missed: Column) -> Column:
        precision, recall = _ratio(hit, hit + false_alarm), _ratio(hit, hit + missed)
        return F.struct(
            F.lit(label).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            _ratio(2 * precision * recall, precision + recall).alias("f1"),
            (hit + missed).alias("support"),
        )

    return cells.select(F.explode(F.array(entry(0, tn, fn, fp), entry(1, tp, fp, fn))).alias("c")).select("c.*")


