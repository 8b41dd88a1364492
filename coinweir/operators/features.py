"""Behavioural features per (user, category).

Nothing here windows over a whole (user, category) group. Spread and rank come from pre-aggregated amounts,
and the 7-day count from hourly cells, so a group holding a third of all rows is still many small tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweir.plans.skew import HOUR_US, attach, time_cell

GROUP = ["user_id", "category"]
WEEK_HOURS = 7 * 24
WEEK_US = WEEK_HOURS * HOUR_US


def date_features(df: DataFrame, ts: str = "transaction_date") -> DataFrame:
    day = F.weekday(ts)
    return df.withColumns(
        {
            "day_of_week": day,
            "day_of_month": F.dayofmonth(ts),
            "month": F.month(ts),
            "hour": F.hour(ts),
            "is_weekend": (day >= 5).cast("int"),
        }
    )


def log_amount(amount: str | Column = "amount") -> Column:
    return F.log1p(amount)


def user_category_stats(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Count, mean, sample deviation, least and largest amount of every group."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("amount").alias("mean_amount"),
        F.stddev_samp("amount").alias("std_amount"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )


def _zscore() -> Column:
    """0 for a single row or a group of equal amounts, whatever its rounding noise."""
    spread = F.when(F.col("min_amount") < F.col("max_amount"), F.nullif(F.col("std_amount"), F.lit(0.0)))
    return F.coalesce((F.col("amount") - F.col("mean_amount")) / spread, F.lit(0.0))


def amount_zscore(df: DataFrame, row_id: str = "transaction_id") -> DataFrame:
    stats = user_category_stats(df)
    joined = attach(df, stats, GROUP, F.col(row_id), counted=stats)
    return joined.withColumn("amount_zscore", _zscore()).drop(
        "n_rows", "mean_amount", "std_amount", "min_amount", "max_amount"
    )


def _amount_cell(amount: Column) -> Column:
    """A coarse number that orders like the amount: power of ten and three leading digits, with its sign.

    The power of ten weighs more than any digits, so a rounding slip at a power of ten cannot swap two cells.
    """
    size = F.abs(amount)
    power = F.floor(F.log10(F.nullif(size, F.lit(0.0))))
    digits = F.floor(size / F.pow(F.lit(10.0), power - 2))
    return F.coalesce((F.signum(amount) * ((power + 400) * 100_000 + digits)).cast("bigint"), F.lit(0).cast("bigint"))


def _amounts(df: DataFrame) -> DataFrame:
    """Rows per (user, category, amount)."""
    return df.where(F.col("amount").isNotNull()).groupBy(*GROUP, "amount").agg(F.count(F.lit(1)).alias("n_rows"))


def amount_percentiles(df: DataFrame) -> DataFrame:
    """(user, category, amount) -> average rank over group size, one row per distinct amount."""
    return percentiles_of_counts(_amounts(df))


def percentiles_of_counts(counts: DataFrame) -> DataFrame:
    """As `amount_percentiles`, from the rows of each amount (`n_rows`).

    Ranks accumulate inside cells of near amounts and then over the cells, never over raw rows.
    """
    amounts = counts.withColumn("_cell", _amount_cell(F.col("amount")))
    below_cell = Window.partitionBy(*GROUP).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        amounts.groupBy(*GROUP, "_cell")
        .agg(F.sum("n_rows").alias("_n"))
        .withColumn("_below", F.coalesce(F.sum("_n").over(below_cell), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*GROUP)))
        .drop("_n")
    )
    inside = Window.partitionBy(*GROUP, "_cell").orderBy("amount").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_below") + F.col("_lower") + (F.col("n_rows") + 1) / F.lit(2.0)
    return (
        amounts.withColumn("_lower", F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
        .join(cells, [*GROUP, "_cell"])
        .select(*GROUP, "amount", (rank / F.col("_total")).alias("category_percentile"))
    )


def category_percentile(df: DataFrame, row_id: str = "transaction_id") -> DataFrame:
    """Average rank of an amount in its group over the group size; 0.5 without a group or an amount."""
    joined = attach(df, amount_percentiles(df), [*GROUP, "amount"], F.col(row_id), counted=_amounts(df))
    return joined.withColumn("category_percentile", F.coalesce("category_percentile", F.lit(0.5)))


def _with_week_counts(df: DataFrame, cell_table: DataFrame, tie: str, ts: str) -> DataFrame:
    """7-day counts from hourly cells; `cell_table` has one row per group and hour (`_n`) and is joined in.

    The window [t - 7 days, t] covers whole hours, which come from `cell_table`, the part of the first hour
    at or after t - 7 days, and the part of the own hour up to this row. For the first hour each row is
    copied seven days ahead (without its payload), so both parts are counted in one hour-sized window.
    """
    payload = [name for name in df.columns if name not in GROUP]
    micros = F.unix_micros(ts)
    copies = F.explode(
        F.array(
            F.struct(micros.alias("us"), time_cell(ts, HOUR_US).alias("cell"), F.lit(0).alias("kind")),
            F.struct((micros + WEEK_US).alias("us"), (time_cell(ts, HOUR_US) + WEEK_HOURS).alias("cell"), F.lit(1).alias("kind")),
        )
    )
    doubled = (
        df.withColumn("_copy", copies)
        .select(
            *GROUP,
            F.col("_copy.us").alias("_us"),
            F.col("_copy.cell").alias("_cell"),
            F.col("_copy.kind").alias("_kind"),
            *[F.when(F.col("_copy.kind") == 0, F.col(name)).alias(name) for name in payload],
        )
    )
    upto = (
        Window.partitionBy(*GROUP, "_cell").orderBy("_us", "_kind", tie).rowsBetween(Window.unboundedPreceding, 0)
    )
    own = F.count(F.when(F.col("_kind") == 0, 1)).over(upto)
    expired = F.count(F.when(F.col("_kind") == 1, 1)).over(upto)  # first-hour rows before t - 7 days
    by_hour = Window.partitionBy(*GROUP).orderBy("_cell")
    hours = (
        cell_table.withColumn("_between", F.sum("_n").over(by_hour.rangeBetween(-(WEEK_HOURS - 1), -1)))
        .withColumn("_first", F.sum("_n").over(by_hour.rangeBetween(-WEEK_HOURS, -WEEK_HOURS)))
        .drop("_n")
    )
    counted = doubled.withColumn("_own", own).withColumn("_expired", expired).where(F.col("_kind") == 0)
    return (
        counted.join(hours, [*GROUP, "_cell"])
        .withColumn(
            "spending_freq_7d",
            F.coalesce("_between", F.lit(0)) + F.coalesce("_first", F.lit(0)) - F.col("_expired") + F.col("_own"),
        )
        .drop("_us", "_cell", "_kind", "_own", "_expired", "_between", "_first")
    )


def _groupable(ts: str) -> Column:
    return F.col("user_id").isNotNull() & F.col("category").isNotNull() & F.col(ts).isNotNull()


def _hour_cells(df: DataFrame, ts: str) -> DataFrame:
    return (
        df.where(_groupable(ts))
        .groupBy(*GROUP, time_cell(ts, HOUR_US).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def spending_freq_7d(df: DataFrame, tie: str = "transaction_id", ts: str = "transaction_date") -> DataFrame:
    """Rows of the same group in [t - 7 days, t]; rows with this very time count up to this one in `tie` order.

    A row without a user, a category or a time counts 1.
    """
    counted = _with_week_counts(df.where(_groupable(ts)), _hour_cells(df, ts), tie, ts)
    rest = df.where(~_groupable(ts)).withColumn("spending_freq_7d", F.lit(1).cast("bigint"))
    return counted.unionByName(rest)


def engineer_features(df: DataFrame, tie: str = "transaction_id", ts: str = "transaction_date") -> DataFrame:
    """All nine numeric features. The rows are shuffled twice: by amount for the rank, by hour for the rest."""
    ranked = category_percentile(df, tie)
    whole = ranked.where(_groupable(ts))
    stats = user_category_stats(df)
    cells = _hour_cells(df, ts).join(stats, GROUP)  # statistics ride on the hourly cells
    scored = _with_week_counts(whole, cells, tie, ts)
    # A row without a time still has a spread; one without a group has none.
    rest = attach(ranked.where(~_groupable(ts)), stats, GROUP, F.col(tie), counted=stats)
    rest = rest.withColumn("spending_freq_7d", F.lit(1).cast("bigint"))
    return (
        date_features(scored.unionByName(rest), ts)
        .withColumn("log_amount", log_amount())
        .withColumn("amount_zscore", _zscore())
        .drop("n_rows", "mean_amount", "std_amount", "min_amount", "max_amount")
    )
