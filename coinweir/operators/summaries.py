"""Summaries that two batches' rows can be merged from, in place of reading all rows again.

The newest rows of a user are one array; a group's amounts are a count, a mean and a sum of squared deviations, with
the rows of each amount and of each time beside them. Each has a `merge`, and features of a batch follow from the
merged summaries alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.operators import features as X
from coinweir.operators.reports import top_n_per_user
from coinweir.plans.skew import HOUR_US, attach

GROUP = X.GROUP

# ---- newest rows -------------------------------------------------------------------------------------------


def _newest(rows: Column, n: int) -> Column:
    return F.slice(F.sort_array(rows, asc=False), 1, n)


def recent_arrays(txns: DataFrame, n: int = V.HISTORY_ROWS) -> DataFrame:
    """user_id and `recent`, the user's newest `n` rows, newest first. Limited before the shuffle."""
    others = [c for c in txns.columns if c not in ("user_id", "created_at", "id")]
    entry = F.struct("created_at", "id", *others)
    return top_n_per_user(txns, n).groupBy("user_id").agg(_newest(F.collect_list(entry), n).alias("recent"))


def merge_recent(old: DataFrame, new: DataFrame, n: int = V.HISTORY_ROWS) -> DataFrame:
    """Arrays of `old` extended by those of `new`, a user of one side keeps its array; each side has a user once."""
    a, b = (df.select(F.col("user_id").alias(f"_user{i}"), F.col("recent").alias(f"_recent{i}")) for i, df in enumerate((old, new)))
    both = a.join(b, F.col("_user0").eqNullSafe(F.col("_user1")), "full")
    own = lambda a: F.when(F.size(a) <= n, F.col(a)).otherwise(F.slice(a, 1, n))
    kept = [F.when(F.col(f"_recent{1 - i}").isNull(), own(f"_recent{i}")) for i in (0, 1)]
    return both.select(
        F.coalesce("_user0", "_user1").alias("user_id"), F.coalesce(*kept, _newest(F.concat("_recent0", "_recent1"), n)).alias("recent")
    )


def newest_of(recent: Column, others: Column, n: int = V.HISTORY_ROWS) -> Column:
    """The newest `n` of two arrays of rows, newest first; `others` may be null."""
    return _newest(F.when(others.isNull(), recent).otherwise(F.concat(recent, others)), n)


def recent_rows(arrays: DataFrame) -> DataFrame:
    """The rows of the arrays."""
    return arrays.select("user_id", F.inline("recent"))


# ---- groups of amounts -------------------------------------------------------------------------------------

MOMENTS = "struct<n:bigint,mean:double,m2:double>"


def group_moments(df: DataFrame) -> DataFrame:
    """Rows, and of the known amounts their number, mean, summed squared deviations, least and largest, by group."""
    known = F.count("amount")
    return df.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.struct(known.alias("n"), F.avg("amount").alias("mean"), (F.var_pop("amount") * known).alias("m2")).alias("moments"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )


def _added(a: Column, b: Column) -> Column:
    """Moments of two disjoint sets together."""
    n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"),
        (a["mean"] + gap * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
    )
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both).cast(MOMENTS)


def merge_moments(*parts: DataFrame) -> DataFrame:
    """Summaries of all rows from those of their parts; a group has one row in each part at most."""
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
    grouped = reduce(DataFrame.unionByName, parts).groupBy(*GROUP).agg(
        F.sum("n_rows").alias("n_rows"),
        F.collect_list("moments").alias("_parts"),
        F.min("min_amount").alias("min_amount"),
        F.max("max_amount").alias("max_amount"),
    )
    return grouped.withColumn("moments", F.aggregate("_parts", none.cast(MOMENTS), _added)).drop("_parts")


def stats_of(moments: DataFrame) -> DataFrame:
    """The columns of `features.user_category_stats` from summaries."""
    n = F.col("moments.n")
    return moments.select(
        *GROUP,
        "n_rows",
        F.col("moments.mean").alias("mean_amount"),
        F.when(n > 1, F.sqrt(F.col("moments.m2") / F.nullif(n - 1, F.lit(0)))).alias("std_amount"),
        "min_amount",
        "max_amount",
    )


def amount_counts(df: DataFrame) -> DataFrame:
    """Rows of each amount of a group."""
    return df.where(F.col("amount").isNotNull()).groupBy(*GROUP, "amount").agg(F.count(F.lit(1)).alias("n_rows"))


def time_counts(df: DataFrame, ts: str = "transaction_date") -> DataFrame:
    """Rows of each time (microseconds) of a group that has a user, a category and a time."""
    return df.where(X._groupable(ts)).groupBy(*GROUP, F.unix_micros(ts).alias("us")).agg(F.count(F.lit(1)).alias("n_rows"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts by all other columns."""
    keys = [c for c in parts[0].columns if c != "n_rows"]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))


# ---- features of a batch -----------------------------------------------------------------------------------


def earlier_week(batch: DataFrame, times: DataFrame, row_id: str, ts: str) -> DataFrame:
    """row_id and `_earlier`, the rows counted in `times` within [t - 7 days, t], of each row of the batch.

    Two points of each row, t and t - 7 days, take their places among the times of their hour; whole hours before
    come from totals of hours.
    """
    us, hour = F.unix_micros(ts), lambda c: F.floor(c / F.lit(HOUR_US)).cast("bigint")
    none = F.lit(0).cast("bigint")
    points = batch.where(X._groupable(ts)).select(
        *GROUP,
        F.col(row_id).alias("_row"),
        F.explode(F.array(F.struct(us.alias("us"), F.lit(2).alias("turn")), F.struct((us - X.WEEK_US).alias("us"), F.lit(0).alias("turn")))).alias("p"),
    )
    points = points.select(*GROUP, "_row", "p.us", "p.turn", none.alias("n_rows"))  # turn: before or behind equal times
    placed = times.select(*GROUP, F.lit(None).cast(dict(points.dtypes)["_row"]).alias("_row"), "us", F.lit(1).alias("turn"), "n_rows")
    placed = points.unionByName(placed).withColumn("_cell", hour(F.col("us")))
    before = Window.partitionBy(*GROUP).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*GROUP, "_cell").agg(F.sum("n_rows").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), none)).drop("_n")
    inside = Window.partitionBy(*GROUP, "_cell").orderBy("us", "turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("_inside", F.sum("n_rows").over(inside)).where("turn <> 1").join(cells, [*GROUP, "_cell"])
    upto = F.col("_before") + F.col("_inside")
    return counted.groupBy(F.col("_row").alias(row_id)).agg(F.sum(F.when(F.col("turn") == 2, upto).otherwise(-upto)).alias("_earlier"))


def features_of_batch(
    batch: DataFrame, moments: DataFrame, amounts: DataFrame, times: DataFrame, row_id: str = "transaction_id", ts: str = "transaction_date"
) -> DataFrame:
    """What `features.engineer_features` gives for the batch's rows among all rows, from summaries of the earlier ones.

    Stored rows with the same time come before those of the batch; `row_id` is unique. Only groups of the batch are
    looked at, so the summaries may be limited to its users.
    """
    groups = batch.select(*GROUP).distinct()
    mine = lambda df: df.join(groups, GROUP, "left_semi")
    stats = stats_of(merge_moments(mine(moments), group_moments(batch)))
    ranks = X.percentiles_of_counts(merge_counts(mine(amounts), amount_counts(batch)))
    ranked = attach(batch, ranks, [*GROUP, "amount"], F.col(row_id), counted=amount_counts(batch))
    scored = attach(ranked, stats, GROUP, F.col(row_id), counted=X.user_category_stats(batch).select(*GROUP, "n_rows"))
    here = X.spending_freq_7d(scored, row_id, ts)
    earlier = earlier_week(batch, mine(times), row_id, ts)
    return (
        X.date_features(here.join(earlier, row_id, "left"), ts)
        .withColumn("spending_freq_7d", F.col("spending_freq_7d") + F.coalesce("_earlier", F.lit(0)))
        .withColumn("category_percentile", F.coalesce("category_percentile", F.lit(0.5)))
        .withColumn("log_amount", X.log_amount())
        .withColumn("amount_zscore", X._zscore())
        .drop("n_rows", "mean_amount", "std_amount", "min_amount", "max_amount", "_earlier")
    )
