"""Behavioural features."""

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.book import enter
from coinweir.functions import fixed_values as V
from coinweir.operators import features as X
from coinweir.operators import reports as R


def ml_rows(s, d):
    return R.ml_input(T.txn_events(s, d))


def ml_orders(s, d):
    return R.ml_input(T.txn_orders(s, d)).withColumn("transaction_id", F.col("transaction_id").cast("bigint"))


ML = "ml AS (SELECT id AS transaction_id, user_id, created_at AS transaction_date, merchant, amount, category_name AS category, transaction_type FROM txn)"
Z = """CASE WHEN min(amount) OVER g < max(amount) OVER g THEN coalesce((amount - avg(amount) OVER g) / nullif(stddev_samp(amount) OVER g, 0.0), 0.0)
  ELSE 0.0 END"""
PCT = "(rank() OVER (PARTITION BY user_id, category ORDER BY amount) + (count(*) OVER (PARTITION BY user_id, category, amount) - 1) / 2.0::DOUBLE) / count(*) OVER g"
FREQ = """(count(*) OVER (PARTITION BY user_id, category ORDER BY transaction_date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)
  - count(*) OVER (PARTITION BY user_id, category, transaction_date)
  + row_number() OVER (PARTITION BY user_id, category, transaction_date ORDER BY transaction_id))"""
GROUP = "WINDOW g AS (PARTITION BY user_id, category)"

enter(
    "date_features",
    lambda s, d: X.date_features(ml_rows(s, d)).select("transaction_id", "day_of_week", "day_of_month", "month", "hour", "is_weekend"),
    f"""WITH {T.TXN_EVENTS} SELECT CAST(id AS VARCHAR) AS transaction_id, CAST((dayofweek(created_at) + 6) % 7 AS INTEGER) AS day_of_week,
      CAST(day(created_at) AS INTEGER) AS day_of_month, CAST(month(created_at) AS INTEGER) AS "month", CAST(hour(created_at) AS INTEGER) AS "hour",
      CAST(CASE WHEN (dayofweek(created_at) + 6) % 7 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM txn""",
)
enter(
    "log_amount",
    lambda s, d: T.txn_orders(s, d).select("id", F.round(X.log_amount(), 9).alias("log_amount")),
    f"WITH {T.TXN_ORDERS} SELECT id, round(ln(1 + amount), 9) AS log_amount FROM txn",
)
enter(
    "user_category_stats",
    lambda s, d: X.user_category_stats(ml_orders(s, d)).select(
        "user_id", "category", "n_rows", F.round("mean_amount", 4).alias("mean_amount"), F.round("std_amount", 4).alias("std_amount"), "max_amount"
    ),
    f"""WITH {T.TXN_ORDERS}, {ML} SELECT user_id, category, count(*) AS n_rows, round(avg(amount), 4) AS mean_amount,
      round(stddev_samp(amount), 4) AS std_amount, max(amount) AS max_amount FROM ml GROUP BY user_id, category""",
)
enter(
    "amount_zscore",
    lambda s, d: X.amount_zscore(ml_orders(s, d)).select("transaction_id", F.round("amount_zscore", 6).alias("amount_zscore")),
    f"WITH {T.TXN_ORDERS}, {ML} SELECT transaction_id, round({Z}, 6) AS amount_zscore FROM ml {GROUP}",
)
enter(
    "category_percentile",
    lambda s, d: X.category_percentile(ml_orders(s, d)).select("transaction_id", F.round("category_percentile", 9).alias("category_percentile")),
    f"WITH {T.TXN_ORDERS}, {ML} SELECT transaction_id, round({PCT}, 9) AS category_percentile FROM ml {GROUP}",
)
enter(
    "spending_freq_7d",
    lambda s, d: X.spending_freq_7d(ml_orders(s, d)).select("transaction_id", "user_id", "spending_freq_7d"),
    f"WITH {T.TXN_ORDERS}, {ML} SELECT transaction_id, user_id, {FREQ} AS spending_freq_7d FROM ml",
)


def _features(rows):
    rounded = [F.round(c, 6).alias(c) for c in ("log_amount", "amount_zscore", "category_percentile")]
    return X.engineer_features(rows).select(
        "transaction_id", *rounded, *[c for c in V.NUMERIC_FEATURES if c not in ("log_amount", "amount_zscore", "category_percentile")]
    )


FEATURES = f"""SELECT transaction_id, round(ln(1 + amount), 6) AS log_amount, round({Z}, 6) AS amount_zscore, round({PCT}, 6) AS category_percentile,
  {FREQ} AS spending_freq_7d, CAST((dayofweek(transaction_date) + 6) % 7 AS INTEGER) AS day_of_week,
  CAST(day(transaction_date) AS INTEGER) AS day_of_month, CAST(month(transaction_date) AS INTEGER) AS "month",
  CAST(hour(transaction_date) AS INTEGER) AS "hour",
  CAST(CASE WHEN (dayofweek(transaction_date) + 6) % 7 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM ml {GROUP}"""
enter(
    "engineer_features",
    lambda s, d: _features(ml_rows(s, d).withColumn("transaction_id", F.col("transaction_id").cast("bigint"))),
    f"WITH {T.TXN_EVENTS}, {ML} {FEATURES}",
)
enter("engineer_features_ties", lambda s, d: _features(ml_orders(s, d)), f"WITH {T.TXN_ORDERS}, {ML} {FEATURES}")


def _lineitem_rows(s, d):
    """Line items have no natural key: the amount order stands in for the input order of equal times."""
    return T.txn_lineitem(s, d).select(
        "user_id", F.col("category_name").alias("category"), F.col("created_at").alias("transaction_date"), "amount"
    )


enter(
    "features_heavy_ties",
    lambda s, d: X.spending_freq_7d(_lineitem_rows(s, d), "amount").select("user_id", "category", "transaction_date", "spending_freq_7d"),
    f"""WITH {T.TXN_LINEITEM}, ml AS (SELECT user_id, category_name AS category, created_at AS transaction_date, amount AS transaction_id FROM txn)
      SELECT user_id, category, transaction_date, {FREQ} AS spending_freq_7d FROM ml""",
)
