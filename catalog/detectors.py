"""Fraud patterns and spending patterns. The bounds fit the density of the driver's tables."""

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.book import enter
from coinweir.operators import detectors as D

E = f"WITH {T.TXN_EVENTS}, e AS (SELECT * FROM txn WHERE transaction_type = 'expense')"
O = f"WITH {T.TXN_ORDERS}, e AS (SELECT * FROM txn WHERE transaction_type = 'expense')"  # noqa: E741
FIRST = "firsts AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id, merchant ORDER BY created_at, id) AS rn FROM {0}) WHERE rn = 1)"
PRIOR = """prior AS (SELECT *, avg(amount) OVER (PARTITION BY user_id, category_name ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_mean,
  count(*) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS any_n,
  count(*) OVER (PARTITION BY user_id, hour(created_at) ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hour_n FROM e)"""

enter(
    "det_card_testing",
    lambda s, d: D.card_testing(T.txn_events(s, d), 40.0, 2, 1440).select("id", "user_id", "category_name", "n_charges"),
    f"""{E} SELECT * FROM (SELECT id, user_id, category_name, count(*) OVER (PARTITION BY user_id, category_name ORDER BY created_at
      RANGE BETWEEN INTERVAL 1440 MINUTES PRECEDING AND CURRENT ROW) AS n_charges FROM e WHERE amount <= 40) WHERE n_charges >= 2""",
)
enter(
    "det_velocity",
    lambda s, d: D.velocity(T.txn_events(s, d), 4, 2, 1440).select("id", "user_id", "n_charges", "n_categories"),
    f"""{E} SELECT * FROM (SELECT a.id, any_value(a.user_id) AS user_id, count(*) AS n_charges, count(DISTINCT b.category_name) AS n_categories
      FROM e a JOIN e b ON a.user_id = b.user_id AND b.created_at BETWEEN a.created_at - INTERVAL 1440 MINUTES AND a.created_at GROUP BY a.id)
      WHERE n_charges >= 4 AND n_categories >= 2""",
)


def _coarse(s, d):
    return T.txn_events(s, d).withColumn("amount", F.floor(F.col("amount") / 50) * 50.0)


enter(
    "det_duplicate_charge",
    lambda s, d: D.duplicate_charge(_coarse(s, d), 2880).select("id", "user_id", "merchant", "amount", "gap_us"),
    f"""{E}, c AS (SELECT * REPLACE (floor(amount / 50) * 50.0 AS amount) FROM e)
      SELECT id, user_id, merchant, amount, gap_us FROM (SELECT *, epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY user_id, merchant, amount ORDER BY created_at, id)) AS gap_us FROM c)
      WHERE gap_us <= 172800000000""",
)
enter(
    "det_merchant_novelty",
    lambda s, d: D.merchant_novelty(T.txn_events(s, d), 3.0).select("id", "user_id", "merchant", F.round("ratio", 6).alias("ratio")),
    f"""{E}, {FIRST.format('e')}, {PRIOR} SELECT id, user_id, merchant, round(amount / prior_mean, 6) AS ratio FROM prior WHERE amount > 3 * prior_mean AND id IN (SELECT id FROM firsts)""",
)
enter(
    "det_silent_fraud",
    lambda s, d: D.silent_fraud(T.txn_events(s, d)).select("id", "user_id", "merchant"),
    f"""{E}, {FIRST.format('e')}, {PRIOR} SELECT id, user_id, merchant FROM prior WHERE amount / prior_mean BETWEEN 1.8 AND 3.0 AND id IN (SELECT id FROM firsts)""",
)
WATCH = ["MERCHANT C", "MERCHANT M", "MERCHANT X"]
enter(
    "det_geo_novelty",
    lambda s, d: D.geo_novelty(T.txn_events(s, d), WATCH).select("id", "user_id", "merchant", "amount"),
    f"""{E}, {FIRST.format('e')} SELECT id, user_id, merchant, amount FROM e WHERE merchant IN ('MERCHANT C', 'MERCHANT M', 'MERCHANT X') AND id IN (SELECT id FROM firsts)""",
)
enter(
    "det_unusual_hour",
    lambda s, d: D.unusual_hour(T.txn_events(s, d)).select("id", "user_id", "hour", F.round("hour_share", 6).alias("hour_share")),
    f"""{E}, {PRIOR} SELECT id, user_id, CAST(hour(created_at) AS INTEGER) AS "hour", round(hour_n / any_n, 6) AS hour_share FROM prior WHERE any_n >= 20 AND hour_n / any_n < 0.02""",
)
enter(
    "det_mixed_chain",
    lambda s, d: D.mixed_chain(T.txn_events(s, d), min_rows=2, factor=1.5, share=0.04, min_prior=10),
    f"""{E}, {FIRST.format('e')}, {PRIOR}, f AS (SELECT *, CASE WHEN any_n >= 10 AND hour_n / any_n < 0.04 THEN 1 ELSE 0 END + CASE WHEN amount > 1.5 * prior_mean THEN 1 ELSE 0 END
        + CASE WHEN id IN (SELECT id FROM firsts) THEN 1 ELSE 0 END AS flags FROM prior)
      SELECT user_id, CAST(created_at AS DATE) AS "day", count(*) AS n_rows FROM f WHERE flags >= 2 GROUP BY 1, 2 HAVING count(*) >= 2""",
)
enter(
    "det_behavioral_shift",
    lambda s, d: D.behavioral_shift(T.txn_events(s, d), 14, 1.3, 2),
    f"""{E}, t AS (SELECT user_id, category_name, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) / 14) AS BIGINT) AS period, sum(amount) AS total, count(*) AS n FROM e GROUP BY 1, 2, 3),
      p AS (SELECT *, sum(total) OVER w / sum(n) OVER w AS prior FROM t WINDOW w AS (PARTITION BY user_id, category_name ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT user_id, period, count(*) AS n_categories FROM p WHERE total / n >= 1.3 * prior GROUP BY 1, 2 HAVING count(*) >= 2""",
)
enter(
    "det_frequency_burst",
    lambda s, d: D.frequency_burst(T.txn_events(s, d), 3),
    f"""{E} SELECT user_id, category_name, CAST(created_at AS DATE) AS "day", count(*) AS n_charges, round(sum(amount), 2) AS total FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
)
DAYS = "days AS (SELECT {0}, CAST(created_at AS DATE) AS d, count(*) AS n, sum(amount) AS total FROM e GROUP BY ALL)"
enter(
    "det_dormant_spike",
    lambda s, d: D.dormant_spike(T.txn_orders(s, d), 21, 300, 3),
    f"""{O}, {DAYS.format('user_id')}, j AS (SELECT user_id, d, date_diff('day', lag(d) OVER w, d) AS gap,
        CAST(sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL 299 DAYS FOLLOWING) AS BIGINT) AS n_charges FROM days WINDOW w AS (PARTITION BY user_id ORDER BY d))
      SELECT user_id, d AS "day", gap, n_charges FROM j WHERE gap >= 21 AND n_charges >= 3""",
)
enter(
    "det_new_subscription",
    lambda s, d: D.new_subscription(T.txn_events(s, d), 3, 9, (2, 20), 1.5),
    f"""{E}, {DAYS.format('user_id, merchant')}, g AS (SELECT *, coalesce(date_diff('day', lag(d) OVER w, d) BETWEEN 2 AND 20 AND abs(total - lag(total) OVER w) <= 1.5 * lag(total) OVER w, FALSE) AS goes_on
        FROM days WINDOW w AS (PARTITION BY user_id, merchant ORDER BY d)),
      r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, merchant ORDER BY d) AS run FROM g)
      SELECT user_id, merchant, count(*) AS n_charges, min(d) AS first_day, max(d) AS last_day, round(avg(total), 4) AS mean_amount FROM r WHERE run = 1 GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 9""",
)
RECURRING = """r AS (SELECT {0}, count(*) AS n_charges, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap, avg(total) AS mean_amount
    FROM (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY {0} ORDER BY d), d) AS gap FROM days) GROUP BY {0}),
  c AS (SELECT *, CASE WHEN mean_gap BETWEEN 6 AND 8 THEN 'weekly' WHEN mean_gap BETWEEN 13 AND 15 THEN 'biweekly' WHEN mean_gap BETWEEN 27 AND 32 THEN 'monthly' END AS cadence FROM r),
  recurring AS (SELECT * FROM c WHERE n_charges >= {1} AND cadence IS NOT NULL AND coalesce(std_gap, 0) <= {2})"""
enter(
    "recurring_payments",
    lambda s, d: D.recurring_payments(T.txn_events(s, d)).select(
        "user_id", "merchant", "n_charges", "cadence", F.round("mean_gap", 6).alias("mean_gap"), F.round("mean_amount", 4).alias("mean_amount")
    ),
    f"""{E}, {DAYS.format('user_id, merchant')}, {RECURRING.format('user_id, merchant', 3, 3)} SELECT user_id, merchant, n_charges, cadence, round(mean_gap, 6) AS mean_gap, round(mean_amount, 4) AS mean_amount FROM recurring""",
)
enter(
    "overlapping_subscriptions",
    lambda s, d: D.overlapping_subscriptions(T.txn_events(s, d), min_charges=2, max_gap_std=10.0).withColumn("monthly_total", F.round("monthly_total", 7)),
    f"""{E}, {DAYS.format('user_id, category_name, merchant')}, {RECURRING.format('user_id, category_name, merchant', 2, 10)}
      SELECT user_id, category_name, count(*) AS n_merchants, round(sum(mean_amount * 30 / mean_gap), 7) AS monthly_total FROM recurring GROUP BY 1, 2 HAVING count(*) >= 2""",
)
enter(
    "det_category_switch",
    lambda s, d: D.category_switch(T.txn_events(s, d)).select("id", "user_id", "category_name", "rarity"),
    f"""{E}, n AS (SELECT user_id, category_name, row_number() OVER (PARTITION BY user_id ORDER BY count(*), category_name) AS rarity FROM e GROUP BY 1, 2),
      m AS (SELECT user_id, avg(amount) AS user_mean FROM e GROUP BY 1)
      SELECT id, user_id, category_name, rarity FROM e JOIN n USING (user_id, category_name) JOIN m USING (user_id) WHERE rarity <= 3 AND amount > 2 * user_mean""",
)
enter(
    "det_income_outlier",
    lambda s, d: D.income_outlier(T.txn_orders(s, d)).select("id", "user_id", "merchant", "amount"),
    f"""{O}, i AS (SELECT * FROM txn WHERE transaction_type = 'income'), {FIRST.format('i')} SELECT id, user_id, merchant, amount FROM i WHERE amount >= 3000 AND id IN (SELECT id FROM firsts)""",
)
LISTED = {"BUILDING": ["MERCHANT A", "MERCHANT B"], "MACHINERY": ["MERCHANT B", "MERCHANT Z"]}
enter(
    "det_profile_contradiction",
    lambda s, d: D.profile_contradiction(
        T.txn_orders(s, d), T.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("segment")), LISTED
    ).select("id", "user_id", "merchant", "segment"),
    f"""{O} SELECT id, user_id, merchant, c_mktsegment AS segment FROM e JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id
      WHERE (c_mktsegment = 'BUILDING' AND merchant IN ('MERCHANT A', 'MERCHANT B')) OR (c_mktsegment = 'MACHINERY' AND merchant IN ('MERCHANT B', 'MERCHANT Z'))""",
)
SEASON_NAME = "CASE category_id WHEN 1 THEN 'Shopping' WHEN 2 THEN 'Entertainment' WHEN 3 THEN 'Healthcare' WHEN 4 THEN 'Food & Dining' ELSE category_name END"
FACTOR = "CASE WHEN {0} = 'Shopping' AND {1} IN (11, 12) THEN 1.4 WHEN {0} = 'Entertainment' AND {1} IN (6, 7, 8) THEN 1.25 WHEN {0} = 'Healthcare' AND {1} = 1 THEN 1.2 WHEN {0} = 'Food & Dining' AND {1} IN (6, 7, 8) THEN 1.15 ELSE 1.0 END"


def _seasonal(s, d):
    return T.txn_orders(s, d).withColumn("category_name", F.expr(SEASON_NAME)).withColumn("user_id", (F.col("user_id").cast("bigint") % 20).cast("string"))


enter(
    "season_multiplier",
    lambda s, d: _seasonal(s, d).select("id", D.season_multiplier(F.col("category_name"), F.month("created_at")).alias("factor")),
    f"{O} SELECT id, CAST({FACTOR.format(SEASON_NAME, 'month(created_at)')} AS DOUBLE) AS factor FROM txn",
)
enter(
    "seasonal_excess",
    lambda s, d: D.seasonal_excess(_seasonal(s, d)).select("user_id", "category_name", "month", F.round("total", 2).alias("total"), F.round("excess", 6).alias("excess")),
    f"""{O}, s AS (SELECT * REPLACE ({SEASON_NAME} AS category_name, CAST(CAST(user_id AS BIGINT) % 20 AS VARCHAR) AS user_id) FROM e),
      t AS (SELECT user_id, category_name, CAST(date_trunc('month', created_at) AS DATE) AS m, sum(amount) AS total FROM s GROUP BY 1, 2, 3),
      f AS (SELECT *, {FACTOR.format('category_name', 'month(m)')} AS factor FROM t), x AS (SELECT *, total / (avg(total / factor) OVER (PARTITION BY user_id, category_name) * factor) AS excess FROM f)
      SELECT user_id, category_name, m AS "month", round(total, 2) AS total, round(excess, 6) AS excess FROM x WHERE excess >= 1.5""",
)
for unit in ("week", "month"):
    enter(
        "category_period_change" if unit == "week" else "category_period_change_month",
        lambda s, d, unit=unit: D.category_period_change((T.txn_events if unit == "week" else T.txn_orders)(s, d), unit).select(
            "user_id", "category_name", "period_start", F.round("total", 2).alias("total"), F.round("previous", 2).alias("previous"), "change_percent"
        ),
        f"""{E if unit == "week" else O}, t AS (SELECT user_id, category_name, CAST(date_trunc('{unit}', created_at) AS DATE) AS period_start, sum(amount) AS total FROM e GROUP BY 1, 2, 3),
          l AS (SELECT *, lag(total) OVER (PARTITION BY user_id, category_name ORDER BY period_start) AS previous FROM t)
          SELECT user_id, category_name, period_start, round(total, 2) AS total, round(previous, 2) AS previous, round((total - previous) / previous * 100, 1) + 0.0 AS change_percent FROM l""",
    )
enter(
    "amount_vs_category_average",
    lambda s, d: D.amount_vs_category_average(T.txn_events(s, d)).select("id", F.round("category_average", 8).alias("category_average"), F.round("ratio", 6).alias("ratio")),
    f"""{E} SELECT id, round(avg(amount) OVER g, 8) AS category_average, round(amount / avg(amount) OVER g, 6) AS ratio FROM e WINDOW g AS (PARTITION BY user_id, category_name)""",
)
enter(
    "weekly_stability",
    lambda s, d: D.weekly_stability(T.txn_events(s, d)).select("user_id", "category_name", "n_weeks", F.round("weekly_mean", 4).alias("weekly_mean"), F.round("variation", 6).alias("variation")),
    f"""{E}, w AS (SELECT user_id, category_name, date_trunc('week', created_at) AS wk, sum(amount) AS total FROM e GROUP BY 1, 2, 3)
      SELECT user_id, category_name, count(*) AS n_weeks, round(avg(total), 4) AS weekly_mean, round(stddev_samp(total) / avg(total), 6) AS variation FROM w GROUP BY 1, 2""",
)
enter(
    "weekend_share",
    lambda s, d: D.weekend_share(T.txn_events(s, d)),
    f"""{E} SELECT user_id, category_name, count(*) AS n_charges, round(count(*) FILTER (dayofweek(created_at) IN (0, 6)) / count(*), 6) AS weekend_share FROM e GROUP BY 1, 2""",
)
