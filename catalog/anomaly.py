"""Scoring against history. History is what happened before 25 January, the batch is what came after."""

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.book import enter
from coinweir.functions import fixed_values as V
from coinweir.operators import anomaly as A
from coinweir.operators import reports as R

CUT = "2024-01-25"


def split(txns):
    rows = R.ml_input(txns).withColumn("transaction_id", F.col("transaction_id").cast("bigint"))
    history = rows.where(F.col("transaction_date") < F.lit(CUT).cast("timestamp"))
    batch = rows.where(F.col("transaction_date") >= F.lit(CUT).cast("timestamp"))
    return batch, history


def orders_split(s, d):
    rows = R.ml_input(T.txn_orders(s, d)).withColumn("transaction_id", F.col("transaction_id").cast("bigint"))
    cut = F.lit("1998-01-01").cast("timestamp")
    return rows.where(F.col("transaction_date") >= cut), rows.where(F.col("transaction_date") < cut)


def _sides(source, cut, extra):
    return f"""{source}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
      FROM txn WHERE created_at < TIMESTAMP '{cut}'), h AS (SELECT * FROM ranked WHERE rn <= 200),
    b AS (SELECT * FROM txn WHERE created_at >= TIMESTAMP '{cut}' {extra})"""


SIDES = _sides(T.TXN_EVENTS, CUT, "")
ORDER_SIDES = _sides(T.TXN_ORDERS, "1998-01-01", "")
AGAINST = """facts AS (SELECT b.id AS transaction_id, any_value(b.amount) AS amount,
    count(h.id) FILTER (h.transaction_type = 'expense') AS n_expense,
    count(h.id) FILTER (h.transaction_type = 'expense' AND h.category_name = b.category_name) AS n_category,
    avg(h.amount) FILTER (h.transaction_type = 'expense' AND h.category_name = b.category_name) AS category_mean,
    max(h.amount) FILTER (h.transaction_type = 'expense' AND h.category_name = b.category_name) AS category_max,
    coalesce(bool_or(abs(b.amount - h.amount) < 0.01) FILTER (h.transaction_type = 'expense' AND h.category_name = b.category_name), FALSE) AS same_amount
  FROM b LEFT JOIN h ON b.user_id = h.user_id GROUP BY b.id)"""
RULE = """CASE WHEN n_expense < 10 THEN 'cold_start_total' WHEN n_category < 5 THEN 'cold_start_category' WHEN same_amount THEN 'same_amount'
  WHEN (category_mean > 0 AND abs(amount - category_mean) / category_mean <= 0.2) OR (category_max > 0 AND abs(amount - category_max) / category_max <= 0.2)
  THEN 'tolerance' END"""

enter(
    "batch_against_history",
    lambda s, d: A.batch_against_history(*split(T.txn_events(s, d))).select(
        "transaction_id", "n_expense", "n_category", F.round("category_mean", 4).alias("category_mean"), "category_max", "same_amount"
    ),
    f"""WITH {SIDES}, {AGAINST} SELECT transaction_id, n_expense, n_category, round(category_mean, 4) AS category_mean, category_max,
      same_amount FROM facts""",
)
enter(
    "history_counts",
    lambda s, d: A.batch_against_history(*orders_split(s, d)).select("transaction_id", "n_expense", "n_category"),
    f"WITH {ORDER_SIDES}, {AGAINST} SELECT transaction_id, n_expense, n_category FROM facts",
)
enter(
    "same_amount_exists",
    lambda s, d: A.batch_against_history(*split(T.txn_events(s, d))).select("transaction_id", "same_amount"),
    f"WITH {SIDES}, {AGAINST} SELECT transaction_id, same_amount FROM facts",
)
SAFE = f"""SELECT transaction_id, {RULE} AS safeguard, CASE WHEN {RULE} LIKE 'cold%' THEN 'insufficient_history' WHEN {RULE} IS NOT NULL THEN 'normal' END AS anomaly_status FROM facts"""
enter(
    "anomaly_safeguards",
    lambda s, d: A.anomaly_safeguards(*split(T.txn_events(s, d))).select("transaction_id", "safeguard", "anomaly_status"),
    f"WITH {SIDES}, {AGAINST} {SAFE}",
)
enter(
    "anomaly_safeguards_cold_start",
    lambda s, d: A.anomaly_safeguards(*orders_split(s, d)).select("transaction_id", "safeguard", "anomaly_status"),
    f"WITH {ORDER_SIDES}, {AGAINST} {SAFE}",
)
HF = """pool AS (SELECT b.id AS target, h.amount AS amount, h.created_at AS at, FALSE AS mine FROM b JOIN h ON b.user_id = h.user_id AND b.category_name = h.category_name
    UNION ALL SELECT id, amount, created_at, TRUE FROM b),
  hf AS (SELECT p.target AS transaction_id,
    CASE WHEN min(p.amount) < max(p.amount) THEN (any_value(b.amount) - avg(p.amount)) / stddev_samp(p.amount) ELSE 0.0 END AS z,
    (count(*) FILTER (p.amount < b.amount) + (count(*) FILTER (p.amount = b.amount) + 1) / 2.0::DOUBLE) / count(*) AS pct,
    count(*) FILTER (p.at >= b.created_at - INTERVAL 7 DAYS AND p.at <= b.created_at) AS freq,
    any_value(b.category_name) AS category, any_value(hour(b.created_at)) AS hr
  FROM pool p JOIN b ON p.target = b.id GROUP BY p.target)"""


def _survivors(s, d):
    checked = A.anomaly_safeguards(*split(T.txn_events(s, d)))
    return A.features_against_history(checked.where(F.col("safeguard").isNull()))


enter(
    "features_against_history",
    lambda s, d: _survivors(s, d).select(
        "transaction_id", F.round("amount_zscore", 6).alias("amount_zscore"), F.round("category_percentile", 9).alias("category_percentile"), "spending_freq_7d"
    ),
    f"""WITH {SIDES}, {AGAINST}, {HF} SELECT transaction_id, round(z, 6) AS amount_zscore, round(pct, 9) AS category_percentile, freq AS spending_freq_7d
      FROM hf JOIN facts USING (transaction_id) WHERE {RULE} IS NULL""",
)


def _quote(text):
    return text.replace("'", "''")


def _sentence(pattern, first, second):
    parts = _quote(pattern).replace("%d", "' || freq || '").replace("%s", "' || category || '")
    return f"'{parts}'"


REASON_SQL = f"""CASE WHEN high AND often AND late THEN {_sentence(V.REASON_ALL, 0, 0)}
  WHEN often AND late THEN {_sentence(V.REASON_FREQ_TIME, 0, 0)} WHEN high AND late THEN {_sentence(V.REASON_HIGH_TIME, 0, 0)}
  WHEN high AND often THEN {_sentence(V.REASON_HIGH_FREQ, 0, 0)} WHEN late THEN {_sentence(V.REASON_TIME, 0, 0)}
  WHEN often THEN {_sentence(V.REASON_FREQ, 0, 0)} WHEN high THEN {_sentence(V.REASON_HIGH, 0, 0)} ELSE {_sentence(V.REASON_GENERIC, 0, 0)} END"""
enter(
    "anomaly_reason",
    lambda s, d: _survivors(s, d).select("transaction_id", A.anomaly_reason(F.col("amount") > 60).alias("reason")),
    f"""WITH {SIDES}, {AGAINST}, {HF}, flags AS (SELECT hf.*, facts.amount, z > 2 OR pct > 0.95 AS high, freq > 5 AS often, hr BETWEEN 1 AND 4 AS late
      FROM hf JOIN facts USING (transaction_id) WHERE {RULE} IS NULL)
      SELECT transaction_id, CASE WHEN amount > 60 THEN {REASON_SQL} END AS reason FROM flags""",
)
enter(
    "history_exclude_batch",
    lambda s, d: A.history_exclude_batch(
        T.txn_orders(s, d), T.txn_orders(s, d).where(F.col("created_at") >= F.lit("2000-06-01").cast("timestamp")), 5
    ).select("id", "user_id"),
    f"""WITH {T.TXN_ORDERS} SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM txn)
      WHERE rn <= 5 AND created_at < TIMESTAMP '2000-06-01'""",
)
enter(
    "history_plus_target",
    lambda s, d: A.history_plus_target(*reversed(split(T.txn_events(s, d)))).select("transaction_id", "user_id", "amount", "is_target"),
    f"""WITH {T.TXN_EVENTS} SELECT id AS transaction_id, user_id, amount, created_at >= TIMESTAMP '{CUT}' AS is_target FROM txn""",
)
enter(
    "batch_summary",
    lambda s, d: A.batch_summary(
        T.txn_flagged(s, d).select(F.col("id").alias("transaction_id"), "is_anomaly", F.col("merchant").alias("model_version"))
    ),
    f"""WITH {T.TXN_FLAGGED} SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomaly_count, arg_min(merchant, id) AS model_version FROM flagged""",
)
