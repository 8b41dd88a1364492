"""Lists, dashboards, insights and labelled-set reports."""

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.book import enter
from coinweir.functions import fixed_values as V
from coinweir.operators import reports as R

COLS = "id, user_id, merchant, amount, category_name, category_id, transaction_type, created_at"
SPARK_COLS = COLS.split(", ")
FLAGGED_WHERE = "is_anomaly AND (anomaly_status = 'confirmed_anomaly' OR anomaly_status IS NULL)"
MONEY = "'$' || format('{:,.2f}', amount)"
SEVERITY = "CASE WHEN anomaly_score IS NULL OR anomaly_score < 0.5 THEN 'low' WHEN anomaly_score < 0.8 THEN 'medium' ELSE 'high' END"

enter(
    "list_transactions",
    lambda s, d: R.list_transactions(T.txn_orders(s, d)).select(*SPARK_COLS),
    f"WITH {T.TXN_ORDERS} SELECT {COLS} FROM txn ORDER BY user_id, created_at DESC, id DESC",
)
enter(
    "sort_newest_first",
    lambda s, d: T.txn_events(s, d).orderBy(*R.newest_first()).select(*SPARK_COLS),
    f"WITH {T.TXN_EVENTS} SELECT {COLS} FROM txn ORDER BY created_at DESC, id DESC",
)
enter(
    "sort_user_time",
    lambda s, d: R.number_by_time(T.txn_orders(s, d)).select("id", "user_id", "created_at", "seq"),
    f"WITH {T.TXN_ORDERS} SELECT id, user_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS seq FROM txn",
)
enter(
    "transaction_by_id",
    lambda s, d: R.transactions_by_id(
        T.txn_events(s, d),
        T.read(s, d, "orders").select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 150).cast("string").alias("user_id")
        ),
    ).select(*SPARK_COLS),
    f"""WITH {T.TXN_EVENTS} SELECT {COLS} FROM txn WHERE EXISTS (
      SELECT 1 FROM orders WHERE o_orderkey = id AND CAST(o_custkey % 150 AS VARCHAR) = user_id)""",
)
enter(
    "search_transactions",
    lambda s, d: R.search_transactions(T.txn_events(s, d), "Err", "Expenses").select(*SPARK_COLS),
    f"""WITH {T.TXN_EVENTS} SELECT {COLS} FROM txn
      WHERE (contains(lower(merchant), 'err') OR contains(lower(category_name), 'err')) AND transaction_type = 'expense'""",
)
enter(
    "flagged_transactions",
    lambda s, d: R.flagged_transactions(T.txn_flagged(s, d)).select(*SPARK_COLS, "anomaly_status"),
    f"WITH {T.TXN_FLAGGED} SELECT {COLS}, anomaly_status FROM flagged WHERE {FLAGGED_WHERE}",
)
enter(
    "severity_bucket",
    lambda s, d: T.txn_flagged(s, d).select("id", R.severity("anomaly_score").alias("severity")),
    f"WITH {T.TXN_FLAGGED} SELECT id, {SEVERITY} AS severity FROM flagged",
)
enter(
    "insight_type_map",
    lambda s, d: T.txn_events(s, d).select(
        "id",
        R.insight_type(
            F.when(F.col("category_id") == 1, "Tip").when(F.col("category_id") == 2, "PATTERN").when(F.col("category_id") == 3, "unusual").otherwise(F.col("category_name"))
        ).alias("insight_type"),
    ),
    f"""WITH {T.TXN_EVENTS} SELECT id, CASE category_id WHEN 1 THEN 'SUGGESTION' WHEN 2 THEN 'PATTERN' ELSE 'UNUSUAL' END AS insight_type FROM txn""",
)

INSIGHT_SQL = f"""user_id, 'unusual' AS type, 'Unusual ' || category_name || ' transaction' AS title,
    CASE WHEN anomaly_reason IS NULL OR anomaly_reason = '' THEN 'Your ' || {MONEY} || ' ' || merchant || ' transaction was flagged as unusual.'
         ELSE anomaly_reason END AS description,
    {MONEY} AS value, id AS transaction_id, {SEVERITY} AS severity, created_at"""
enter(
    "insight_projection",
    lambda s, d: R.insight_projection(T.txn_flagged(s, d)),
    f"WITH {T.TXN_FLAGGED} SELECT {INSIGHT_SQL} FROM flagged",
)
enter(
    "insight_ids",
    lambda s, d: R.insight_ids(R.flagged_transactions(T.txn_flagged(s, d))).select("id", "user_id", "insight_id"),
    f"""WITH {T.TXN_FLAGGED} SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS insight_id
      FROM flagged WHERE {FLAGGED_WHERE}""",
)
enter(
    "insights",
    lambda s, d: R.insights(T.txn_flagged(s, d)),
    f"""WITH {T.TXN_FLAGGED} SELECT row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, flagged.id DESC) AS id, {INSIGHT_SQL.replace('id AS transaction_id', 'flagged.id AS transaction_id')}
      FROM flagged WHERE {FLAGGED_WHERE}""",
)
enter(
    "insight_summary",
    lambda s, d: R.insight_summary(T.txn_flagged(s, d)),
    f"""WITH {T.TXN_FLAGGED} SELECT user_id, count(*) AS total_insights, count(*) AS unusual_count, CAST(0 AS BIGINT) AS tips_count,
      CAST(0 AS BIGINT) AS pattern_count FROM flagged WHERE {FLAGGED_WHERE} GROUP BY user_id""",
)
enter(
    "ml_input_projection",
    lambda s, d: R.ml_input(T.txn_events(s, d)),
    f"""WITH {T.TXN_EVENTS} SELECT CAST(id AS VARCHAR) AS transaction_id, user_id, created_at AS transaction_date, merchant, amount,
      category_name AS category, transaction_type, nullif(notes, '') AS notes FROM txn""",
)
enter(
    "ml_output_projection",
    lambda s, d: R.ml_output(
        T.txn_flagged(s, d).select(
            F.col("id").cast("string").alias("transaction_id"),
            F.when(F.col("k") % 7 != 0, F.col("is_anomaly")).alias("is_anomaly"),
            "anomaly_status",
            F.col("anomaly_score").alias("confidence"),
            F.col("anomaly_reason").alias("reason"),
            F.col("merchant").alias("model_version"),
        )
    ),
    f"""WITH {T.TXN_FLAGGED} SELECT CAST(id AS VARCHAR) AS transaction_id, k % 7 <> 0 AND is_anomaly AS is_anomaly, anomaly_status,
      anomaly_score, anomaly_reason, merchant AS ml_model_version FROM flagged""",
)

TOTALS = """totals AS (SELECT user_id, round(coalesce(sum(CASE WHEN transaction_type = 'expense' THEN amount END), 0.0), 2) AS total_expense,
  round(coalesce(sum(CASE WHEN transaction_type = 'income' THEN amount END), 0.0), 2) AS total_income FROM txn GROUP BY user_id)"""
BREAKDOWN = """per_cat AS (SELECT user_id, category_id, sum(amount) AS a, arg_max(category_name, {order}) AS category_name
    FROM txn WHERE transaction_type = 'expense' GROUP BY user_id, category_id),
  breakdown AS (SELECT user_id, category_id, category_name, round(a, 2) AS amount,
    CASE WHEN sum(a) OVER (PARTITION BY user_id) > 0 THEN round(a / sum(a) OVER (PARTITION BY user_id) * 100, 2) ELSE 0.0 END AS percentage,
    row_number() OVER (PARTITION BY user_id ORDER BY a DESC, category_id) AS position FROM per_cat)"""
BREAKDOWN = BREAKDOWN.format(order="{'c': created_at, 'i': id}")
enter("dashboard_totals", lambda s, d: R.dashboard_totals(T.txn_orders(s, d)), f"WITH {T.TXN_ORDERS}, {TOTALS} SELECT * FROM totals")
enter(
    "net_balance",
    lambda s, d: R.net_balance(T.txn_orders(s, d)),
    f"WITH {T.TXN_ORDERS}, {TOTALS} SELECT user_id, round(total_income - total_expense, 2) AS balance FROM totals",
)
enter(
    "category_breakdown",
    lambda s, d: R.category_breakdown(T.txn_orders(s, d)).drop("position"),
    f"WITH {T.TXN_ORDERS}, {BREAKDOWN} SELECT user_id, category_id, category_name, amount, percentage FROM breakdown",
)
enter(
    "sort_by_total",
    lambda s, d: R.category_breakdown(T.txn_events(s, d)).select("user_id", "category_id", "amount", "position").orderBy("user_id", "position"),
    f"WITH {T.TXN_EVENTS}, {BREAKDOWN} SELECT user_id, category_id, amount, position FROM breakdown ORDER BY user_id, position",
)
enter(
    "top_category",
    lambda s, d: R.top_category(T.txn_orders(s, d)),
    f"""WITH {T.TXN_ORDERS}, {BREAKDOWN} SELECT u.user_id, coalesce(b.category_name, '') AS top_category
      FROM (SELECT DISTINCT user_id FROM txn) u LEFT JOIN breakdown b ON u.user_id = b.user_id AND b.position = 1""",
)


def _newest(n: int, source: str) -> str:
    return f"""WITH {source} SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM txn)
      WHERE rn <= {n}"""


enter("recent_transactions", lambda s, d: R.recent_transactions(T.txn_events(s, d)).select(*SPARK_COLS), _newest(10, T.TXN_EVENTS))
enter("recent_history", lambda s, d: R.recent_history(T.txn_events(s, d)).select(*SPARK_COLS), _newest(200, T.TXN_EVENTS))
enter("top_n_per_user", lambda s, d: R.top_n_per_user(T.txn_orders(s, d), 5).select(*SPARK_COLS), _newest(5, T.TXN_ORDERS))


def _dashboard(s, d):
    parts = R.dashboard(T.txn_events(s, d))
    totals = parts["totals"].select(
        "user_id",
        F.lit("totals").alias("part"),
        F.lit(None).cast("bigint").alias("item_id"),
        F.col("total_expense").alias("amount"),
        F.col("total_income").alias("extra"),
    )
    breakdown = parts["breakdown"].select("user_id", F.lit("category").alias("part"), F.col("category_id").alias("item_id"), "amount", F.col("percentage").alias("extra"))
    recent = parts["recent"].select("user_id", F.lit("recent").alias("part"), F.col("id").alias("item_id"), "amount", F.lit(0.0).alias("extra"))
    return totals.unionByName(breakdown).unionByName(recent)


enter(
    "dashboard",
    _dashboard,
    f"""WITH {T.TXN_EVENTS}, {TOTALS}, {BREAKDOWN}
      SELECT user_id, 'totals' AS part, CAST(NULL AS BIGINT) AS item_id, total_expense AS amount, total_income AS extra FROM totals
      UNION ALL SELECT user_id, 'category', category_id, amount, percentage FROM breakdown
      UNION ALL SELECT user_id, 'recent', id, amount, CAST(0.0 AS DOUBLE) FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM txn) WHERE rn <= 10""",
)
enter(
    "format_money",
    lambda s, d: T.txn_orders(s, d).select("id", R.format_money("amount").alias("cents"), R.format_money("amount", 0).alias("whole")),
    f"WITH {T.TXN_ORDERS} SELECT id, {MONEY} AS cents, '$' || format('{{:,.0f}}', amount) AS whole FROM txn",
)

SIGNED = """signed AS (SELECT o_custkey AS statement_id, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders)"""


def _signed(s, d):
    price = F.col("o_totalprice")
    return T.read(s, d, "orders").select(
        F.col("o_custkey").alias("statement_id"), F.when(F.col("o_orderstatus") == "F", -price).otherwise(price).alias("amount")
    )


enter(
    "preview_totals",
    lambda s, d: R.preview_totals(_signed(s, d)),
    f"""WITH {SIGNED} SELECT statement_id, round(coalesce(sum(CASE WHEN amount < 0 THEN -amount END), 0.0), 2) AS expense,
      round(coalesce(sum(CASE WHEN amount >= 0 THEN amount END), 0.0), 2) AS income FROM signed GROUP BY 1""",
)
enter(
    "expense_income_counts",
    lambda s, d: R.expense_income_counts(_signed(s, d)),
    f"""WITH {SIGNED} SELECT statement_id, count(CASE WHEN amount < 0 THEN 1 END) AS expense_count,
      count(CASE WHEN amount >= 0 THEN 1 END) AS income_count FROM signed GROUP BY 1""",
)
enter(
    "dataset_profile",
    lambda s, d: R.dataset_profile(T.labelled(s, d)),
    f"""WITH {T.LABELLED} SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalies,
      CAST(count(*) - sum(is_anomaly) AS BIGINT) AS n_normal, round(sum(is_anomaly) / count(*) * 100, 1) AS anomaly_percent,
      count(*) // count(DISTINCT user_id) AS rows_per_user FROM labelled""",
)
_LABELS = ", ".join(f"('{label}')" for label in V.ANOMALY_LABELS)
enter(
    "anomaly_label_counts",
    lambda s, d: R.anomaly_label_counts(T.labelled(s, d)),
    f"""WITH {T.LABELLED}, names(label) AS (VALUES {_LABELS}) SELECT label, count(l.transaction_id) AS n_rows
      FROM names LEFT JOIN labelled l ON l.is_anomaly = 1 AND contains(lower(l.notes), label) GROUP BY label""",
)
enter(
    "user_anomaly_rate",
    lambda s, d: R.user_anomaly_rate(T.labelled(s, d)),
    f"""WITH {T.LABELLED} SELECT user_id, count(is_anomaly) AS total, CAST(sum(is_anomaly) AS BIGINT) AS anomalies,
      round(sum(is_anomaly) / count(is_anomaly) * 100, 1) AS percent FROM labelled GROUP BY user_id ORDER BY user_id LIMIT 10""",
)
CONFUSION = """cm AS (SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM predictions)"""
enter("confusion_matrix", lambda s, d: R.confusion_matrix(T.predictions(s, d)), f"WITH {T.PREDICTIONS}, {CONFUSION} SELECT * FROM cm")
enter(
    "binary_metrics",
    lambda s, d: R.binary_metrics(T.predictions(s, d)).select(
        *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "f2")]
    ),
    f"""WITH {T.PREDICTIONS}, {CONFUSION}, r AS (SELECT coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0) AS accuracy,
        coalesce(tp / nullif(tp + fp, 0), 0.0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM cm)
      SELECT round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall,
        round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0.0), 6) AS f1,
        round(coalesce(5 * "precision" * recall / nullif(4 * "precision" + recall, 0), 0.0), 6) AS f2 FROM r""",
)
enter(
    "class_report",
    lambda s, d: R.class_report(T.predictions(s, d)).select(
        "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    ),
    f"""WITH {T.PREDICTIONS}, labels2(label) AS (VALUES (0), (1)), c AS (SELECT label,
        count(*) FILTER (y_true = label AND y_pred = label) AS hit, count(*) FILTER (y_pred = label) AS guessed,
        count(*) FILTER (y_true = label) AS support FROM labels2, predictions GROUP BY label),
      r AS (SELECT label, support, coalesce(hit / nullif(guessed, 0), 0.0) AS p, coalesce(hit / nullif(support, 0), 0.0) AS r FROM c)
      SELECT label, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, support FROM r""",
)
