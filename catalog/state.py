"""State that is kept and merged instead of being read anew: newest rows, cache, summaries, stored transactions."""

import uuid

from pyspark.sql import functions as F

from catalog import features as CF
from catalog import imports as CI
from catalog import ml as CM
from catalog import tables as T
from catalog.anomaly import AGAINST, CUT, RULE, split
from catalog.book import enter
from coinweir import schemas
from coinweir.operators import cache as C
from coinweir.operators import reports as R
from coinweir.operators import summaries as S
from coinweir.plans import imports as I
from coinweir.plans.state import START, BucketedTable
from coinweir.session import fresh_path
from coinweir.sources import files

BUCKETS = 16
YEARS = ["1994-01-01", "1996-01-01"]  # orders arrive in three parts


def recent_state(s, d, n=20):
    """The newest rows of every user, kept through three batches of orders."""
    orders = T.txn_orders(s, d)
    arrays = S.recent_arrays(orders, n)
    kept = BucketedTable(fresh_path(s, "recent"), arrays.schema, buckets=BUCKETS)
    kept.write(S.recent_arrays(orders.where(F.col("created_at") < F.lit(YEARS[0]).cast("timestamp")), n), START)
    for batch, (low, high) in enumerate(zip(YEARS, [*YEARS[1:], "9999-01-01"], strict=True)):
        rows = orders.where((F.col("created_at") >= F.lit(low).cast("timestamp")) & (F.col("created_at") < F.lit(high).cast("timestamp")))
        touched = kept.touched(rows)
        kept.write(S.merge_recent(kept.read(s, batch, touched), S.recent_arrays(rows, n), n), batch, touched)
        kept.forget(s, batch)
    return kept


enter(
    "recent_history_state",
    lambda s, d: S.recent_rows(recent_state(s, d).read(s, 2)).select("id", "user_id", "amount", "category_name", "created_at"),
    f"""WITH {T.TXN_ORDERS} SELECT id, user_id, amount, category_name, CAST(created_at AS TIMESTAMP) AS created_at
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM txn) WHERE rn <= 20""",
)


def cache_state(s, d):
    """The merchant cache after two batches of answers, of the lower and of the higher half of the users."""
    kept = BucketedTable(fresh_path(s, "cache"), schemas.MERCHANT_CACHE, buckets=BUCKETS)
    kept.write(CI.cache_table(s, d), START)
    low = F.col("user_id").cast("int") < 25
    for batch, mine in enumerate((low, ~low)):
        answers = CI.answers(s, d).where(mine)
        touched = kept.touched(answers)
        kept.write(C.cache_upsert(kept.read(s, batch, touched), answers, CI.now()), batch, touched)
        kept.forget(s, batch)
    return kept


enter(
    "cache_upsert_buckets",
    lambda s, d: cache_state(s, d).read(s, 2),
    f"{CI.BASE}, {CI.ANSWERS}, {CI.UPSERT.format(answers='answers')} SELECT * FROM upserted",
)


def incremental_features(s, d):
    """Features of the events after the cut, from summaries of the ones before it."""
    batch, old = split(T.txn_events(s, d))
    made = {"moments": S.group_moments(old), "amounts": S.amount_counts(old), "times": S.time_counts(old)}
    tables = {name: BucketedTable(fresh_path(s, name), df.schema, buckets=BUCKETS) for name, df in made.items()}
    for name, df in made.items():
        tables[name].write(df, START)
    touched = tables["moments"].touched(batch)
    return S.features_of_batch(batch, *(tables[name].read(s, 0, touched) for name in made))


enter(
    "features_from_summaries",
    lambda s, d: incremental_features(s, d).select(
        "transaction_id", *(F.round(c, 6).alias(c) for c in ("log_amount", "amount_zscore", "category_percentile")), "spending_freq_7d", "hour", "is_weekend"
    ),
    f"""WITH {T.TXN_EVENTS}, {CF.ML}, f AS ({CF.FEATURES}) SELECT transaction_id, log_amount, amount_zscore, category_percentile, spending_freq_7d, "hour", is_weekend
      FROM f JOIN txn ON txn.id = f.transaction_id WHERE created_at >= TIMESTAMP '{CUT}'""",
)
enter(
    "merged_stats",
    lambda s, d: S.stats_of(
        S.merge_moments(*(S.group_moments(R.ml_input(T.txn_orders(s, d)).where(F.col("transaction_id").cast("bigint") % 3 == i)) for i in range(3)))
    ).select("user_id", "category", "n_rows", F.round("mean_amount", 4).alias("mean_amount"), F.round("std_amount", 4).alias("std_amount"), "max_amount"),
    f"""WITH {T.TXN_ORDERS}, {CF.ML} SELECT user_id, category, count(*) AS n_rows, round(avg(amount), 4) AS mean_amount,
      round(stddev_samp(amount), 4) AS std_amount, max(amount) AS max_amount FROM ml GROUP BY user_id, category""",
)


# ---- stored transactions -----------------------------------------------------------------------------------


def stored(s, d):
    """Orders as a bucketed table; its name."""
    name = f"transactions_{uuid.uuid4().hex[:12]}"
    files.store_by_user(T.txn_orders(s, d), name, fresh_path(s, name), BUCKETS)
    return name


enter(
    "transactions_by_id_stored",
    lambda s, d: R.transactions_by_id(
        s.table(stored(s, d)), T.read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("user_id")).distinct()
    ).select("id", "user_id", "amount"),
    f"""WITH {T.TXN_ORDERS} SELECT id, user_id, amount FROM txn WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND CAST(l_suppkey AS VARCHAR) = user_id)""",
)


def _first_user(s, d):
    return T.txn_orders(s, d).agg(F.min("user_id")).first()[0]


enter(
    "list_transactions_stored",
    lambda s, d: R.list_transactions(s.table(stored(s, d)), _first_user(s, d)).select("id", "user_id", "merchant", "amount"),
    f"WITH {T.TXN_ORDERS} SELECT id, user_id, merchant, amount FROM txn WHERE user_id = (SELECT min(user_id) FROM txn)",
)


# ---- rows that do not fit ----------------------------------------------------------------------------------


def _damaged(s, d):
    """A CSV of labelled transactions, some of them short, without a date or without a number; written by Spark."""
    rows, k = T.labelled(s, d), F.col("transaction_id").cast("bigint")
    fields = [
        F.col("transaction_id"), F.col("user_id"), F.when(k % 17 == 3, "yesterday").otherwise(F.date_format("transaction_date", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.concat(F.lit('"'), F.col("merchant"), F.lit('"')), F.when(k % 19 == 4, "many").otherwise(F.col("amount").cast("string")), F.col("category"),
        F.col("transaction_type"), F.lit(""), F.col("is_anomaly").cast("string"),
    ]
    line = F.when(k % 23 == 5, F.concat_ws(",", *fields[:4])).otherwise(F.concat_ws(",", *fields))
    path = fresh_path(s, "damaged")
    rows.select(line.alias("value")).write.text(path)
    return files.scan_labelled_csv_checked(s, path, header=False)


BAD = "CAST(transaction_id AS BIGINT) % 17 = 3 OR CAST(transaction_id AS BIGINT) % 19 = 4 OR CAST(transaction_id AS BIGINT) % 23 = 5"
enter(
    "scan_transactions_checked",
    lambda s, d: _damaged(s, d)[0].select("transaction_id", "user_id", "transaction_date", "merchant", "amount", "is_anomaly"),
    f"WITH {T.LABELLED} SELECT transaction_id, user_id, transaction_date, merchant, amount, is_anomaly FROM labelled WHERE NOT ({BAD})",
)
enter(
    "scan_transactions_quarantine",
    lambda s, d: _damaged(s, d)[1].select(F.split(files.CORRUPT, ",")[0].alias("transaction_id")),
    f"WITH {T.LABELLED} SELECT transaction_id FROM labelled WHERE {BAD}",
)


# ---- manual entries ----------------------------------------------------------------------------------------


def manual_rows(s, d):
    """Orders as typed-in entries: some with a type of their own, some with one that does not exist."""
    k = F.col("row_no")
    given = F.when(k % 17 == 0, "transfer").when(k % 7 == 0, " Expense")
    return CI.import_rows(s, d).select(
        "user_id", k.alias("entry_no"), F.trim("description").alias("merchant"), "amount", F.lit("typed in").alias("notes"), given.alias("transaction_type"),
        F.timestamp_seconds(F.lit(1_717_200_000) + k).alias("created_at"),
    )


def manual(s, d):
    stored = T.txn_events(s, d).withColumn("user_id", (F.col("user_id").cast("bigint") % 50).cast("string")).withColumn("confidence", F.lit(1.0))
    return I.manual_entries(manual_rows(s, d), CI.cache_table(s, d), CI.answers(s, d), CI.categories(s, d), stored.select(*I.STORED), CI.now())


PAY = "category_name, normalized_category, confidence, reason"
MANUAL = f"""{CI.BASE}, {CI.ANSWERS}, entries AS (SELECT row_no, user_id, description, normalized_merchant, amount, CASE WHEN row_no % 7 = 0 THEN 'expense' ELSE transaction_type END AS given
    FROM typed WHERE row_no % 17 <> 0),
  looked AS (SELECT e.*, coalesce(a.transaction_type, b.transaction_type) AS cached_type, coalesce(a.category_name, b.category_name) AS c_name,
      coalesce(a.normalized_category, b.normalized_category) AS c_norm, coalesce(a.confidence, b.confidence) AS c_conf
    FROM entries e LEFT JOIN cache a ON a.user_id = e.user_id AND a.normalized_merchant = e.normalized_merchant AND a.transaction_type = e.given
    LEFT JOIN cache b ON b.user_id = e.user_id AND b.normalized_merchant = e.normalized_merchant AND b.transaction_type <> e.given),
  classified AS (SELECT l.row_no, l.user_id, l.description, l.normalized_merchant, l.amount, l.given, l.cached_type,
      coalesce(cached_type, answer_type, given) AS transaction_type, coalesce(c_name, category_name, 'Other') AS category_name,
      coalesce(c_norm, normalized_category, 'other') AS normalized_category, coalesce(c_conf, x.confidence, 0.0) AS confidence
    FROM looked l LEFT JOIN answers x ON x.user_id = l.user_id AND x.normalized_merchant = l.normalized_merchant AND x.transaction_type = l.given)"""
MANUAL_NAMED = f"""{MANUAL}, {CI.CATEGORIES}, {CI.RESOLVED.format(good='')},
  named AS (SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY row_no) AS id, k.*, c.id AS category_id, c.name AS cat
    FROM classified k JOIN all_categories c ON c.normalized_name = k.normalized_category AND c.transaction_type = k.transaction_type)"""
enter(
    "manual_entry",
    lambda s, d: manual(s, d)["transactions"].select("id", "entry_no", "user_id", "merchant", "amount", "transaction_type", "category_id", "category_name", "confidence"),
    f"""{MANUAL_NAMED} SELECT id, row_no AS entry_no, user_id, description AS merchant, abs(amount) AS amount, transaction_type, category_id, cat AS category_name, confidence FROM named""",
)
# The history is the newest 200 stored rows; entries do not crowd it out, so there is enough to judge by.
enter(
    "manual_entry_scores",
    lambda s, d: manual(s, d)["transactions"].select("id", "is_anomaly", "anomaly_status", "anomaly_reason"),
    f"""{MANUAL_NAMED}, h AS (SELECT * FROM (SELECT CAST(user_id % 50 AS VARCHAR) AS user_id, event_type, event_id,
        row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 200),
      facts AS (SELECT n.id, count(h.event_id) FILTER (event_type <> 'signup') AS n_expense, count(h.event_id) FILTER (event_type <> 'signup' AND event_type = n.cat) AS n_category
        FROM named n LEFT JOIN h ON h.user_id = n.user_id GROUP BY n.id)
      SELECT id, FALSE AS is_anomaly, CASE WHEN n_expense < 10 OR n_category < 5 THEN 'insufficient_history' END AS anomaly_status,
        CASE WHEN n_expense < 10 OR n_category < 5 THEN NULL ELSE 'Anomaly check unavailable during import' END AS anomaly_reason FROM facts""",
)
enter(
    "manual_entry_cache",
    lambda s, d: manual(s, d)["cache"],
    f"""{MANUAL}, asked AS (SELECT a.* FROM answers a WHERE EXISTS (SELECT 1 FROM looked l WHERE l.cached_type IS NULL AND l.user_id = a.user_id
        AND l.normalized_merchant = a.normalized_merchant AND l.given = a.transaction_type)), {CI.UPSERT.format(answers='asked')} SELECT * FROM upserted""",
)


# ---- an import that asks the model -------------------------------------------------------------------------

MERCHANT_CATEGORY = """m AS (SELECT user_id, merchant, transaction_type, arg_min(category_name, id) AS category_name FROM txn GROUP BY ALL)"""


def import_with_model(s, d):
    """Events after the cut as one import into those before it, scored by the forest where no safeguard applies."""
    txns = T.txn_events(s, d)
    key = ["user_id", "merchant", "transaction_type"]
    named = txns.groupBy(*key).agg(F.min_by("category_name", "id").alias("category_name"))
    cache = named.select(
        "user_id", F.lower("merchant").alias("normalized_merchant"), "transaction_type", "category_name", F.col("category_name").alias("normalized_category"),
        F.lit(1.0).alias("confidence"), F.lit("").alias("reason"), F.lit("ai").alias("source"), CI.now().alias("created_at"), CI.now().alias("updated_at"),
    )
    cut = F.lit(CUT).cast("timestamp")
    signed = F.when(F.col("transaction_type") == "expense", -F.col("amount")).otherwise(F.col("amount"))
    rows = txns.where(F.col("created_at") >= cut).select(
        (F.col("id") % 97).alias("upload_id"), "user_id", F.col("id").alias("row_no"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("transaction_date"),
        F.col("merchant").alias("description"), signed.alias("amount"), F.lit("").alias("raw_text"),
    )
    uploads = rows.select(F.col("upload_id").alias("id"), "user_id").distinct()
    categories = s.createDataFrame([], "id bigint, name string, normalized_name string, transaction_type string")
    none = CI.answers(s, d).limit(0)
    stored = txns.where(F.col("created_at") < cut).withColumn("confidence", F.lit(1.0)).select(*I.STORED)
    return I.import_transactions(rows, uploads, cache, none, categories, stored, CI.now(), scorer=CM.trained(s, d).scorer())["transactions"]


# Who decided and, where it was a safeguard, what; the forest's own verdicts have no SQL.
enter(
    "import_pipeline_model",
    lambda s, d: import_with_model(s, d).select(
        "row_no",
        F.when(F.col("ml_model_version").isNull(), F.col("anomaly_status")).otherwise("by model").alias("decided"),
        (F.col("anomaly_status").isNotNull() & (F.col("is_anomaly") == (F.col("anomaly_status") == "confirmed_anomaly"))).alias("agrees"),
    ),
    f"""WITH {T.TXN_EVENTS}, {MERCHANT_CATEGORY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM txn),
      h AS (SELECT * FROM ranked WHERE rn <= 200 AND created_at < TIMESTAMP '{CUT}'),
      b AS (SELECT t.* REPLACE (m.category_name AS category_name) FROM txn t JOIN m USING (user_id, merchant, transaction_type) WHERE created_at >= TIMESTAMP '{CUT}' AND amount <> 0), {AGAINST}
      SELECT transaction_id AS row_no, CASE WHEN {RULE} LIKE 'cold%' THEN 'insufficient_history' WHEN {RULE} IS NOT NULL THEN 'normal' ELSE 'by model' END AS decided, TRUE AS agrees FROM facts""",
)
