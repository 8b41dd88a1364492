"""Cache, categories and the import job, over orders as import rows."""

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.book import enter
from coinweir.functions.text import normalize_merchant
from coinweir.operators import cache as C
from coinweir.operators import validation
from coinweir.plans import imports as I
from coinweir.session import cut_lineage

NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def named_parts(s, d):
    return T.read(s, d, "part").select("p_partkey", "p_name")


def import_rows(s, d):
    orders, k = T.read(s, d, "orders"), F.col("o_orderkey")
    return T.with_part(orders, named_parts(s, d)).select(
        (F.col("o_custkey") % 97).alias("upload_id"),
        (F.col("o_custkey") % 50).cast("string").alias("user_id"),
        k.alias("row_no"),
        F.when(k % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("transaction_date"),
        F.when(k % 29 == 0, F.concat(F.lit("#"), k)).when(k % 31 == 0, " ").otherwise(F.concat(F.upper("p_name"), F.lit(" #"), k)).alias("description"),
        F.when(k % 13 == 0, 0.0).when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
        F.lit("").alias("raw_text"),
    )


ROWS = """rows AS (SELECT o_custkey % 97 AS upload_id, CAST(o_custkey % 50 AS VARCHAR) AS user_id, o_orderkey AS row_no,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS created_at,
    CASE WHEN o_orderkey % 29 = 0 THEN '#' || o_orderkey WHEN o_orderkey % 31 = 0 THEN '' ELSE upper(p_name) || ' #' || o_orderkey END AS description,
    CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 THEN '' ELSE lower(p_name) END AS normalized_merchant,
    CASE WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount
  FROM orders JOIN part ON o_orderkey % (SELECT count(*) FROM part) = p_partkey),
  typed AS (SELECT *, CASE WHEN amount < 0 THEN 'expense' ELSE 'income' END AS transaction_type,
    description = '' OR amount = 0 OR created_at IS NULL AS bad FROM rows)"""


def keyed(s, d):
    rows = import_rows(s, d).withColumn("normalized_merchant", normalize_merchant("description"))
    return rows.withColumn("transaction_type", F.when(F.col("amount") < 0, "expense").otherwise("income"))


def cache_table(s, d):
    part = T.read(s, d, "part").select("p_partkey", F.lower("p_name").alias("normalized_merchant"))
    items = T.read(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus")
    n = F.length("normalized_merchant")
    return (
        items.join(part, items.l_partkey == part.p_partkey)
        .select(
            (F.col("l_suppkey") % 50).cast("string").alias("user_id"),
            "normalized_merchant",
            F.when(F.col("l_linestatus") == "O", "income").otherwise("expense").alias("transaction_type"),
        )
        .where("user_id <> '7' AND (length(normalized_merchant) + cast(user_id as int)) % 3 <> 0")
        .distinct()
        .select(
            *C.KEY,
            F.concat(F.lit("Cat "), n).alias("category_name"),
            F.concat(F.lit("cat_"), n).alias("normalized_category"),
            (n % 10 / F.lit(10.0)).alias("confidence"),
            F.lit("cached").alias("reason"),
            F.lit("ai").alias("source"),
            F.lit("2024-01-01").cast("timestamp").alias("created_at"),
            F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
        )
    )


CACHE = """cache AS (SELECT user_id, normalized_merchant, transaction_type, 'Cat ' || length(normalized_merchant) AS category_name,
    'cat_' || length(normalized_merchant) AS normalized_category, length(normalized_merchant) % 10 / 10.0::DOUBLE AS confidence, 'cached' AS reason, 'ai' AS source,
    TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at
  FROM (SELECT DISTINCT CAST(l_suppkey % 50 AS VARCHAR) AS user_id, lower(p_name) AS normalized_merchant, CASE WHEN l_linestatus = 'O' THEN 'income' ELSE 'expense' END AS transaction_type
    FROM lineitem JOIN part ON l_partkey = p_partkey)
  WHERE user_id <> '7' AND (length(normalized_merchant) + CAST(user_id AS INTEGER)) % 3 <> 0)"""


def answers(s, d):
    """Classifier answers for most keys; some disagree with the sign, some have no confidence."""
    n = F.length("normalized_merchant")
    return (
        C.distinct_keys(keyed(s, d), "row_no")
        .where((n % 4 != 1) | (F.col("normalized_merchant") == ""))
        .select(
            *C.KEY,
            F.when(n % 5 == 0, "expense").otherwise(F.col("transaction_type")).alias("answer_type"),
            F.concat(F.lit("New "), n % 6).alias("category_name"),
            F.concat(F.lit("new_"), n % 6).alias("normalized_category"),
            (n % 4 / F.lit(4.0)).alias("confidence"),
            F.lit("asked").alias("reason"),
            F.col("first_seen").alias("answer_no"),
        )
    )


ANSWERS = """answers AS (SELECT user_id, normalized_merchant, transaction_type, CASE WHEN length(normalized_merchant) % 5 = 0 THEN 'expense' ELSE transaction_type END AS answer_type,
    'New ' || length(normalized_merchant) % 6 AS category_name, 'new_' || length(normalized_merchant) % 6 AS normalized_category, length(normalized_merchant) % 4 / 4.0::DOUBLE AS confidence,
    'asked' AS reason, min(row_no) AS answer_no FROM typed WHERE length(normalized_merchant) % 4 <> 1 OR normalized_merchant = '' GROUP BY 1, 2, 3)"""
KEYS = "user_id, normalized_merchant, transaction_type"
RESULTS = f"""results AS (SELECT {KEYS}, category_name, normalized_category, confidence, reason FROM cache
  UNION ALL SELECT {KEYS}, category_name, normalized_category, confidence, reason FROM answers a
    WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.user_id = a.user_id AND c.normalized_merchant = a.normalized_merchant AND c.transaction_type = a.transaction_type)),
  classified AS (SELECT t.*, coalesce(r.category_name, 'Other') AS category_name, coalesce(r.normalized_category, 'other') AS normalized_category,
    coalesce(r.confidence, 0.0) AS confidence, coalesce(r.reason, 'AI classification unavailable during import') AS reason
    FROM typed t LEFT JOIN results r USING ({KEYS}))"""


def categories(s, d):
    n = F.length("p_name")
    return T.read(s, d, "part").select(
        n.cast("bigint").alias("id"), F.concat(F.lit("Cat "), n).alias("name"), F.concat(F.lit("cat_"), n).alias("normalized_name"), F.lit("expense").alias("transaction_type")
    ).distinct()


CATEGORIES = """categories AS (SELECT DISTINCT CAST(length(p_name) AS BIGINT) AS id, 'Cat ' || length(p_name) AS name, 'cat_' || length(p_name) AS normalized_name, 'expense' AS transaction_type FROM part)"""
RESOLVED = """wanted AS (SELECT normalized_category AS normalized_name, transaction_type, arg_min(category_name, row_no) AS name FROM classified {good} GROUP BY 1, 2),
  added AS (SELECT (SELECT max(id) FROM categories) + row_number() OVER (ORDER BY normalized_name, transaction_type) AS id, name, normalized_name, transaction_type
    FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.normalized_name = w.normalized_name AND c.transaction_type = w.transaction_type)),
  all_categories AS (SELECT id, name, normalized_name, transaction_type FROM categories UNION ALL SELECT * FROM added)"""
BASE = f"WITH {ROWS}, {CACHE}"

enter(
    "cache_join",
    lambda s, d: C.cache_join(keyed(s, d), cache_table(s, d), F.col("row_no")).select("row_no", "cache_hit", "category_name", "confidence"),
    f"{BASE} SELECT row_no, c.user_id IS NOT NULL AS cache_hit, category_name, confidence FROM typed t LEFT JOIN cache c USING ({KEYS})",
)
ALT = "CASE WHEN transaction_type = 'expense' THEN 'income' ELSE 'expense' END"
enter(
    "cache_join_alt_type",
    lambda s, d: C.cache_join_alt_type(keyed(s, d), cache_table(s, d), F.col("row_no")).select("row_no", "cached_type", "category_name"),
    f"""{BASE} SELECT row_no, coalesce(a.transaction_type, b.transaction_type) AS cached_type, coalesce(a.category_name, b.category_name) AS category_name
      FROM typed t LEFT JOIN cache a ON a.user_id = t.user_id AND a.normalized_merchant = t.normalized_merchant AND a.transaction_type = t.transaction_type
      LEFT JOIN cache b ON b.user_id = t.user_id AND b.normalized_merchant = t.normalized_merchant AND b.transaction_type <> t.transaction_type""",
)
enter("distinct_keys", lambda s, d: C.distinct_keys(keyed(s, d), "row_no"), f"{BASE} SELECT {KEYS}, min(row_no) AS first_seen FROM typed GROUP BY {KEYS}")
enter("cache_misses", lambda s, d: C.cache_misses(keyed(s, d), cache_table(s, d)), f"{BASE} SELECT {KEYS} FROM typed EXCEPT SELECT {KEYS} FROM cache")
enter("cache_hits", lambda s, d: C.cache_hits(keyed(s, d), cache_table(s, d)), f"{BASE} SELECT {KEYS} FROM typed INTERSECT SELECT {KEYS} FROM cache")
enter(
    "representative_rows",
    lambda s, d: C.representative_rows(keyed(s, d), cache_table(s, d), "row_no").select(*C.KEY, "row_no", F.trim("description").alias("description")),
    f"""{BASE} SELECT {KEYS}, row_no, description FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY row_no) AS rn FROM typed) t
      WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.user_id = t.user_id AND c.normalized_merchant = t.normalized_merchant AND c.transaction_type = t.transaction_type)""",
)
enter(
    "cache_stats",
    lambda s, d: C.cache_stats(keyed(s, d), cache_table(s, d)),
    f"""{BASE}, k AS (SELECT {KEYS}, count(*) AS n FROM typed GROUP BY {KEYS}) SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_keys,
      count(c.confidence) AS hits, count(*) - count(c.confidence) AS misses FROM k LEFT JOIN cache c USING ({KEYS})""",
)
enter(
    "broadcast_results_back",
    lambda s, d: C.broadcast_results_back(keyed(s, d), C.merge_results(cache_table(s, d), answers(s, d)), F.col("row_no")).select(
        "row_no", "category_name", "normalized_category", "confidence", "reason"
    ),
    f"{BASE}, {ANSWERS}, {RESULTS} SELECT row_no, category_name, normalized_category, confidence, reason FROM classified",
)
UPSERT = f"""fresh AS (SELECT user_id, normalized_merchant, answer_type AS transaction_type, category_name, normalized_category, confidence, reason, 'ai' AS source,
    TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at, 1 AS age, answer_no FROM {{answers}} WHERE normalized_merchant <> '' AND confidence > 0),
  pool AS (SELECT *, 0 AS age, 0 AS answer_no FROM cache UNION ALL SELECT * FROM fresh),
  ranked AS (SELECT *, min(created_at) OVER (PARTITION BY {KEYS}) AS born, row_number() OVER (PARTITION BY {KEYS} ORDER BY confidence DESC, age, answer_no) AS rn FROM pool),
  upserted AS (SELECT {KEYS}, category_name, normalized_category, confidence, reason, source, updated_at, born AS created_at FROM ranked WHERE rn = 1)"""
enter(
    "cache_upsert",
    lambda s, d: C.cache_upsert(cache_table(s, d), answers(s, d), now()),
    f"{BASE}, {ANSWERS}, {UPSERT.format(answers='answers')} SELECT * FROM upserted",
)


def _requests(s, d):
    rows = C.broadcast_results_back(cut_lineage(keyed(s, d)), C.merge_results(cache_table(s, d), answers(s, d)), F.col("row_no"))
    return rows.select(F.col("normalized_category").alias("normalized_name"), "transaction_type", F.col("category_name").alias("name"), "row_no")


enter(
    "category_resolve",
    lambda s, d: C.category_resolve(_requests(s, d), categories(s, d), "row_no")[1],
    f"""{BASE}, {ANSWERS}, {RESULTS}, {CATEGORIES}, {RESOLVED.format(good='')} SELECT w.normalized_name, w.transaction_type, c.id AS category_id, c.name AS resolved_name
      FROM wanted w JOIN all_categories c USING (normalized_name, transaction_type)""",
)
enter(
    "category_union",
    lambda s, d: C.category_resolve(_requests(s, d), categories(s, d), "row_no")[0],
    f"{BASE}, {ANSWERS}, {RESULTS}, {CATEGORIES}, {RESOLVED.format(good='')} SELECT * FROM all_categories",
)


def uploads(s, d):
    k = F.col("c_custkey")
    return T.read(s, d, "customer").where("c_custkey % 97 <> 5").select((k % 97).alias("id"), (k % 50).cast("string").alias("user_id")).distinct()


UPLOADS = "uploads AS (SELECT DISTINCT c_custkey % 97 AS id, CAST(c_custkey % 50 AS VARCHAR) AS user_id FROM customer WHERE c_custkey % 97 <> 5)"
OWNED = "EXISTS (SELECT 1 FROM uploads u WHERE u.id = upload_id AND u.user_id = {0}.user_id)"
enter(
    "owner_check",
    lambda s, d: C.owner_check(import_rows(s, d), uploads(s, d))[0].select("upload_id", "user_id", "row_no"),
    f"WITH {ROWS}, {UPLOADS} SELECT upload_id, user_id, row_no FROM rows WHERE {OWNED.format('rows')}",
)
enter(
    "import_counts",
    lambda s, d: C.import_counts(validation.validate_import_rows(import_rows(s, d))),
    f"""WITH {ROWS} SELECT upload_id, count(*) AS total_transactions, count(*) FILTER (NOT bad) AS imported_transactions,
      count(*) FILTER (bad) AS failed_transactions, 'imported' AS status FROM typed GROUP BY upload_id""",
)
enter(
    "concat_users",
    lambda s, d: C.concat_users([T.txn_events(s, d).drop("k"), T.txn_orders(s, d)]).groupBy("transaction_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")),
    f"""WITH a AS (WITH {T.TXN_EVENTS} SELECT user_id, transaction_type FROM txn), b AS (WITH {T.TXN_ORDERS} SELECT user_id, transaction_type FROM txn)
      SELECT transaction_type, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
)


def run_import(s, d):
    stored = T.txn_events(s, d).withColumn("confidence", F.lit(1.0)).select(*I.STORED)
    return I.import_transactions(import_rows(s, d), uploads(s, d), cache_table(s, d), answers(s, d), categories(s, d), stored, now())


GOOD = f"""{BASE}, {UPLOADS}, {ANSWERS}, {RESULTS}, {CATEGORIES}, {RESOLVED.format(good="WHERE NOT bad AND " + OWNED.format("classified"))},
  imported AS (SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY upload_id, row_no) AS id, k.* FROM classified k WHERE NOT bad AND {OWNED.format('k')})"""
enter(
    "import_pipeline",
    lambda s, d: run_import(s, d)["transactions"].select(
        "id", "user_id", "merchant", "amount", "transaction_type", "category_id", "category_name", "confidence", "reason", "created_at"
    ),
    f"""{GOOD} SELECT i.id, i.user_id, description AS merchant, abs(amount) AS amount, i.transaction_type, c.id AS category_id, c.name AS category_name, confidence, reason, created_at
      FROM imported i JOIN all_categories c ON c.normalized_name = i.normalized_category AND c.transaction_type = i.transaction_type""",
)
# The newest 200 rows of a user, new rows included, leave little history behind: mostly cold starts (the limit comes first).
enter(
    "import_pipeline_scores",
    lambda s, d: run_import(s, d)["transactions"].select("id", "is_anomaly", "anomaly_status", "anomaly_reason"),
    f"""{GOOD}, named AS (SELECT i.*, c.name AS cat FROM imported i JOIN all_categories c ON c.normalized_name = i.normalized_category AND c.transaction_type = i.transaction_type),
      pool AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, value AS amount, event_type AS category_name, CASE WHEN event_type = 'signup' THEN 'income' ELSE 'expense' END AS transaction_type, ts AS created_at, FALSE AS fresh FROM events
        UNION ALL SELECT id, user_id, abs(amount), cat, transaction_type, created_at, TRUE FROM named),
      h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM pool) WHERE rn <= 200 AND NOT fresh),
      facts AS (SELECT n.id, count(h.id) FILTER (h.transaction_type = 'expense') AS n_expense, count(h.id) FILTER (h.transaction_type = 'expense' AND h.category_name = n.cat) AS n_category
        FROM named n LEFT JOIN h ON h.user_id = n.user_id GROUP BY n.id)
      SELECT id, FALSE AS is_anomaly, CASE WHEN n_expense < 10 OR n_category < 5 THEN 'insufficient_history' END AS anomaly_status,
        CASE WHEN n_expense < 10 OR n_category < 5 THEN NULL ELSE 'Anomaly check unavailable during import' END AS anomaly_reason FROM facts""",
)
enter(
    "import_pipeline_cache",
    lambda s, d: run_import(s, d)["cache"],
    f"""{GOOD}, asked AS (SELECT a.* FROM answers a WHERE EXISTS (SELECT 1 FROM imported i WHERE i.user_id = a.user_id AND i.normalized_merchant = a.normalized_merchant AND i.transaction_type = a.transaction_type)
        AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.user_id = a.user_id AND c.normalized_merchant = a.normalized_merchant AND c.transaction_type = a.transaction_type)),
      {UPSERT.format(answers='asked')} SELECT * FROM upserted""",
)
enter(
    "import_pipeline_uploads",
    lambda s, d: run_import(s, d)["uploads"],
    f"""WITH {ROWS}, {UPLOADS} SELECT upload_id, count(*) AS total_transactions, count(*) FILTER (NOT bad) AS imported_transactions,
      count(*) FILTER (bad) AS failed_transactions, 'imported' AS status FROM typed WHERE {OWNED.format('typed')} GROUP BY upload_id""",
)
enter(
    "import_pipeline_quarantine",
    lambda s, d: run_import(s, d)["quarantine"].select("upload_id", "row_no", "error"),
    f"""WITH {ROWS}, {UPLOADS} SELECT upload_id, row_no, CASE WHEN description = '' THEN 'description is empty' WHEN amount = 0 THEN 'amount is zero' ELSE 'invalid transaction_date' END AS error
      FROM typed WHERE bad AND {OWNED.format('typed')}""",
)
