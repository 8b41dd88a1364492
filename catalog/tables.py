"""The driver's tables as transactions and statement rows, in Spark and, with the same meaning, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def merchant_letter(number: Column) -> Column:
    return F.concat(F.lit("MERCHANT "), F.char(65 + number % 26))


# ---- events ------------------------------------------------------------------------------------------------

CATEGORY_ID_SQL = "CASE {0} WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END"

TXN_EVENTS = f"""txn AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id,
         'MERCHANT ' || chr(CAST(65 + k % 26 AS INTEGER)) AS merchant, value AS amount,
         event_type AS category_name, CAST({CATEGORY_ID_SQL.format('event_type')} AS BIGINT) AS category_id,
         CASE WHEN event_type = 'signup' THEN 'income' ELSE 'expense' END AS transaction_type,
         ts AS created_at, '' AS notes, '' AS reason, k
  FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


def events_as_transactions(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    ids = F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        merchant_letter(k).alias("merchant"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("category_name"),
        ids.cast("bigint").alias("category_id"),
        F.when(F.col("event_type") == "signup", "income").otherwise("expense").alias("transaction_type"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.lit("").alias("notes"),
        F.lit("").alias("reason"),
        k.alias("k"),
    )


def txn_events(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_transactions(read(spark, folder, "events"))


TXN_FLAGGED = TXN_EVENTS + """, flagged AS (
  SELECT *, category_name IN ('error', 'purchase') AS is_anomaly,
         CASE k % 4 WHEN 0 THEN 'confirmed_anomaly' WHEN 1 THEN NULL WHEN 2 THEN 'normal' ELSE 'insufficient_history' END AS anomaly_status,
         CASE WHEN k % 10 = 0 THEN NULL ELSE k / 100.0::DOUBLE END AS anomaly_score,
         CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '' ELSE 'High amount' END AS anomaly_reason
  FROM txn)"""


def txn_flagged(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    return txn_events(spark, folder).withColumns(
        {
            "is_anomaly": F.col("category_name").isin("error", "purchase"),
            "anomaly_status": F.when(k % 4 == 0, "confirmed_anomaly")
            .when(k % 4 == 2, "normal")
            .when(k % 4 == 3, "insufficient_history"),
            "anomaly_score": F.when(k % 10 != 0, k / F.lit(100.0)),
            "anomaly_reason": F.when(k % 3 == 1, "").when(k % 3 == 2, "High amount"),
        }
    )


# ---- orders ------------------------------------------------------------------------------------------------

TXN_ORDERS = """txn AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS user_id,
         'MERCHANT ' || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) AS merchant, o_totalprice AS amount,
         o_orderpriority AS category_name, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS category_id,
         CASE WHEN o_orderstatus = 'O' THEN 'income' ELSE 'expense' END AS transaction_type,
         o_orderdate AS created_at, '' AS notes, '' AS reason
  FROM orders)"""


def txn_orders(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        merchant_letter(F.col("o_orderkey")).alias("merchant"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category_name"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("category_id"),
        F.when(F.col("o_orderstatus") == "O", "income").otherwise("expense").alias("transaction_type"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.lit("").alias("notes"),
        F.lit("").alias("reason"),
    )


def with_part(orders: DataFrame, part: DataFrame) -> DataFrame:
    """Each order with one part, by its key modulo the number of parts; their keys count from 0."""
    n = part.agg(F.count(F.lit(1))).scalar()
    return orders.withColumn("_part", F.pmod("o_orderkey", n)).join(part, F.col("_part") == F.col("p_partkey")).drop("_part")


# ---- line items --------------------------------------------------------------------------------------------

TXN_LINEITEM = """txn AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS user_id, l_extendedprice AS amount, l_returnflag AS category_name,
         CASE WHEN l_linestatus = 'O' THEN 'income' ELSE 'expense' END AS transaction_type, l_shipdate AS created_at
  FROM lineitem)"""


def txn_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("user_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("category_name"),
        F.when(F.col("l_linestatus") == "O", "income").otherwise("expense").alias("transaction_type"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


# ---- raw merchants -----------------------------------------------------------------------------------------

RAW_MERCHANTS = """raw_merchants AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, upper(p_name) || ' #' || p_partkey AS raw, p_name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def raw_merchants(spark: SparkSession, folder: str) -> DataFrame:
    part = read(spark, folder, "part").select("p_partkey", "p_name")
    items = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return items.join(part, items.l_partkey == part.p_partkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.concat(F.upper("p_name"), F.lit(" #"), F.col("p_partkey")).alias("raw"),
        "p_name",
    )


# ---- labelled sets -----------------------------------------------------------------------------------------

LABELLED = TXN_EVENTS + """, labelled AS (
  SELECT CAST(id AS VARCHAR) AS transaction_id, user_id, created_at AS transaction_date, merchant, amount,
         category_name AS category, transaction_type,
         CASE k % 5 WHEN 0 THEN 'Card Test micro-charge' WHEN 1 THEN 'duplicate charge' WHEN 2 THEN 'silent fraud blended'
                    WHEN 3 THEN '' ELSE NULL END AS notes,
         CAST(CASE WHEN amount > 100 THEN 1 ELSE 0 END AS INTEGER) AS is_anomaly
  FROM txn)"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    return txn_events(spark, folder).select(
        F.col("id").cast("string").alias("transaction_id"),
        "user_id",
        F.col("created_at").alias("transaction_date"),
        "merchant",
        "amount",
        F.col("category_name").alias("category"),
        "transaction_type",
        F.when(k % 5 == 0, "Card Test micro-charge")
        .when(k % 5 == 1, "duplicate charge")
        .when(k % 5 == 2, "silent fraud blended")
        .when(k % 5 == 3, "")
        .alias("notes"),
        F.when(F.col("amount") > 100, 1).otherwise(0).cast("int").alias("is_anomaly"),
    )


PREDICTIONS = """predictions AS (SELECT doc_id, toxic AS y_true, 1 - quality AS y_pred FROM labels)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "labels").select(
        "doc_id", F.col("toxic").alias("y_true"), (1 - F.col("quality")).alias("y_pred")
    )
