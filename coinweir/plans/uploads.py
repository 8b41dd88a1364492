"""An upload from its pages to the preview that its user approves, for any number of uploads at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.plans import statements as P
from coinweir.session import cut_lineage
from coinweir.sources.files import ingest_json_rows

PREVIEW = ["statement_id", "transaction_date", "description", "amount", "raw_text"]


def upload_preview(lines: DataFrame, tables: DataFrame, answers: DataFrame, ref_year: int, chunk: int = V.CLEANUP_CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of the previews, one row of status and totals per upload).

    Parsed rows are cut into chunks of `chunk`; `answers` (statement_id, chunk_no, body) are the cleaner's JSON for
    them. A chunk without a usable answer keeps its own rows, signs follow the answers' types, and an upload from which
    too much was removed keeps what was parsed. An upload without a row is `parse_failed`, with the reason.
    """
    parsed, outcome = P.parse_statements(lines, tables, ref_year)  # rows that are written already
    cleaned = ingest_json_rows(answers, P.chunk_rows(parsed, chunk))
    rows = cut_lineage(P.cleanup_apply(parsed, cut_lineage(cleaned)).withColumn("transaction_date", F.col("transaction_date").try_cast("date")))
    spent, size = F.col("amount") < 0, F.abs("amount")
    totals = rows.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count(F.when(spent, 1)).alias("expense_count"),
        F.count(F.when(~spent, 1)).alias("income_count"),
        F.round(F.sum(F.when(spent, size)), 2).alias("total_expense"),
        F.round(F.sum(F.when(~spent, size)), 2).alias("total_income"),
    )
    none = {name: 0 for name in ("total_transactions", "expense_count", "income_count")} | {"total_expense": 0.0, "total_income": 0.0}
    uploads = outcome.join(totals, "statement_id", "left").na.fill(none)
    empty = F.col("total_transactions") == 0
    return rows.select(*PREVIEW), uploads.select(
        "statement_id",
        "statement_type",
        F.col("strategy").alias("parse_strategy"),
        F.when(empty, "parse_failed").otherwise("parsed").alias("status"),
        *none,
        F.when(empty, F.col("strategy")).alias("parse_error"),
    )
