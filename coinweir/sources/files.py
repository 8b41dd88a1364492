"""Reading and writing tables, statement text and classifier answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from coinweir import schemas
from coinweir.functions.text import strip, strip_code_fences
from coinweir.session import cut_lineage


def scan_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled transactions from CSV, with a typed date and no schema inference."""
    return spark.read.schema(schemas.LABELLED).csv(path, header=True, timestampFormat="yyyy-MM-dd[ HH:mm:ss][.SSSSSS]", escape='"', multiLine=True)


CORRUPT = "corrupt_record"


def scan_labelled_csv_checked(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, the text of the others): short or long rows, unreadable dates and numbers."""
    schema = StructType([*schemas.LABELLED.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(schema).csv(
        path, header=header, timestampFormat="yyyy-MM-dd[ HH:mm:ss][.SSSSSS]", escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
    )
    rows = cut_lineage(rows)  # read whole once: Spark finds what does not fit in the columns that a query needs only
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select("transaction_id", CORRUPT)


def scan_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRANSACTIONS).parquet(path)


def write_dataset(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if file_format == "csv":
        writer.csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", escape='"')
    else:
        writer.format(file_format).save(path)


def scan_statement_lines(pages: DataFrame) -> DataFrame:
    """(statement_id, page_no, text) -> one row per line, in page order."""
    return pages.select(
        "statement_id", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\R")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def scan_statement_tables(pages: DataFrame) -> DataFrame:
    """(statement_id, page_no, tables array<array<array<string>>>) -> one row per table row; row 0 is the header."""
    tables = pages.select("statement_id", "page_no", F.posexplode("tables").alias("table_no", "rows"))
    rows = tables.select("statement_id", "page_no", "table_no", F.posexplode("rows").alias("row_no", "cells"))
    return rows.withColumns({"table_no": F.col("table_no").cast("bigint"), "row_no": F.col("row_no").cast("bigint")})


def ingest_json_rows(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of cleanup answers (statement_id, chunk_no, body); a chunk without a usable one keeps its own rows.

    A row without one of its fields, or with an amount that is no number, is skipped on its own.
    """
    parsed = answers.withColumn("_rows", F.from_json(strip_code_fences("body"), schemas.CLEANUP_ANSWER)["transactions"])
    row = F.explode("_rows").alias("r")
    usable = parsed.where(F.col("_rows").isNotNull()).select("statement_id", "chunk_no", row)
    given = F.lower(strip("r.transaction_type"))
    fields = ["transaction_date", "description", "raw_text"]
    rows = usable.select(
        "statement_id",
        "chunk_no",
        *[F.col(f"r.{name}").alias(name) for name in fields],
        F.col("r.amount").try_cast("double").alias("amount"),
        F.nullif(given, F.lit("")).alias("transaction_type"),
    ).dropna(subset=[*fields, "amount"])
    answered = parsed.where(F.col("_rows").isNotNull()).select("statement_id", "chunk_no")
    fallback = chunks.join(answered, ["statement_id", "chunk_no"], "left_anti").select(
        "statement_id", "chunk_no", *fields, "amount", F.lit(None).cast("string").alias("transaction_type")
    )
    return rows.unionByName(fallback)


def append_transactions(rows: DataFrame, path: str) -> None:
    """Append good rows to the stored transactions."""
    rows.write.mode("append").parquet(path)


def store_by_user(txns: DataFrame, name: str, path: str, buckets: int = 256) -> None:
    """Transactions as table `name` at `path`, in hash buckets of the user, newest first, with a Bloom filter of the ids.

    A user's list or one transaction is looked up in one bucket, and joins and groups by user need no shuffle.
    """
    (
        txns.repartition(buckets, "user_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "user_id")
        .sortBy("user_id", "created_at")
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("path", path)
        .saveAsTable(name)
    )
