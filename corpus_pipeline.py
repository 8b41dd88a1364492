"""From raw documents to token ids: language, quality, near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. The
models of the first two stages are fitted on the raw tables in sf_dir and applied to every row of `docs`.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinweir.llm import bpe, decontam, jaccard, langid, quality
from coinweir.llm.common import bit_map, bit_test, cell, map_batches, rows_where, table, written


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a 64-bit key of each row's id and text, either of which may be null, and the key's name, which no
    other column has: equal rows have one key, others their own but for collisions of the hash."""
    name = next(n for n in ("row_key", *(f"row_key_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")), name


def _parts(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Rows of `docs` whose key is not in `keys` (row_key) for sure, and the others with their key, and its name.

    Texts are not shuffled for it: a bit map of fixed size tells them apart, and only the others need be joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(keys.select(cell(F.col("row_key")).alias("c")), "c"))
    keyed, name = _keyed(docs)
    marked = keyed.select("*", cell(F.col(name)))  # the last column, whatever its name

    def part(meant: bool):
        def run(batches):
            for batch in batches:
                found = bit_test(np.frombuffer(shared.value, np.uint8), batch.column(batch.num_columns - 1).to_numpy().astype(np.int64))
                kept = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
                yield kept.filter(pa.array(found == meant))

        return map_batches(marked, run, keyed.schema)

    return part(False).drop(name), part(True), name


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `docs` whose key is not in `keys` (row_key)."""
    keys = written(keys.distinct(), "dropped")
    rest, others, name = _parts(docs, keys)
    left = others.join(keys.withColumnRenamed("row_key", name), name, "left_anti")
    return rest.unionByName(left.select(*docs.columns))


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each of the repeated `keys`, and all other rows. Repeats meet within a task before they are moved."""
    keys = written(keys, "repeated")
    if keys.isEmpty():
        return docs
    rest, others, name = _parts(docs, keys)
    return rest.unionByName(others.dropDuplicates([name]).select(*docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    model = langid.fit(table(spark, sf_dir, "documents"))
    if model is None:
        return docs.limit(0)
    return langid.without_rejected(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    shared = spark.sparkContext.broadcast(model)
    return rows_where(docs, lambda raw: shared.value.judge(raw)[1] >= 0.5)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of the document with the smallest id of each group of near duplicates.

    Rows are told apart by id and text, so an id with two texts is two documents. A document without an id counts as
    the last of its group.
    """
    keyed, name = _keyed(docs)
    keyed = keyed.select(F.col(name).alias("row_key"), "doc_id", "text")
    found = jaccard.jaccard_components(keyed, id_column="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    ids = keyed.groupBy("row_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id")).alias("id"), F.count(F.lit(1)).alias("n"))
    rows = written(ids.join(found.distinct(), "row_key"), "rows")
    kept = rows.groupBy("component_id").agg(F.min(F.struct("id", "row_key", "n")).alias("first")).select("first.row_key", "first.n")
    kept = written(kept, "kept")
    left = _without(docs, rows.select("row_key").join(kept.select("row_key"), "row_key", "left_anti"))
    return _once(left, kept.where("n > 1").select("row_key"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    keyed, name = _keyed(docs)
    keyed = keyed.select(F.col(name).alias("row_key"), "text")
    found = decontam.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_column="row_key")
    return _without(docs, found.where("n_hit > 0").select(F.col("doc_id").alias("row_key")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers) and their number."""
    found = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "ids", (F.length("ids") / 4).cast("bigint").alias("n_tokens"))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

ORACLE_SQL = None  # the fitted models cannot be expressed in SQL; tests/llm compares the stages with their operators and a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
