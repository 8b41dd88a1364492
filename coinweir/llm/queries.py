"""One query for each operator, over whole tables, with its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinweir.llm import bpe, clustering, collocations, decontam, jaccard, langid, lm_scores, quality, superminhash, token_counts, token_files, topk, urls
from coinweir.llm import checks as K
from coinweir.llm.common import fold, table
from coinweir.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

# fixed values of the query contracts
QUALITY_FOLDS, QUALITY_HELD_OUT = 3, 1
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 5, 0
END_ID = 2
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold("doc_id", QUALITY_FOLDS) == QUALITY_HELD_OUT
    model = quality.fit(docs, table(spark, folder, "labels").where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "difference")


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode_decode(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def token_files_read_back(spark: SparkSession, folder: str) -> DataFrame:
    files = fresh_path(spark, "tokens")
    token_files.write_token_files(table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.with_checksums(token_files.read_token_files(spark, files))


def top_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"), words=3, percent=90)


def backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores.score_documents(table(spark, folder, "documents"))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def document_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"), URL_RULES)


def vector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(table(spark, folder, "embeddings"), k=40, rounds=5, dim=64, salt="2:")


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), max_words=3, least=10, hold=50, first=2000)


def minhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, folder, "documents"), words=4, percent=80)


QUERIES: dict[str, Query] = {
    "op1_quality_compression": quality_scores,
    "op2_bpe_round_trip": bpe_round_trip,
    "op3_token_orc": token_files_read_back,
    "op4_exact_topk": top_products,
    "op5_ngram_jaccard": near_duplicates,
    "op6_stupid_backoff": backoff_scores,
    "op7_language_centroids": languages,
    "op8_benchmark_windows": benchmark_hits,
    "op9_token_counts": document_token_counts,
    "op10_url_filter": url_verdicts,
    "op11_orchard_clusters": vector_clusters,
    "op12_phrase_collocations": phrase_collocations,
    "op13_superminhash": minhash_groups,
}
CHECKS: dict[str, str] = {
    "op4_exact_topk": K.TOP_PRODUCTS,
    "op5_ngram_jaccard": K.near_duplicates(3, 90),
    "op8_benchmark_windows": K.BENCHMARK_HITS,
    "op11_orchard_clusters": K.clusters(40, 5),
    "op12_phrase_collocations": K.COLLOCATIONS,
    "op13_superminhash": f"SELECT *, doc_id = component_id AS kept FROM ({K.near_duplicates(4, 80)})",
}
