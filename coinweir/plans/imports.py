"""Import of approved preview rows, for any number of uploads at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.functions.text import normalize_merchant
from coinweir.operators import anomaly as A
from coinweir.operators import cache as C
from coinweir.operators import summaries, validation
from coinweir.plans.skew import attach, sorted_index
from coinweir.session import cut_lineage, written_once

STORED = [
    "id", "user_id", "merchant", "amount", "notes", "transaction_type", "category_id", "category_name", "confidence",
    "reason", "created_at",
]
SCORE_COLUMNS = ["is_anomaly", "anomaly_status", "anomaly_score", "anomaly_reason", "ml_model_version"]


def score_inserted(inserted: DataFrame, stored: DataFrame, scorer=None, exclude_first: bool = False, profile: DataFrame | None = None) -> DataFrame:
    """Anomaly columns of new rows against the history before the import.

    `scorer(batch, history)` decides the rows no safeguard covers; without one, and for rows that it leaves out, the
    fallback reason stands. `exclude_first` takes the new rows out of the history before its limit, not after. Without a
    scorer, a `profile` of the new rows' users (`profile_before`) stands for their history.
    """
    as_input = lambda df, *more: df.select(
        F.col("id").alias("transaction_id"), "user_id", F.col("created_at").alias("transaction_date"), "merchant", "amount",
        F.col("category_name").alias("category"), "transaction_type", "notes", *more,
    )
    if scorer is not None or profile is None:
        pool = stored.select(*STORED).unionByName(inserted.select(*STORED))
        history = as_input(A.history_exclude_batch(pool, inserted, exclude_first=exclude_first))
    if scorer is None:
        # Rows are scored as they are: nothing has to be joined back to them.
        batch = as_input(inserted, F.struct(*inserted.columns).alias("_row"))
        guarded = A.group_safeguards(batch, A.history_profile(history) if profile is None else profile)
        settled = F.col("anomaly_status").isNotNull()
        return guarded.select(
            "_row.*",
            F.lit(False).alias("is_anomaly"),
            "anomaly_status",
            F.when(settled, F.lit(0.0)).alias("anomaly_score"),
            F.when(~settled, F.lit(V.ANOMALY_FALLBACK_REASON)).alias("anomaly_reason"),
            F.lit(None).cast("string").alias("ml_model_version"),
        )
    scored = scorer(as_input(inserted), history).select(
        F.col("transaction_id").alias("id"), "is_anomaly", "anomaly_status", F.col("confidence").alias("anomaly_score"),
        F.col("reason").alias("anomaly_reason"), F.col("model_version").alias("ml_model_version"),
    )
    unscored = F.col("_scored").isNull()
    return (
        inserted.join(scored.withColumn("_scored", F.lit(True)), "id", "left")
        .withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))
        .withColumn("anomaly_reason", F.when(unscored, F.lit(V.ANOMALY_FALLBACK_REASON)).otherwise(F.col("anomaly_reason")))
        .drop("_scored")
    )


def profile_before(newest: DataFrame, recent: DataFrame, last_id: int) -> DataFrame:
    """`anomaly.history_profile` of the users of `newest`, the arrays of new rows, from those stored before (`recent`).

    New rows, whose ids are above `last_id`, take their part in the limit and are left out then.
    """
    fields = ["created_at", "id", "amount", "category_name", "transaction_type"]
    slim = lambda df, to: df.select("user_id", *[F.col(f"recent.{f}").alias(f"{to}_{f}") for f in fields])
    users = newest.select("user_id")
    both = slim(newest, "_new").join(slim(recent.join(users, "user_id", "left_semi"), "_old"), "user_id", "left")
    rows = lambda of: F.transform(F.arrays_zip(*[f"{of}_{f}" for f in fields]), lambda r: F.struct(*[r[f"{of}_{f}"].alias(f) for f in fields]))
    both = both.select("user_id", rows("_new").alias("_new"), rows("_old").alias("_old"))
    before = F.filter(summaries.newest_of(F.col("_new"), F.col("_old")), lambda r: F.coalesce(r["id"] <= last_id, F.lit(True)))
    entry = lambda r: A.profile_entry(r["created_at"], r["amount"], r["category_name"], r["transaction_type"])
    return both.select("user_id", F.sort_array(F.transform(before, entry)).alias("history"))


def _insert(classified: DataFrame, kind: str, categories: DataFrame, last: Column, place: list[str], merchant: str, notes: str) -> tuple[DataFrame, DataFrame]:
    """(categories, new transactions): classified rows with their category and an id, numbered in order of `place`."""
    at = F.struct(*place)
    requests = classified.select(
        F.col("normalized_category").alias("normalized_name"), F.col(kind).alias("transaction_type"), F.col("category_name").alias("name"), at.alias("place")
    )
    all_categories, resolved = C.category_resolve(requests, categories, "place")
    # Written, as a join sees the size of a written table: rows do not move to meet a few categories.
    named = attach(
        classified.withColumn("transaction_type", F.col(kind)),
        written_once(resolved).withColumnRenamed("normalized_name", "normalized_category"),
        ["normalized_category", "transaction_type"],
        at,
        how="inner",  # every request is resolved
    )
    # Numbering writes the new rows once; everything after it reads that copy.
    numbered = sorted_index(named, place, "_n", written_once)
    inserted = numbered.select(
        (last + F.col("_n") + 1).cast("bigint").alias("id"),
        "user_id",
        F.col(merchant).alias("merchant"),
        F.abs("amount").alias("amount"),
        F.coalesce(notes, F.lit("")).alias("notes"),
        "transaction_type",
        "category_id",
        F.col("resolved_name").alias("category_name"),
        "confidence",
        "reason",
        "created_at",
        *place,
    )
    return all_categories, inserted


def _last_id(stored: DataFrame) -> Column:
    return F.coalesce(stored.agg(F.max("id").alias("m")).scalar(), F.lit(0))


def import_transactions(
    rows: DataFrame,
    uploads: DataFrame,
    cache: DataFrame,
    answers: DataFrame,
    categories: DataFrame,
    stored: DataFrame,
    now: Column,
    type_source: str = "sign",
    scorer=None,
    last_id: int | None = None,
    recent: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Validate, classify, resolve categories, number, score and count.

    rows: upload_id, user_id, row_no, transaction_date, description, amount, raw_text. `answers` are the
    classifier's results per key; a key without one takes the fallback. `type_source` is 'sign' (imports) or
    'classifier'. With `last_id`, the largest id so far, `stored` need only hold the newest rows of the rows' users, and
    `cache` their entries. `recent` holds the same newest rows as arrays (`summaries.recent_arrays`); the result then has
    the arrays of the new rows too, as `newest`.
    """
    # Rows with their owner and their errors, and classified rows, are each read several times below: written once.
    checked, rejected = _checked_rows(rows, uploads)
    good = validation.good_rows(checked)
    checked = checked.drop("normalized_merchant")
    place = F.struct("upload_id", "row_no")
    counted = written_once(good.groupBy(*C.KEY).agg(F.count(F.lit(1)).alias("n_rows")))  # the keys of all good rows
    classified = written_once(C.broadcast_results_back(good, C.merge_results(cache, answers), place, counted))
    kind = "transaction_type" if type_source == "sign" else "answer_type"
    last = _last_id(stored) if last_id is None else F.lit(last_id)
    all_categories, inserted = _insert(classified, kind, categories, last, ["upload_id", "row_no"], "description", "raw_text")
    fresh_answers = C.unknown(answers, cache).join(counted, C.KEY, "left_semi")
    profile, arrays = None, {}
    if recent is not None:
        arrays["newest"] = written_once(summaries.recent_arrays(inserted.select(*STORED)))  # scoring and the state read them
        profile = profile_before(arrays["newest"], recent, last_id)
    return arrays | {
        "transactions": score_inserted(inserted, stored, scorer, profile=profile).withColumn("anomaly_checked_at", now),
        "cache": C.cache_upsert(cache, fresh_answers, now),
        "categories": all_categories,
        "uploads": C.import_counts(checked),
        "quarantine": validation.quarantine(checked),
        "rejected": rejected,
    }


def _checked_rows(rows: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of their uploads' owners with their error and, of good ones, merchant key; the rows of others), as `cache.owner_check` tells.

    Uploads are looked up for each upload and user of the rows, and rows are read and written once for all that follows.
    """
    keys = ["upload_id", "user_id"]
    pairs = written_once(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")))
    owned = C.owner_check(pairs, uploads)[0].select(*keys, F.lit(True).alias("_owned"))
    sent = F.when(F.col("_owned").isNull(), F.struct(*rows.columns)).alias("_sent")
    marked = attach(rows, owned, keys, F.col("row_no"), counted=pairs).select(*rows.columns, "_owned", sent)
    key = F.when(F.col("_owned") & F.col("error").isNull(), normalize_merchant("description"))
    checked = written_once(validation.validate_import_rows(marked).withColumn("normalized_merchant", key))
    return checked.where("_owned").drop("_owned", "_sent"), checked.where("_owned IS NULL").select("_sent.*")


def manual_entries(
    entries: DataFrame, cache: DataFrame, answers: DataFrame, categories: DataFrame, stored: DataFrame, now: Column, scorer=None
) -> dict[str, DataFrame]:
    """Entries typed in by users: classified, stored and scored, in one job for all users.

    entries: user_id, entry_no (unique), merchant, amount, notes, transaction_type (null: by sign), created_at. The
    cache is asked under the entry's type and then under the other one. The classifier (`answers`) is asked where both
    miss, and its answer, or the cached one, decides the type of the stored row; without either the fallback does.
    The history of an entry is its user's newest rows before the job: entries do not crowd each other out of it.
    """
    # Keys are written with the checked rows: the lookup below reads them three times.
    checked = cut_lineage(validation.validate_manual_rows(entries).withColumn("normalized_merchant", normalize_merchant("merchant")))
    good = validation.good_rows(checked)
    found = cut_lineage(C.cache_join_alt_type(good, cache, F.col("entry_no")))
    missed = found.where("cached_type IS NULL").drop("cached_type", *C.PAYLOAD)
    asked = C.broadcast_results_back(missed, answers, F.col("entry_no"))
    hits = found.where("cached_type IS NOT NULL").withColumnRenamed("cached_type", "answer_type")
    classified = cut_lineage(hits.unionByName(asked))
    all_categories, inserted = _insert(classified, "answer_type", categories, _last_id(stored), ["entry_no"], "merchant", "notes")
    fresh = answers.join(missed.select(*C.KEY).distinct(), C.KEY, "left_semi")
    return {
        "transactions": score_inserted(inserted, stored, scorer, exclude_first=True).withColumn("anomaly_checked_at", now),
        "cache": C.cache_upsert(cache, fresh, now),
        "categories": all_categories,
        "quarantine": validation.quarantine(checked.drop("normalized_merchant")),
    }
