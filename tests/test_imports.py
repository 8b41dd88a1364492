import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from coinweir.operators import anomaly as A
from coinweir.operators import cache as C
from coinweir.operators import summaries, validation
from coinweir.plans import imports as I

T0, NOW = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 6, 1)
CACHE = "user_id string, normalized_merchant string, transaction_type string, category_name string, normalized_category string, confidence double, reason string, source string, created_at timestamp, updated_at timestamp"
ANSWERS = "user_id string, normalized_merchant string, transaction_type string, answer_type string, category_name string, normalized_category string, confidence double, reason string, answer_no long"
ROWS = "upload_id string, user_id string, row_no long, transaction_date string, description string, amount double, raw_text string"


def cache(spark, *entries):
    return spark.createDataFrame([(u, m, t, c, c.lower(), conf, "r", "ai", T0, T0) for u, m, t, c, conf in entries], CACHE)


def answers(spark, *entries):
    return spark.createDataFrame([(u, m, t, a, c, c.lower(), conf, "r", n) for n, (u, m, t, a, c, conf) in enumerate(entries)], ANSWERS)


def now():
    return F.lit(NOW)


def test_upsert(spark):
    old = cache(spark, ("u", "a", "expense", "Old", 0.8), ("u", "b", "expense", "Old", 0.5))
    new = answers(
        spark,
        ("u", "a", "expense", "expense", "Tie", 0.8),  # a tie keeps the stored entry
        ("u", "b", "expense", "expense", "Better", 0.6),
        ("u", "b", "expense", "expense", "Best", 0.9),
        ("u", "c", "expense", "income", "Flipped", 0.4),  # stored under the answer's own type
        ("u", "", "expense", "expense", "Empty", 0.9),
        ("u", "d", "expense", "expense", "Fallback", 0.0),
        ("v", "a", "expense", "expense", "First", 0.7),
        ("v", "a", "expense", "expense", "Second", 0.7),
    )
    got = {(r.user_id, r.normalized_merchant, r.transaction_type): (r.category_name, r.created_at, r.updated_at) for r in C.cache_upsert(old, new, now()).collect()}
    assert got == {
        ("u", "a", "expense"): ("Old", T0, T0),
        ("u", "b", "expense"): ("Best", T0, NOW),
        ("u", "c", "income"): ("Flipped", NOW, NOW),
        ("v", "a", "expense"): ("First", NOW, NOW),
    }


def test_alternative_type(spark):
    stored = cache(spark, ("u", "a", "income", "In", 0.8), ("u", "b", "income", "In", 0.8), ("u", "b", "expense", "Out", 0.8))
    rows = spark.createDataFrame([(i, "u", m, "expense") for i, m in enumerate(["a", "b", "c", ""])], "row_no long, user_id string, normalized_merchant string, transaction_type string")
    got = {r.normalized_merchant: (r.cached_type, r.category_name) for r in C.cache_join_alt_type(rows, stored, F.col("row_no")).collect()}
    assert got == {"a": ("income", "In"), "b": ("expense", "Out"), "c": (None, None), "": (None, None)}
    hits = {r.normalized_merchant: r.cache_hit for r in C.cache_join(rows, stored, F.col("row_no")).collect()}
    assert hits == {"a": False, "b": True, "c": False, "": False}


def test_timestamps(spark):
    texts = ["2024-01-05", " 2024-01-05T10:30:00 ", "2024-01-05T10:30:00+02:00", "2024-01-05 10:30:00Z", "05/01/2024", "", "2024-13-01"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in rows.select("i", validation.parse_timestamp("t").alias("v")).orderBy("i").collect()]
    day = datetime.datetime
    assert got == [day(2024, 1, 5), day(2024, 1, 5, 10, 30), day(2024, 1, 5, 8, 30), day(2024, 1, 5, 10, 30), None, None, None]


def job(spark, type_source="sign"):
    rows = spark.createDataFrame(
        [
            ("up", "u", 1, "2024-05-01", "COFFEE BAR #12", -4.0, "raw"),
            ("up", "u", 2, "2024-05-02", "COFFEE BAR #99", -5.0, None),
            ("up", "u", 3, "2024-05-03", "NEW SHOP", -7.0, None),
            ("up", "u", 4, "2024-05-03", "UNKNOWN PLACE", 8.0, None),
            ("up", "u", 5, "2024-05-03", " ", 8.0, None),
            ("up", "u", 6, "2024-05-03", "ZERO", 0.0, None),
            ("up", "u", 7, "soon", "BAD DATE", 1.0, None),
            ("up", "thief", 8, "2024-05-03", "COFFEE BAR", -1.0, None),
        ],
        ROWS,
    )
    uploads = spark.createDataFrame([("up", "u")], "id string, user_id string")
    categories = spark.createDataFrame([(5, "Coffee", "coffee", "expense")], "id long, name string, normalized_name string, transaction_type string")
    stored = spark.createDataFrame([], "id long, user_id string, merchant string, amount double, notes string, transaction_type string, category_id long, category_name string, confidence double, reason string, created_at timestamp")
    return I.import_transactions(
        rows, uploads, cache(spark, ("u", "coffee bar", "expense", "Coffee", 0.9)),
        answers(spark, ("u", "new shop", "expense", "income", "Shops", 0.7), ("u", "coffee bar", "expense", "expense", "Never", 1.0)),
        categories, stored, now(), type_source,
    )


def test_import(spark):
    result = job(spark)
    got = [(r.id, r.merchant, r.amount, r.transaction_type, r.category_id, r.category_name, r.anomaly_status) for r in result["transactions"].orderBy("id").collect()]
    assert got == [
        (1, "COFFEE BAR #12", 4.0, "expense", 5, "Coffee", "insufficient_history"),
        (2, "COFFEE BAR #99", 5.0, "expense", 5, "Coffee", "insufficient_history"),
        (3, "NEW SHOP", 7.0, "expense", 7, "Shops", "insufficient_history"),
        (4, "UNKNOWN PLACE", 8.0, "income", 6, "Other", "insufficient_history"),
    ]
    assert sorted(r.error for r in result["quarantine"].collect()) == ["amount is zero", "description is empty", "invalid transaction_date"]
    counts = result["uploads"].first()
    assert (counts.total_transactions, counts.imported_transactions, counts.failed_transactions, counts.status) == (7, 4, 3, "imported")
    assert [r.row_no for r in result["rejected"].collect()] == [8]
    stored = {(r.normalized_merchant, r.transaction_type): r.category_name for r in result["cache"].collect()}
    assert stored == {("coffee bar", "expense"): "Coffee", ("new shop", "income"): "Shops"}


def test_manual_entries_take_the_classifier_type(spark):
    kinds = {r.merchant: r.transaction_type for r in job(spark, "classifier")["transactions"].collect()}
    assert kinds["NEW SHOP"] == "income" and kinds["COFFEE BAR #12"] == "expense"


def test_requests_are_grouped_once(spark):
    asked = spark.createDataFrame([(1, "food", "expense", "Food"), (2, "food", "expense", "food!"), (3, "pay", "income", "Pay")], "row_no int, normalized_name string, transaction_type string, name string")
    known = spark.createDataFrame([(7, "Pay", "pay", "income")], "id long, name string, normalized_name string, transaction_type string")
    everything, resolved = C.category_resolve(asked, known, "row_no")
    assert sorted((r.category_id, r.resolved_name) for r in resolved.collect()) == [(7, "Pay"), (8, "Food")]
    assert everything.count() == 2
    assert "min_by" not in resolved._jdf.queryExecution().optimizedPlan().toString() and "row_no" not in resolved._jdf.queryExecution().optimizedPlan().toString()


# ---- an import is read, checked and scored once --------------------------------------------------------------

STORED = "id long, user_id string, merchant string, amount double, notes string, transaction_type string, category_id long, category_name string, confidence double, reason string, created_at timestamp"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _many(spark, with_arrays):
    """30 users with 0 to 260 stored rows; the batch has rows before and after them, twice the same ones, and of strangers."""
    rng = random.Random(5)
    stored, rows = [], []
    for user in range(30):
        for i in range(rng.choice([0, 3, 9, 12, 40, 199, 200, 260])):
            kind, amount = rng.choice([("expense", "Coffee"), ("expense", "Other"), ("income", "Other"), (None, None)]), rng.choice([4.0, 5.0, 5.005, 80.0, None])
            stored.append((len(stored), f"u{user}", "m", amount, "", kind[0], 5, kind[1], 1.0, "", T0 + datetime.timedelta(hours=rng.randrange(900))))
    stored.append((len(stored), None, "m", 4.0, "", "expense", 5, "Coffee", 1.0, "", T0))
    last = len(stored)
    for n in range(900):
        user, when = f"u{rng.choice([*range(32), *[3] * 20])}", T0 + datetime.timedelta(hours=rng.randrange(-50, 1000))
        text = rng.choice(["COFFEE BAR #12", "COFFEE BAR #99", "NEW SHOP", "", None])
        rows.append((rng.choice(["up", "up", "down", None]), rng.choice([user, user, user, None]), n, rng.choice([when.isoformat(), when.isoformat(), "soon", None]), text, rng.choice([-4.0, -4.2, -5.0, -200.0, 8.0, 0.0, None, float("nan")]), "raw"))
    rows += rows[:40]
    rows = spark.createDataFrame(rows, ROWS)
    uploads = spark.createDataFrame([(up, f"u{i}") for i in range(31) for up in ("up", "up", "down", None)] + [("up", None)], "id string, user_id string")
    categories = spark.createDataFrame([(5, "Coffee", "coffee", "expense")], "id long, name string, normalized_name string, transaction_type string")
    stored = spark.createDataFrame(stored, STORED)
    known = cache(spark, *[(f"u{i}", "coffee bar", "expense", "Coffee", 0.9) for i in range(31)])
    asked = answers(spark, *[(f"u{i}", "new shop", "expense", "income", "Shops", 0.7) for i in range(0, 31, 2)])
    arrays = {"last_id": last, "recent": summaries.recent_arrays(stored).localCheckpoint()} if with_arrays else {"last_id": last}
    return rows, uploads, stored, I.import_transactions(rows, uploads, known, asked, categories, stored, now(), **arrays)


def _rows(df, without=()):
    return Counter(tuple(map(repr, r)) for r in df.select(*sorted(set(df.columns) - set(without))).collect())


def test_arrays_of_newest_rows_score_as_the_rows_do(spark):
    rows, uploads, stored, by_rows = _many(spark, False)
    by_arrays = _many(spark, True)[3]
    # Rows that come twice may be numbered either way.
    assert by_arrays["transactions"].columns == by_rows["transactions"].columns
    assert _rows(by_arrays["transactions"], ["id"]) == _rows(by_rows["transactions"], ["id"])
    for name in ("uploads", "quarantine", "rejected", "cache", "categories"):
        assert _rows(by_arrays[name]) == _rows(by_rows[name])
    inserted = by_rows["transactions"].select(*I.STORED).localCheckpoint()
    batch = inserted.select(F.col("id").alias("transaction_id"), "user_id", F.col("created_at").alias("transaction_date"), "merchant", "amount", F.col("category_name").alias("category"), "transaction_type", "notes")
    history = A.history_exclude_batch(stored.unionByName(inserted), inserted).withColumnsRenamed({"id": "transaction_id", "created_at": "transaction_date", "category_name": "category"})
    want = {r.transaction_id: r.anomaly_status for r in A.anomaly_safeguards(batch, history).collect()}
    assert {r.id: r.anomaly_status for r in by_rows["transactions"].collect()} == want
    assert {None, "normal", "insufficient_history"} == set(want.values())
    # The arrays of the new rows, and the rows of others, as they were sent.
    assert _rows(summaries.recent_rows(by_arrays["newest"]), ["id"]) == _rows(summaries.recent_rows(summaries.recent_arrays(inserted)), ["id"])
    assert _rows(by_rows["rejected"]) == _rows(C.owner_check(rows, uploads)[1])
    assert _rows(by_rows["quarantine"]) == _rows(validation.quarantine(validation.validate_import_rows(C.owner_check(rows, uploads)[0])))


def test_rows_are_checked_and_scored_once(spark):
    result = _many(spark, True)[3]
    for name in ("uploads", "quarantine", "rejected"):  # from the checked rows: no second look at uploads or dates
        assert "Join" not in _plan(result[name]) and "RLIKE" not in _plan(result[name])
    scored = _plan(result["transactions"])
    assert "row_number" not in scored  # stored rows are not ranked
    assert "(id#" not in "".join(line for line in scored.splitlines() if "Join" in line)  # nothing is joined back to the rows


def test_groups_are_guarded_as_rows_are(spark):
    rng = random.Random(8)
    columns = "transaction_id long, user_id string, transaction_date timestamp, merchant string, amount double, category string, transaction_type string, notes string"
    made = lambda i, *odd: (i, rng.choice(["a", "a", "a", "b", "c", None]), T0 + datetime.timedelta(hours=rng.randrange(500)), "m", rng.choice([1.0, 1.005, 1.2, 7.0, 30.0, None, *odd]), rng.choice(["x", "y", "", None, *(["new"] if odd else [])]), rng.choice(["expense", "Expense", "income", None]), "")
    history = spark.createDataFrame([made(i) for i in range(400)], columns)
    batch = spark.createDataFrame([made(1000 + i, float("nan"), float("inf"), 0.0, 8.5, 33.3, 900.0) for i in range(300)], columns)
    both = (A.group_safeguards(batch, A.history_profile(history)), A.anomaly_safeguards(batch, history))
    got, want = ({r.transaction_id: (r.safeguard, r.anomaly_status) for r in df.collect()} for df in both)
    assert got == want and len(got) == 300 and len(set(got.values())) > 4
