"""Versioned state, merged summaries, stored transactions, manual entries, previews, damaged files."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from coinweir import schemas
from coinweir.operators import features as X
from coinweir.operators import reports as R
from coinweir.operators import summaries as S
from coinweir.plans import imports as I
from coinweir.plans import statements as P
from coinweir.plans import uploads as U
from coinweir.plans.state import START, BucketedTable, numbers_under
from coinweir.session import fresh_path
from coinweir.sources import files
from tests.test_imports import answers, cache, now

T0 = datetime.datetime(2024, 1, 1)
TXN = "id long, user_id string, amount double, created_at timestamp"


def _txns(spark, rows):
    return spark.createDataFrame([(i, u, a, T0 + datetime.timedelta(hours=h)) for i, u, a, h in rows], TXN)


def test_fifty_batches_cost_the_same(spark):
    """Every batch brings two rows of each of three users; batch 49 reads as much as batch 2 did."""
    users = ["a", "b", "c"]
    table = BucketedTable(fresh_path(spark, "recent"), S.recent_arrays(_txns(spark, [])).schema, buckets=8)
    table.write(S.recent_arrays(_txns(spark, [(-1, "other", 1.0, 0)])), START)
    everything, cost = [], []
    for batch in range(50):
        rows = [(1000 * batch + i, u, 1.0, batch + i / 10) for i, u in enumerate(users * 2)]
        everything += rows
        df = _txns(spark, rows)
        touched = table.touched(df)
        state = table.read(spark, batch, touched)
        cost.append((len(state.inputFiles()), state.count()))
        table.write(S.merge_recent(state, S.recent_arrays(df, 4), 4), batch, touched)
        table.forget(spark, batch)
    assert cost[2] == cost[49]
    assert cost[49][1] <= 4
    assert len(numbers_under(spark, f"{table.root}/data")) <= 4
    assert numbers_under(spark, f"{table.root}/versions") == [48, 49]
    got = sorted((r.user_id, r.id) for r in S.recent_rows(table.read(spark, 50)).collect())
    want = sorted((u, i) for user in users for i, u, *_ in sorted((r for r in everything if r[1] == user), key=lambda r: (r[3], r[0]))[-4:])
    assert got == sorted([*want, ("other", -1)])
    folders = spark._jvm.org.apache.hadoop.fs.Path(f"{table.root}/data")
    left = folders.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table.root}/data/*/bucket=*"))
    assert len(left) <= 2 * 8  # old versions are gone


def test_one_user_changes_one_bucket_and_repeats_do_nothing(spark):
    table = BucketedTable(fresh_path(spark, "recent"), S.recent_arrays(_txns(spark, [])).schema, buckets=8)
    table.write(S.recent_arrays(_txns(spark, [(i, f"u{i}", 1.0, i) for i in range(40)])), START)
    before = table.versions(spark, 0)
    new = _txns(spark, [(100, "u7", 2.0, 100), (101, None, 3.0, 100)])
    results = []
    for _ in range(2):  # the second time as after a failure
        touched = table.touched(new)
        table.write(S.merge_recent(table.read(spark, 0, touched), S.recent_arrays(new)), 0, touched)
        results.append(sorted((r.user_id or "", r.id) for r in S.recent_rows(table.read(spark, 1)).collect()))
    after = table.versions(spark, 1)
    assert [b for b in after if after[b] != before[b]] == table.touched(new)
    assert results[0] == results[1] == sorted([*((f"u{i}", i) for i in range(40)), ("u7", 100), ("", 101)])
    assert table.read(spark, START).count() == 0


def test_merged_arrays_are_the_newest_of_both_sides(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 4 + ["b", "c", None]), float(i), rng.randrange(60)) for i in range(120)]
    old, new = [r for r in rows if r[0] < 80 and r[1] != "b"], [r for r in rows if r[0] >= 80 and r[1] != "c"]
    merged = S.merge_recent(S.recent_arrays(_txns(spark, old), 30), S.recent_arrays(_txns(spark, new), 30), 20)
    got = {r.user_id: [(e.created_at, e.id) for e in r.recent] for r in merged.collect()}
    want = {u: sorted(((T0 + datetime.timedelta(hours=h), i) for i, v, _, h in old + new if v == u), reverse=True)[:20] for u in ("a", "b", "c", None)}
    assert got == want and len(want["a"]) == 20
    # Users of one side pass through: arrays are not collected again, nor those of all users sorted.
    assert "collect_list" not in merged.select("user_id", "recent")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        user = rng.choice(["u1"] * 6 + ["u2", "u3", None])
        when = T0 + datetime.timedelta(hours=rng.choice([0, 1, 24, 168, 169, 336, rng.randrange(900)]), minutes=rng.choice([0, 0, 30]), microseconds=i)
        amount = rng.choice([5.0, 9.99, 10.0, 1e9, 1e9 + 1, -3.25, 0.0, None, round(rng.random() * 500, 2)])
        rows.append((i, user, rng.choice(["food", "food", "rent", None]), when, amount))
    rows += [(2000, "solo", "food", T0, 12.5), (2001, "u1", "food", None, 7.0)]
    return rows


SCHEMA = "transaction_id long, user_id string, category string, transaction_date timestamp, amount double"


def test_merged_moments_equal_those_of_all_rows(spark, groups):
    df = spark.createDataFrame(groups, SCHEMA)
    parts = [S.group_moments(df.where(F.col("transaction_id") % 4 == i)) for i in range(4)]
    got = {(r.user_id, r.category): r for r in S.stats_of(S.merge_moments(*parts)).collect()}
    for r in X.user_category_stats(df).collect():
        mine = got[r.user_id, r.category]
        assert (mine.n_rows, mine.min_amount, mine.max_amount) == (r.n_rows, r.min_amount, r.max_amount)
        for a, b in ((mine.mean_amount, r.mean_amount), (mine.std_amount, r.std_amount)):
            assert a == b or abs(a - b) <= 1e-9 * max(1, abs(b))


@pytest.mark.parametrize("share", [2, 10])
def test_features_of_a_batch_equal_those_of_all_rows(spark, groups, share):
    df = spark.createDataFrame(groups, SCHEMA)
    batch, old = (df.where((F.col("transaction_id") % share == 1) == flag) for flag in (True, False))
    parts = [old.where("transaction_id < 500"), old.where("transaction_id >= 500")]
    moments = S.merge_moments(*map(S.group_moments, parts))
    amounts, times = (S.merge_counts(*map(f, parts)) for f in (S.amount_counts, S.time_counts))
    got = S.features_of_batch(batch, moments, amounts, times).toPandas().set_index("transaction_id").sort_index()
    want = X.engineer_features(df).toPandas().set_index("transaction_id").loc[got.index]
    assert len(got) == batch.count()
    assert sorted(got.columns) == sorted(want.columns)
    assert (got.spending_freq_7d == want.spending_freq_7d).all()
    for name in ("amount_zscore", "category_percentile"):
        assert (got[name] - want[name]).abs().max() < 1e-9
        assert (got[name].isna() == want[name].isna()).all()


def test_stored_transactions(spark):
    rows = [(i, f"u{i % 40}", float(i), i) for i in range(400)]
    name = f"stored_{random.randrange(10**9)}"
    files.store_by_user(_txns(spark, rows), name, fresh_path(spark, name), 8)
    try:
        one = R.transaction_by_id(spark.table(name), 47, "u7")
        assert one.first().amount == 47.0
        plan = one._jdf.queryExecution().executedPlan()
        assert plan.collectLeaves().apply(0).optionalBucketSet().get().cardinality() == 1  # one bucket of 8
        assert "EqualTo(id,47)" in plan.toString()
        per_user = spark.table(name).groupBy("user_id").agg(F.sum("amount").alias("total"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = spark.table(name).join(per_user, "user_id")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_damaged_rows_are_set_aside(spark):
    path = fresh_path(spark, "damaged")
    good = '1,u,2024-01-05 10:00:00,"SHOP, ""BIG""",4.5,food,expense,,0'
    lines = [good, "2,u,yesterday,SHOP,4.5,food,expense,,0", "3,u,2024-01-05 10:00:00,SHOP,many,food,expense,,0", "4,u", "5,u,2024-01-05 10:00:00,S,1.0,f,expense,,0,more"]
    spark.createDataFrame([("\n".join(["transaction_id,user_id,transaction_date,merchant,amount,category,transaction_type,notes,is_anomaly", *lines]),)], "value string").coalesce(1).write.text(path)
    kept, aside = files.scan_labelled_csv_checked(spark, path)
    assert [(r.transaction_id, r.merchant, r.amount) for r in kept.collect()] == [("1", 'SHOP, "BIG"', 4.5)]
    assert kept.columns == schemas.LABELLED.names
    assert sorted(r[files.CORRUPT] for r in aside.select(files.CORRUPT).collect()) == lines[1:]


# ---- manual entries ----------------------------------------------------------------------------------------

ENTRIES = "user_id string, entry_no long, merchant string, amount double, notes string, transaction_type string, created_at timestamp"
STORED = "id long, user_id string, merchant string, amount double, notes string, transaction_type string, category_id long, category_name string, confidence double, reason string, created_at timestamp"


def _manual(spark, entries, stored, scorer=None):
    when = datetime.datetime(2024, 5, 1)
    rows = spark.createDataFrame([("u", n, m, a, None, t, when) for n, (m, a, t) in enumerate(entries)], ENTRIES)
    categories = spark.createDataFrame([(5, "Coffee", "coffee", "expense")], "id long, name string, normalized_name string, transaction_type string")
    known = cache(spark, ("u", "coffee bar", "expense", "Coffee", 0.9), ("u", "salary", "income", "Pay", 0.8))
    asked = answers(spark, ("u", "new shop", "expense", "income", "Shops", 0.7), ("u", "salary", "expense", "expense", "Never", 1.0))
    return I.manual_entries(rows, known, asked, categories, spark.createDataFrame(stored, STORED), now(), scorer)


def test_manual_entries(spark):
    entries = [("COFFEE BAR #1", -4.0, None), ("Salary", 9.0, "Expense"), ("NEW SHOP", 7.0, "expense"), ("NOWHERE", 3.0, None), ("X", 1.0, "transfer")]
    result = _manual(spark, entries, [])
    got = [(r.id, r.merchant, r.amount, r.transaction_type, r.category_name, r.confidence, r.anomaly_status) for r in result["transactions"].orderBy("id").collect()]
    cold = "insufficient_history"
    assert got == [
        (1, "COFFEE BAR #1", 4.0, "expense", "Coffee", 0.9, cold),
        (2, "Salary", 9.0, "income", "Pay", 0.8, cold),  # found under the other type, whose type stands
        (3, "NEW SHOP", 7.0, "income", "Shops", 0.7, cold),  # the classifier's type stands
        (4, "NOWHERE", 3.0, "income", "Other", 0.0, cold),
    ]
    assert [r.entry_no for r in result["quarantine"].collect()] == [4]
    stored = {(r.normalized_merchant, r.transaction_type): r.category_name for r in result["cache"].collect()}
    assert stored == {("coffee bar", "expense"): "Coffee", ("salary", "income"): "Pay", ("new shop", "income"): "Shops"}


def test_entries_do_not_crowd_out_the_history(spark):
    stored = [(i, "u", "m", 10.0 + i % 3, "", "expense", 5, "Coffee", 1.0, "", T0 + datetime.timedelta(days=i % 90)) for i in range(30)]
    entries = [("COFFEE BAR", -500.0, None)] * 250
    statuses = {(r.anomaly_status, r.anomaly_reason) for r in _manual(spark, entries, stored)["transactions"].collect()}
    assert statuses == {(None, "Anomaly check unavailable during import")}  # 30 rows of history are enough to go on


def test_rows_without_a_score_take_the_fallback(spark):
    def scorer(batch, history):
        return batch.where("amount < 5").select(
            "transaction_id", F.lit(True).alias("is_anomaly"), F.lit("confirmed_anomaly").alias("anomaly_status"), F.lit(0.9).alias("confidence"),
            F.lit("odd").alias("reason"), F.lit("v1").alias("model_version"),
        )

    got = {r.amount: (r.is_anomaly, r.anomaly_status, r.anomaly_score, r.anomaly_reason, r.ml_model_version) for r in _manual(spark, [("COFFEE BAR", -4.0, None), ("COFFEE BAR", -8.0, None)], [], scorer)["transactions"].collect()}
    assert got == {4.0: (True, "confirmed_anomaly", 0.9, "odd", "v1"), 8.0: (False, None, None, "Anomaly check unavailable during import", None)}


# ---- previews and headers ----------------------------------------------------------------------------------


def test_upload_preview(spark):
    pages = [(1, 1, "\n".join(f"01/{i + 1:02d}/2024 SHOP {chr(65 + i)} {i + 1}.00" for i in range(5))), (2, 1, "no rows at all"), (3, 1, "01/05/2024 CAFE 3.00")]
    lines = files.scan_statement_lines(spark.createDataFrame(pages, "statement_id long, page_no long, text string"))
    body = """```json
{"transactions": [{"transaction_date": "2024-01-01", "description": "Shop A", "amount": "1.00", "raw_text": "01/01/2024 SHOP A 1.00", "transaction_type": "expense"},
 {"transaction_date": "2024-01-02", "description": "Shop B", "amount": "x", "raw_text": "01/02/2024 SHOP B 2.00", "transaction_type": "expense"}]}
```"""
    replies = spark.createDataFrame([(1, 0, body), (1, 1, "{broken"), (3, 0, '{"transactions": []}')], "statement_id long, chunk_no long, body string")
    rows, uploads = U.upload_preview(lines, spark.createDataFrame([], schemas.STATEMENT_TABLES), replies, 2024, chunk=2)
    got = sorted((r.statement_id, str(r.transaction_date), r.description, r.amount) for r in rows.collect())
    assert got == [  # B had no number, C and D were not answered for, E had no answer at all; statement 3 keeps its input
        (1, "2024-01-01", "Shop A", -1.0), (1, "2024-01-03", "SHOP C", 3.0), (1, "2024-01-04", "SHOP D", 4.0), (1, "2024-01-05", "SHOP E", 5.0), (3, "2024-01-05", "CAFE", 3.0),
    ]
    found = {r.statement_id: (r.status, r.total_transactions, r.expense_count, r.total_expense, r.total_income, r.parse_error) for r in uploads.collect()}
    assert found == {1: ("parsed", 4, 1, 1.0, 12.0, None), 2: ("parse_failed", 0, 0, 0.0, 0.0, "no_transactions"), 3: ("parsed", 1, 0, 0.0, 3.0, None)}


HEADERS = {
    "TransactionDate": "transaction date", "AmountCAD": "amount cad", "amountcad": "amount cad", "POSTEDDATE": "posted date", "description": "description",
    "Description": "description", "DR": "dr", "Running Balance": "running balance", "moneyout": "money out", "Accretion": "accretion", "": "", None: "",
    "withdrawals": "withdrawals", "Withdrawals ($)": "withdrawals ($)", "crdr": "cr dr", "datex": "datex", "x" * 80: "x" * 80,
}


def test_header_names(spark):
    df = spark.createDataFrame([(h,) for h in HEADERS], "h string")
    assert {r.h: r.name for r in df.select("h", P.header_name(F.col("h")).alias("name")).collect()} == HEADERS


def test_run_together_headers_find_their_columns(spark):
    def table(headers):
        cells = [headers, ["01/05/2024", "CAFE", "3.00"]]
        pages = spark.createDataFrame([(1, 1, [cells])], "statement_id long, page_no long, tables array<array<array<string>>>")
        return [(str(r.transaction_date), r.description, r.amount) for r in P.parse_tables(files.scan_statement_tables(pages), 2024).collect()]

    assert table(["TransactionDate", "Description", "AmountCAD"]) == [("2024-01-05", "CAFE", 3.0)]
    assert table(["postingdate", "Description", "AmountCAD"]) == []  # an unknown word is left whole
    assert table(["Date", "description", "moneyout"]) == [("2024-01-05", "CAFE", -3.0)]
