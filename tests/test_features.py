"""Features against pandas on data with ties, nulls, flat groups and one dominant group."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from coinweir.operators import anomaly as A
from coinweir.operators import features as X

BASE = datetime.datetime(2024, 1, 1)
SCHEMA = "transaction_id long, user_id string, category string, transaction_date timestamp, amount double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(900):
        user = rng.choice(["u1", "u1", "u1", "u2", "u3", None])
        category = rng.choice(["food", "food", "rent", None])
        when = BASE + datetime.timedelta(hours=rng.choice([0, 1, 24, 168, 169, 336, rng.randrange(900)]), minutes=rng.choice([0, 0, 30]))
        amount = rng.choice([5.0, 9.99, 10.0, 100.0, 1000.0, -3.25, 0.0, round(rng.random() * 500, 2)])
        out.append((i, user, category, when, amount))
    out.append((900, "solo", "food", BASE, 12.5))
    out += [(901 + i, "flat", "food", BASE + datetime.timedelta(days=i), 0.1) for i in range(5)]
    out.append((990, "u1", "food", None, 7.0))
    return out


def brute(rows):
    df = pd.DataFrame(rows, columns=["transaction_id", "user_id", "category", "transaction_date", "amount"])
    df["z"], df["pct"], df["freq"] = 0.0, 0.5, 1
    for _, g in df.groupby(["user_id", "category"]):
        if len(g) > 1 and g.amount.min() < g.amount.max():
            df.loc[g.index, "z"] = (g.amount - g.amount.mean()) / g.amount.std()
        df.loc[g.index, "pct"] = g.amount.rank(pct=True)
        timed = g.dropna(subset=["transaction_date"])
        for i, r in timed.iterrows():
            earlier = (timed.transaction_date < r.transaction_date) | (
                (timed.transaction_date == r.transaction_date) & (timed.transaction_id <= r.transaction_id)
            )
            recent = timed.transaction_date >= r.transaction_date - pd.Timedelta(days=7)
            df.loc[i, "freq"] = int((earlier & recent).sum())
    return df.set_index("transaction_id")


@pytest.mark.parametrize("hot", [False, True])
def test_engineer_features(spark, rows, hot):
    if hot:  # one group holds most rows
        rows = [(i, "u1", "food", *r) for i, (_, _, _, *r) in enumerate(rows) if i % 5] + [(2000 + i, *r) for i, (_, *r) in enumerate(rows)]
    got = X.engineer_features(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("transaction_id")
    want = brute(rows)
    assert sorted(got.index) == sorted(want.index)
    want = want.loc[got.index]
    assert (got.spending_freq_7d == want.freq).all()
    assert (got.amount_zscore - want.z).abs().max() < 1e-9
    assert (got.category_percentile - want.pct).abs().max() < 1e-12


def test_date_features(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 6, 3, 5),)], "transaction_date timestamp")
    r = X.date_features(df).first()
    assert (r.day_of_week, r.day_of_month, r.month, r.hour, r.is_weekend) == (5, 6, 1, 3, 1)


def history_rows(n, amount=lambda i: 10.0 + i, category="food", kind="expense"):
    return [(i, "u", BASE + datetime.timedelta(days=i), "m", amount(i), category, kind, None) for i in range(n)]


ML = "transaction_id long, user_id string, transaction_date timestamp, merchant string, amount double, category string, transaction_type string, notes string"


def verdict(spark, history, amount, category="food"):
    batch = spark.createDataFrame([(999, "u", BASE + datetime.timedelta(days=400), "m", amount, category, "expense", None)], ML)
    return A.anomaly_safeguards(batch, spark.createDataFrame(history, ML)).first()


def test_safeguards_in_order(spark):
    assert verdict(spark, history_rows(9), 10.0).safeguard == "cold_start_total"
    mixed = history_rows(8, category="rent") + [(100 + i, *r[1:]) for i, r in enumerate(history_rows(4))]
    assert verdict(spark, mixed, 10.0).safeguard == "cold_start_category"
    assert verdict(spark, history_rows(12), 15.005).safeguard == "same_amount"
    assert verdict(spark, history_rows(12), 16.6).safeguard == "tolerance"
    open_case = verdict(spark, history_rows(12), 500.0)
    assert open_case.safeguard is None and open_case.anomaly_status is None
    assert verdict(spark, history_rows(12, kind="income"), 500.0).safeguard == "cold_start_total"


def test_row_without_amount_is_not_scored(spark):
    r = verdict(spark, history_rows(12), None)
    assert (r.safeguard, r.anomaly_status) == ("unusable_row", "insufficient_history")


def test_history_keeps_the_newest_200(spark):
    r = verdict(spark, history_rows(300), 5000.0)
    assert r.n_expense == 200 and r.category_max == 309.0


def test_backdated_row_is_scored_itself(spark):
    batch = spark.createDataFrame([(999, "u", BASE + datetime.timedelta(days=5), "m", 500.0, "food", "expense", None)], ML)
    checked = A.anomaly_safeguards(batch, spark.createDataFrame(history_rows(12), ML))
    r = A.features_against_history(checked).first()
    amounts = pd.Series([10.0 + i for i in range(12)] + [500.0])
    assert abs(r.amount_zscore - (500.0 - amounts.mean()) / amounts.std()) < 1e-9
    assert r.category_percentile == 1.0 and r.spending_freq_7d == 7


@pytest.mark.parametrize(
    ("z", "freq", "hour", "words"),
    [(0.0, 1, 12, "looks different"), (3.0, 1, 12, "one of your higher food"), (0.0, 6, 12, "made 6 food purchases"), (0.0, 1, 3, "unusual time"), (3.0, 6, 3, "also made 6 purchases")],
)
def test_reasons(spark, z, freq, hour, words):
    row = spark.createDataFrame([(z, 0.5, freq, hour, "food")], "amount_zscore double, category_percentile double, spending_freq_7d long, hour int, category string")
    assert words in row.select(A.anomaly_reason().alias("r")).first().r
    assert row.select(A.anomaly_reason(F.lit(False)).alias("r")).first().r is None
