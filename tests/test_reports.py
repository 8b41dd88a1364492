import datetime

from coinweir.operators import reports as R

SCHEMA = "id long, user_id string, merchant string, amount double, category_id long, category_name string, transaction_type string, created_at timestamp"


def txns(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    return spark.createDataFrame(
        [
            (1, "u", "Cafe", 10.0, 1, "Food", "expense", day(1)),
            (2, "u", "Cafe", 20.0, 1, "Food & Drinks", "expense", day(2)),  # the newest name counts
            (3, "u", "Bus", 30.25, 2, "Travel", "expense", day(3)),
            (4, "u", "Job", 100.0, 3, "Salary", "income", day(4)),
            (5, "v", "Job", 50.0, 3, "Salary", "income", day(4)),
            (6, "w", "100% Gym", 0.0, 4, "Sport", "expense", day(5)),
        ],
        SCHEMA,
    )


def test_breakdown(spark):
    got = [(r.user_id, r.category_id, r.category_name, r.amount, r.percentage) for r in R.category_breakdown(txns(spark)).orderBy("user_id", "position").collect()]
    assert got == [("u", 2, "Travel", 30.25, 50.21), ("u", 1, "Food & Drinks", 30.0, 49.79), ("w", 4, "Sport", 0.0, 0.0)]


def test_totals_and_top_category(spark):
    totals = {r.user_id: (r.total_expense, r.total_income) for r in R.dashboard_totals(txns(spark)).collect()}
    assert totals == {"u": (60.25, 100.0), "v": (0.0, 50.0), "w": (0.0, 0.0)}
    assert {r.user_id: r.top_category for r in R.top_category(txns(spark)).collect()} == {"u": "Travel", "v": "", "w": "Sport"}


def test_search_is_literal(spark):
    found = lambda *a: sorted(r.id for r in R.search_transactions(txns(spark), *a).collect())
    assert found("0% g") == [6] and found(" ") == [1, 2, 3, 4, 5, 6] and found("food", "Expenses") == [1, 2] and found("", "Income") == [4, 5]
    assert found(".*") == []


def test_lookups_and_order(spark):
    assert [r.id for r in R.list_transactions(txns(spark), "u").collect()] == [4, 3, 2, 1]
    assert R.transaction_by_id(txns(spark), 5, "u").count() == 0 and R.transaction_by_id(txns(spark), 5, "v").count() == 1


def test_metrics_without_positives(spark):
    scored = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    r = R.binary_metrics(scored).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.f2) == (1.0, 0.0, 0.0, 0.0, 0.0)
