import datetime

import pytest
from pyspark.sql import functions as F

from coinweir.plans import statements as P
from coinweir.sources import files

D = datetime.date


def lines_of(spark, pages):
    """{(statement, page): text} -> lines."""
    rows = [(s, p, text) for (s, p), text in pages.items()]
    return files.scan_statement_lines(spark.createDataFrame(rows, "statement_id long, page_no long, text string"))


def typed(lines):
    return P.with_statement_type(lines, P.statement_types(lines))


def rows_of(df):
    return [(r.transaction_date, r.description, r.amount, r.section) for r in df.orderBy("page_no", "line_no").collect()]


BANK = """Chequing account activity
Opening Balance 1,000.00
Withdrawals
10Dec ATM CASH 40.00 960.00
E-Transfer sent
JOHN 2c7a84ec8cce32f8 25.00 935.00
11Dec
COFFEE BAR 5.25
TEA HOUSE 4.75
31Feb BROKEN 9.99
LATE SHOP 3.00
Deposits
12Dec PAYROLL ACME
C1AuK29Mzuxg 2,000.00 2,922.00
Closing Balance 2,922.00
dangling words"""


def test_blocks(spark):
    got = rows_of(P.parse_blocks(typed(lines_of(spark, {(1, 1): BANK})), 2024))
    assert got == [
        (D(2024, 12, 10), "ATM CASH", 40.0, "withdrawals"),
        (D(2024, 12, 10), "E-Transfer sent JOHN", -25.0, "withdrawals"),
        (D(2024, 12, 11), "COFFEE BAR", -5.25, "withdrawals"),  # hints match inside words: cof-fee
        (D(2024, 12, 11), "TEA HOUSE", 4.75, "withdrawals"),
        (D(2024, 12, 11), "LATE SHOP", 3.0, "withdrawals"),
        (D(2024, 12, 12), "PAYROLL ACME", 2000.0, "deposits"),
    ]


def test_text_lines_need_date_and_amount(spark):
    got = rows_of(P.parse_text_lines(typed(lines_of(spark, {(1, 1): BANK})), 2024))
    assert got == [(D(2024, 12, 10), "ATM CASH", 40.0, "withdrawals")]


def test_state_ends_with_the_page(spark):
    pages = {(1, 1): "Jan 5 SHOP 12.00\nPENDING WORDS", (1, 2): "NO DATE HERE 9.00\nJan 6 OTHER 3.00"}
    got = rows_of(P.parse_blocks(typed(lines_of(spark, pages)), 2024))
    assert got == [(D(2024, 1, 5), "SHOP", 12.0, None), (D(2024, 1, 6), "OTHER", 3.0, None)]


def test_statement_types(spark):
    pages = {
        (1, 1): "VISA\nminimum payment 10.00\ncredit limit 900.00",
        (2, 1): "chequing\noverdraft",
        (3, 1): "savings",
        (4, 1): "credit limit\nminimum payment\nsavings\nbranch",
    }
    got = {r.statement_id: r.statement_type for r in P.statement_types(lines_of(spark, pages)).collect()}
    assert got == {1: "credit_card", 2: "bank_account", 3: "unknown", 4: "credit_card"}


TABLE = "statement_id long, page_no long, tables array<array<array<string>>>"


def test_tables(spark):
    tables = [
        [["Date", "Description", "Amount", "Balance"], ["01/15/2024", "SHOP!", "12.00 DR", "1.00"], ["", "", "", ""], ["01/16/2024", "Closing Balance", "9.00", "9.00"]],
        [["Posted Date", "Details", "Withdrawals ($)", "Deposits ($)"], ["Jan 5, 2024", "RENT", "900.00", ""], ["Jan 6, 2024", "PAY", None, "2,000.00"], ["n/a", "X", "1.00", ""]],
        [["Name", "Value"], ["Jan 5, 2024", "7.00"]],
    ]
    rows = files.scan_statement_tables(spark.createDataFrame([(1, 1, tables)], TABLE))
    assert rows.count() == 10
    assert rows_of(P.parse_tables(rows, 2024)) == [
        (D(2024, 1, 15), "SHOP", -12.0, None),
        (D(2024, 1, 5), "RENT", -900.0, "withdrawals"),
        (D(2024, 1, 6), "PAY", 2000.0, "deposits"),
    ]


@pytest.mark.parametrize(
    ("headers", "expected"),
    [
        (["Transaction Date", "Transaction", "Amount"], (0, 1, None, None, 2)),
        (["Description", "Date", "CR", "DR"], (1, 0, 3, 2, None)),
        (["Date", "Description", "Description of credit", "Amount"], (0, 1, None, 2, 3)),
    ],
)
def test_header_roles(spark, headers, expected):
    rows = files.scan_statement_tables(spark.createDataFrame([(1, 1, [[headers]])], TABLE))
    r = P.table_roles(rows).first().roles
    assert (r.date, r.desc, r.debit, r.credit, r.amount) == expected


def test_strategies(spark):
    pages = {
        (1, 1): "Jan 5 SHOP 12.00 DR\nJan 5 SHOP 12.00 DR",
        (2, 1): "   ",
        (3, 1): "just words",
        (4, 1): "Jan 5 SHOP\n12.00",
        (5, 1): "Jan 5 SHOP 12.00",
    }
    table = [[["Date", "Description", "Amount"], ["01/15/2024", "FROM TABLE", "3.00"]]]
    tables = files.scan_statement_tables(spark.createDataFrame([(5, 1, table)], TABLE))
    txns, status = P.parse_statements(lines_of(spark, pages), tables, 2024)
    assert {r.statement_id: (r.strategy, r.n_transactions) for r in status.collect()} == {
        1: ("text+block", 1), 2: ("no_text", 0), 3: ("no_transactions", 0), 4: ("block", 1), 5: ("table", 1),
    }
    assert sorted((r.statement_id, r.description, r.amount) for r in txns.collect()) == [(1, "SHOP", -12.0), (4, "SHOP", 12.0), (5, "FROM TABLE", 3.0)]


def test_salted_statement_join(spark):
    lines = lines_of(spark, {(1, 1): BANK})
    assert P.parse_blocks(typed(lines), 2024).count() == 6


CAND = "statement_id long, transaction_date string, description string, amount double, raw_text string"


def cleanup(spark, kept, total=10, word="SHOP"):
    cand = spark.createDataFrame([(1, "2024-01-01", f"{word} {i}", -1.0 - i, f"raw {i}") for i in range(total)], CAND)
    clean = cand.where(F.col("amount") > -1.0 - kept).withColumn("transaction_type", F.lit("income"))
    return P.cleanup_apply(cand, clean)


def test_cleanup_guard(spark):
    assert cleanup(spark, 6).count() == 6 and cleanup(spark, 6).agg(F.min("amount")).first()[0] > 0  # 40% is not too much
    assert cleanup(spark, 5).count() == 10 and cleanup(spark, 5).agg(F.max("amount")).first()[0] < 0  # 50% is
    assert cleanup(spark, 5, word="Total fees").count() == 5  # unless all of it was metadata
    assert cleanup(spark, 0, word="Total fees").count() == 10  # never everything


def test_json_answers(spark):
    body = '```json\n{"transactions": [{"transaction_date": "2024-01-01", "description": "A", "amount": 5, "raw_text": "r1", "transaction_type": " Income"}, {"description": "no date", "amount": 1, "raw_text": "r2"}, {"transaction_date": "2024-01-01", "description": "A", "amount": "x", "raw_text": "r3"}]}\n```'
    answers = spark.createDataFrame([(1, 0, body), (1, 1, "oops"), (1, 2, '{"rows": []}')], "statement_id long, chunk_no long, body string")
    chunks = spark.createDataFrame([(1, c, "2024-01-01", "D", 1.0, f"c{c}") for c in range(3)], "statement_id long, chunk_no long, transaction_date string, description string, amount double, raw_text string")
    got = sorted((r.chunk_no, r.raw_text, r.amount, r.transaction_type) for r in files.ingest_json_rows(answers, chunks).collect())
    assert got == [(0, "r1", 5.0, "income"), (1, "c1", 1.0, None), (2, "c2", 1.0, None)]


def test_line_diagnostics(spark):
    r = P.line_diagnostics(lines_of(spark, {(1, 1): "\nJan 5 SHOP 12.00\nOpening Balance 5.00"})).orderBy("line_no").collect()
    assert [(x.date_at_start, x.is_summary, x.would_parse) for x in r] == [("Jan 5", False, True), (None, True, False)]


def plan_of(df):
    setting = "spark.sql.maxPlanStringLength"
    df.sparkSession.conf.set(setting, "100000000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        df.sparkSession.conf.unset(setting)


def test_texts_of_tables_are_worked_on_once(spark):
    header, row = ["Date", "Description", "Amount"], ["01/15/2024", "SHOP", "3.00"]
    pages = [(s, 1, [[header, row], [header, row, row], [[None, "Description"], row], [None, row]]) for s in range(50)]
    rows = files.scan_statement_tables(spark.createDataFrame(pages, TABLE))
    assert P.table_roles(rows).count() == 100
    parsed = P.parse_tables(rows, 2024)
    assert parsed.count() == 150
    plan = plan_of(parsed)
    assert plan.count("merchant|") == 1 and plan.count("(CR|DR)") <= 6  # patterns of headers and of amounts
    assert "Aggregate [cells" in plan  # a header is read once for all tables that have it


def test_transactions_are_finished_once(spark):
    txns, _ = P.parse_statements(lines_of(spark, {(1, 1): BANK}), spark.createDataFrame([], "statement_id long, page_no long, table_no long, row_no long, cells array<string>"), 2024)
    assert txns.count() == 6
    assert "Window" not in plan_of(txns)  # read from what was written, however often a caller reads it
