import datetime
import time

import pytest
from pyspark.sql import functions as F

from coinweir.functions import statement_text as S
from coinweir.functions import text as X

D = datetime.date


def column(spark, values, kind, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_merchant_keys(spark):
    goldens = {
        "STARBUCKS #4421 TORONTO": "starbucks toronto",
        "WALMART STORE 3154": "walmart",
        "UBER TRIP HELP.UBER.COM": "uber",
        "AMAZON.CA": "amazon",
        "TIM HORTONS #1234": "tim hortons",
        "PAYPAL *SPOTIFY": "paypal spotify",
        "BEST BUY INC": "best buy",
        "DOLLAR STORE": "dollar store",
        "foo.co.uk": "foo",
        "CO.UK x": "x",
        "one two three four": "one two three",
        "   ": "",
    }
    assert column(spark, list(goldens), "string", X.normalize_merchant) == list(goldens.values())
    assert column(spark, [None], "string", X.normalize_merchant) == [""]


def test_reference_codes(spark):
    tokens = ["2c7a84ec8cce32f8", "C1AuK29Mzuxg", "TIRTHKUMARPANCHAL", "OPENAI*CHATGPT", "12345678", "A1B2C3"]
    assert column(spark, tokens, "string", X.is_reference_code) == [True, True, False, False, False, False]


def test_amounts(spark):
    goldens = {"-5.00": -5.0, "(5.00)": -5.0, "5.00DR": -5.0, "100.00 CR": 100.0, "$1,234.50": 1234.5, "+7.10": 7.1, "abc": None, "": None}
    assert column(spark, list(goldens), "string", S.parse_amount) == list(goldens.values())
    with_words = lambda v: S.parse_amount(F.lit("5.00"), v)
    assert column(spark, ["VisaDebitpurchase", "payroll", "shop", "e-Transfersent"], "string", with_words) == [-5.0, 5.0, 5.0, -5.0]


def test_amount_choice(spark):
    lines = ["SHOP 12.00 100.00", "SHOP 0.00 100.00", "SHOP 7.00", "call 416-967-1111", "x 1,234.50CR"]
    found = lambda v: F.coalesce(F.trim(S.pick_amount(S.find_amounts(v))), F.lit("-"))
    assert column(spark, lines, "string", found) == ["12.00", "100.00", "7.00", "-", "1,234.50CR"]


DATES = {
    "01/15/2024": D(2024, 1, 15), "15/01/2024": D(2024, 1, 15), "1/5/70": D(1970, 1, 5), "1/5/68": D(2068, 1, 5),
    "2024-01-05": D(2024, 1, 5), "2024/1/5": D(2024, 1, 5), "Jan 5, 2024": D(2024, 1, 5), "jan  5 2024": D(2024, 1, 5),
    "January 5, 2024": D(2024, 1, 5), "5 Jan 2024": D(2024, 1, 5), "05-Jan-2024": D(2024, 1, 5), "05-Jan-24": D(2024, 1, 5),
    "Jan. 5, 2024": D(2024, 1, 5), "10Dec": D(2024, 12, 10), "11/18": D(2024, 11, 18), "Nov 18": D(2024, 11, 18),
    "18 November": D(2024, 11, 18), "18-Nov": D(2024, 11, 18), "02/29/2024": D(2024, 2, 29), "Jan 5,": D(2024, 1, 5),
    "29Feb": None, "Feb 29": None, "02/29": None, "Sept 5": None, "Jan. 5": None, "31Apr": None, "04/31/2024": None,
    "18/11": None, "01-15-2024": None, "18-January-2024": None, "2024-13-01": None, "": None,
}


def test_dates(spark):
    assert column(spark, list(DATES), "string", lambda v: S.parse_date(v, 2024)) == list(DATES.values())


def test_leading_date(spark):
    lines = ["01/15/2024 SHOP", "Jan 5 SHOP", "10Dec SHOP", "SHOP 10Dec", "05-Jan-24 X"]
    assert column(spark, lines, "string", S.match_date) == ["01/15/2024", "Jan 5", "10Dec", "", "05-Jan-24"]


def test_metadata_lines(spark):
    lines = {
        "Apr 06 PIZZA PIZZA LIMITED 416-967-1111": False,
        "Apr 06 visit us 12.00": False,
        "visit us at www.bank.com": True,
        "New Balance $1,234.56": True,
        "416-967-1111": True,
        "Page 2 of 9": True,
        "": True,
        "Monthly fee 4.00": False,
    }
    assert column(spark, list(lines), "string", S.is_metadata_line) == list(lines.values())


@pytest.mark.parametrize(
    ("description", "kind", "section", "raw", "expected"),
    [
        ("e-Transfersent", "bank_account", None, "e-Transfersent 32.98", -32.98),
        ("e-Transfer-Autodeposit", "bank_account", None, "e-Transfer-Autodeposit 32.98", 32.98),
        ("SHOP", "credit_card", None, "SHOP 32.98", -32.98),
        ("SHOP", "credit_card", "payments", "SHOP 32.98", 32.98),
        ("SHOP", "unknown", None, "SHOP 32.98 DR", -32.98),
        ("credit card payment", "bank_account", None, "x", -32.98),
        ("SHOP", "unknown", None, "x", 32.98),
    ],
)
def test_signs(spark, description, kind, section, raw, expected):
    amount = S.normalize_sign(F.lit(32.98), F.lit(description), F.lit(kind), F.lit(section).cast("string"), F.lit(raw))
    assert spark.range(1).select(amount.alias("a")).first().a == expected


def test_sections(spark):
    one = lambda line, kind: spark.range(1).select(S.detect_section(F.lit(line), F.lit(kind)).alias("s")).first().s
    assert one("Deposits and Credits:", "bank_account") == "deposits"
    assert one("Purchases and adjustments", "credit_card") == "purchases"
    assert one("Deposits 12.00", "bank_account") is None
    assert one("Deposits", "unknown") is None


def test_white_space_and_redaction(spark):
    assert column(spark, ["  a\tb \x0b"], "string", X.normalize_text) == ["a b"]
    assert column(spark, ["acct 123456 x1234"], "string", X.redact_digits) == ["acct [redacted] x1234"]
    assert column(spark, ["12345 123456"], "string", lambda v: X.redact_digits(v, 6)) == ["12345 [redacted]"]
    assert column(spark, ['```json\n{"a": 1}\n```'], "string", X.strip_code_fences) == ['{"a": 1}']


def test_descriptions_are_cut_in_linear_time(spark):
    texts = [("*- shop 12 (x) -- !", "shop 12 (x)"), ("--", ""), ("", ""), (None, None), ("(a", "(a"), ("a\n)", "a )"), ("é a é", "a"), ("a ", "a")]
    got = spark.createDataFrame(texts, "text string, wanted string").select(X.clean_description("text").alias("got"), "wanted")
    assert got.where(~F.equal_null("got", "wanted")).count() == 0
    long = spark.range(40).select(F.concat(F.lit("a"), F.repeat(F.lit("-"), 60_000), F.col("id").cast("string")).alias("text"))
    began = time.time()
    assert long.select(F.length(X.clean_description("text")).alias("n")).where("n > 60000").count() == 40
    assert time.time() - began < 10
