"""Statement-line columns: dates, amounts, noise, sections and signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.functions.text import TEXT_FLAGS, any_of, contains_any, let, strip

_MONTH = any_of(V.MONTHS)


def _with_months(patterns: list[str]) -> str:
    return any_of(patterns).replace("MONTH", _MONTH)


LEADING_DATE_RE = f"{TEXT_FLAGS}^(?:{_with_months(V.LEADING_DATE)})"
DATE_TOKEN_RE = f"{TEXT_FLAGS}({_with_months(V.DATE_TOKEN)})"
AMOUNT_RE = TEXT_FLAGS + V.AMOUNT
SUMMARY_RE = rf"{TEXT_FLAGS}\b({any_of(V.SUMMARY_LINE)})\b"
METADATA_RE = rf"{TEXT_FLAGS}\b({any_of(V.METADATA_PHRASES)})\b"
CONTACT_RE = TEXT_FLAGS + any_of(V.CONTACT_PHRASES)
CLEANUP_RE = rf"{TEXT_FLAGS}\b({any_of(V.CLEANUP_METADATA)})\b"


# ---- dates -------------------------------------------------------------------------------------------------


def match_date(line: Column) -> Column:
    """Date text at the start of a line, '' when there is none."""
    return F.regexp_extract(line, LEADING_DATE_RE, 0)


# Rewrites of a lower-case date text into year|month|day, each for one layout; an absent year stays empty.
DATE_LAYOUTS = [
    (r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$", "$1|$3|$4"),
    (r"^(1[3-9]|[2-9]\d)/(\d{1,2})/(\d{4}|\d{2})$", "$3|$2|$1"),  # day first only where month first fails
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", "$3|$1|$2"),
    (r"^(\d{1,2})/(\d{1,2})$", "|$1|$2"),
    (r"^([a-z]+) (\d{1,2})(?:,? (\d{4}))?$", "$3|$1|$2"),
    (rf"^({_MONTH})\. (\d{{1,2}}), (\d{{4}})$", "$3|$1|$2"),
    (r"^(\d{1,2}) ([a-z]+)(?: (\d{4}))?$", "$3|$2|$1"),
    (r"^(\d{1,2})-?([a-z]+)$", "|$2|$1"),
    (rf"^(\d{{1,2}})-({_MONTH})-(\d{{4}}|\d{{2}})$", "$3|$2|$1"),
]


MONTH_NUMBERS = {name: str(i) for names in (V.MONTHS, V.MONTH_NAMES) for i, name in enumerate(names, 1)}


def parse_date(raw: Column, ref_year: int) -> Column:
    """Date of a date text; `ref_year` completes one without a year. Null when no format fits.

    Month/day comes before day/month. A date without a year is checked in a common year, so 29 February
    without a year is no date.
    """
    text = F.regexp_replace(strip(F.rtrim(strip(F.lower(raw)), F.lit(","))), r"(?U)\s+", " ")
    for pattern, replacement in DATE_LAYOUTS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.when(raw != "", let(F.split(text, r"\|"), lambda parts: _date_of(parts, ref_year)))


def _date_of(parts: Column, ref_year: int) -> Column:
    year, month, day = (F.try_element_at(parts, F.lit(position)) for position in (1, 2, 3))
    century = F.when(year >= str(V.TWO_DIGIT_YEAR_PIVOT), "19").otherwise("20")
    full_year = F.when(year == "", str(ref_year)).when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
    numbers = F.create_map(*[F.lit(text) for pair in MONTH_NUMBERS.items() for text in pair])
    number = F.coalesce(F.try_element_at(numbers, month), month)
    stamp = F.concat_ws("-", full_year, number, day)
    leap_day_without_year = (year == "") & stamp.rlike("-0?2-29$")
    return F.when((F.size(parts) == 3) & ~leap_day_without_year, stamp.try_cast("date"))


# ---- amounts -----------------------------------------------------------------------------------------------


def find_amounts(line: Column) -> Column:
    """Every amount text of a line, each with exactly two decimals."""
    return F.regexp_extract_all(line, F.lit(AMOUNT_RE), F.lit(1))


def text_before_amount(line: Column) -> Column:
    """Part of a line before its first amount, '' when it has none."""
    return F.substring(line, F.lit(1), F.regexp_instr(line, F.lit(AMOUNT_RE)) - 1)


def _bare_number(raw: Column) -> Column:
    return F.regexp_replace(F.translate(strip(raw), " $,", ""), r"^[()]+|[()]+$", "")


def _without_suffix(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?iuU)\s*(CR|DR)\s*$", "")


def _to_number(text: Column) -> Column:
    plain = F.regexp_extract(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0)
    return F.nullif(plain, F.lit("")).try_cast("double")


def amount_size(raw: Column) -> Column:
    """Absolute value of an amount text, whatever its sign, symbol or suffix."""
    return F.abs(_to_number(F.regexp_replace(_bare_number(_without_suffix(raw)), "[A-Za-z]", "")))


def pick_amount(amounts: Column) -> Column:
    """The amount rather than the running balance: the first non-zero one before the last, else the last."""

    def picked(found: Column) -> Column:
        before_last = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
        nonzero = F.filter(before_last, lambda raw: amount_size(raw) != 0.0)
        return F.coalesce(F.try_element_at(nonzero, F.lit(1)), F.try_element_at(found, F.lit(-1)))

    return let(amounts, picked)


def parse_amount(raw: Column, context: Column | None = None) -> Column:
    """Signed value: brackets, then DR / CR, then an explicit sign, then words of `context`."""

    def signed(parts: Column) -> Column:
        value, body, suffix = parts["value"], parts["body"], parts["suffix"]
        bracketed = F.translate(body, " $,", "").rlike(r"^\(.*\)$")
        amount = (
            F.when(value.isNull(), F.lit(None).cast("double"))
            .when(bracketed | (suffix == "DR"), -F.abs(value))
            .when(suffix == "CR", F.abs(value))
            .when(body.rlike(r"^[+-]"), value)
        )
        if context is not None:
            amount = amount.when(context.rlike(TEXT_FLAGS + V.DEBIT_HINT), -F.abs(value)).when(
                context.rlike(TEXT_FLAGS + V.CREDIT_HINT), F.abs(value)
            )
        return amount.otherwise(value)

    def split(text: Column) -> Column:
        suffix = F.upper(F.regexp_extract(text, r"(?iuU)\s*(CR|DR)\s*$", 1))
        return let(
            strip(_without_suffix(text)),
            lambda body: F.struct(_to_number(_bare_number(body)).alias("value"), body.alias("body"), suffix.alias("suffix")),
        )

    return let(let(raw, split), signed)


# ---- line kinds --------------------------------------------------------------------------------------------


def is_summary_line(line: Column) -> Column:
    return line.rlike(SUMMARY_RE)


def has_amount_token(text: Column) -> Column:
    return text.rlike("(?U)" + V.AMOUNT_TOKEN)


def is_metadata_line(text: Column) -> Column:
    """Statement metadata rather than a transaction; contact text counts only without a date and an amount."""

    def judged(line: Column) -> Column:
        return (
            (line == "")
            | line.rlike("(?U)" + V.PHONE_ONLY)
            | line.rlike(TEXT_FLAGS + V.PAGE_LINE)
            | line.rlike(METADATA_RE)
            | (line.rlike(CONTACT_RE) & ~(line.rlike(DATE_TOKEN_RE) & has_amount_token(line)))
        )

    return let(strip(F.coalesce(text, F.lit(""))), judged)


def is_continuation_line(line: Column) -> Column:
    return let(
        strip(line),
        lambda text: (F.length(text) >= 3) & ~is_summary_line(text) & ~text.rlike(LEADING_DATE_RE) & text.rlike("[a-zA-Z]"),
    )


def is_probable_transaction_line(line: Column) -> Column:
    return let(
        strip(line),
        lambda text: (F.length(text) >= 10) & ~is_summary_line(text) & text.rlike(LEADING_DATE_RE) & text.rlike(AMOUNT_RE),
    )


def is_valid_row(date: Column, description: Column, amount: Column, raw_text: Column) -> Column:
    dated = strip(F.coalesce(date.cast("string"), F.lit(""))) != ""
    numeric = amount.try_cast("double").isNotNull()
    described = let(
        strip(F.coalesce(description, F.lit(""))),
        lambda text: (F.length(text) >= 2) & ~is_metadata_line(F.concat(text, F.lit(" "), F.coalesce(raw_text, F.lit("")))),
    )
    return dated & numeric & described


def cleanup_is_metadata(description: Column, raw_text: Column) -> Column:
    blob = F.concat(F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(raw_text, F.lit("")))
    return blob.rlike(CLEANUP_RE)


# ---- sections and signs ------------------------------------------------------------------------------------


def section_of(text: Column, sections: list[tuple[str, str]]) -> Column:
    """Section named by a short header line without an amount, else null; `text` has no outer white space."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, pattern in sections:
        found = found.when(text.rlike(rf"{TEXT_FLAGS}^\s*({pattern})\s*:?\s*$"), F.lit(key))
    return F.when((text != "") & (F.length(text) <= 40) & ~has_amount_token(text), found)


def detect_section(line: Column, statement_type: Column) -> Column:
    """Canonical section of a header line for its statement's type, else null."""
    return let(
        strip(line),
        lambda text: F.when(statement_type == "credit_card", section_of(text, V.CARD_SECTIONS)).when(
            statement_type == "bank_account", section_of(text, V.BANK_SECTIONS)
        ),
    )


def keyword_direction(text: Column, statement_type: Column) -> Column:
    """'credit', 'debit' or null, by ordered keyword lists over lower-case text."""
    return let(text, lambda blob: _direction(blob, statement_type))


def _direction(blob: Column, statement_type: Column) -> Column:
    card, bank = statement_type == "credit_card", statement_type == "bank_account"
    return (
        F.when(blob.rlike(TEXT_FLAGS + V.TRANSFER_SENT), "debit")
        .when(blob.rlike(TEXT_FLAGS + V.TRANSFER_RECEIVED), "credit")
        .when(blob.rlike(TEXT_FLAGS + V.INTEREST_CHARGED), "debit")
        .when(blob.rlike(TEXT_FLAGS + V.INTEREST_PAID), "credit")
        .when(contains_any(blob, V.ANY_CREDIT_WORDS), "credit")
        .when(contains_any(blob, V.ANY_DEBIT_WORDS), "debit")
        .when(card & contains_any(blob, V.CARD_CREDIT_WORDS), "credit")
        .when(card & contains_any(blob, V.CARD_DEBIT_WORDS), "debit")
        .when(bank & contains_any(blob, V.BANK_DEBIT_WORDS), "debit")
        .when(bank & contains_any(blob, V.BANK_CREDIT_WORDS), "credit")
    )


def normalize_sign(
    amount: Column,
    description: Column,
    statement_type: Column,
    section: Column,
    raw_text: Column,
    card_default: bool = True,
) -> Column:
    """Expense below zero, income above: CR/DR marker, section, keywords, card default, parsed sign."""
    raw = F.coalesce(raw_text, F.lit(""))
    blob = F.lower(F.concat(F.coalesce(description, F.lit("")), F.lit(" "), raw))
    place = F.lower(F.coalesce(section, F.lit("")))
    size = F.abs(amount)

    def by_words(direction: Column) -> Column:
        signed = F.when(direction == "credit", size).when(direction == "debit", -size)
        if card_default:
            signed = signed.when(statement_type == "credit_card", -size)
        return signed.otherwise(amount)

    return (
        F.when(raw.rlike(r"(?U)\bCR\b"), size)
        .when(raw.rlike(r"(?U)\bDR\b"), -size)
        .when(place.isin(V.CREDIT_SECTIONS), size)
        .when(place.isin(V.DEBIT_SECTIONS), -size)
        .otherwise(let(keyword_direction(blob, statement_type), by_words))
    )


def sign_by_type(amount: Column, transaction_type: Column) -> Column:
    """Sign enforced by a given type; an unknown type leaves the amount alone."""
    kind = F.lower(strip(F.coalesce(transaction_type, F.lit(""))))
    return F.when(kind == "expense", -F.abs(amount)).when(kind == "income", F.abs(amount)).otherwise(amount)


