"""Text columns: merchant keys, categories, redaction, money."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V

TEXT_FLAGS = "(?iuU)"  # case-insensitive, Unicode word and space classes


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(patterns: list[str]) -> str:
    return "|".join(patterns)


def strip(text: str | Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.trim(_col(text), F.lit(V.WHITE_SPACE))


def is_blank(text: str | Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def words(text: str | Column) -> Column:
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda word: word != "")


def contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def normalize_merchant(raw: str | Column) -> Column:
    """Stable lower-case key of a merchant text; empty when nothing is left."""
    tlds = any_of(V.TOP_LEVEL_DOMAINS)
    text = F.translate(F.coalesce(_col(raw), F.lit("")), "*", " ")
    host = rf"{TEXT_FLAGS}\b(?:\w+\.)*(?!(?:{tlds})\b)(\w+)(?:\.(?:{tlds}))+\b"
    branded = F.regexp_replace(text, host, " $1 ")
    branded = F.regexp_replace(branded, rf"{TEXT_FLAGS}\b(?:{tlds})(?:\.(?:{tlds}))+\b", " ")
    text = F.when(F.contains(text, F.lit(".")), branded).otherwise(text)  # no host without a dot
    text = F.regexp_replace(text, rf"{TEXT_FLAGS}\b(?:{any_of(V.STORE_WORDS)})\s*\d+\b", " ")
    text = F.regexp_replace(text, r"(?U)#\S+", " ")
    text = F.lower(F.regexp_replace(text, r"(?U)\b\d+\b", " "))
    text = F.regexp_replace(text, rf"{TEXT_FLAGS}\b(?:{any_of(V.COMPANY_WORDS)})\b", " ")
    text = F.regexp_replace(text, r"(?U)[^\w\s-]", " ")
    return F.array_join(F.slice(F.array_distinct(words(text)), 1, V.MERCHANT_KEY_WORDS), " ")


def normalize_category(name: str | Column) -> Column:
    kept = F.regexp_replace(strip(F.lower(_col(name))), r"(?U)[^a-z0-9\s]", "")
    return F.regexp_replace(kept, r"(?U)\s+", "_")


def validate_category(name: str | Column) -> Column:
    """At most three words, `&` spelled out, `Other` when blank."""

    def repaired(text: Column) -> Column:
        parts = words(text)
        short = F.when(
            F.size(parts) > V.CATEGORY_WORDS, F.array_join(F.slice(parts, 1, V.CATEGORY_WORDS), " ")
        ).otherwise(text)
        return F.when(text == "", F.lit(V.DEFAULT_CATEGORY)).otherwise(F.replace(short, F.lit("&"), F.lit("and")))

    return let(strip(F.coalesce(_col(name), F.lit(""))), repaired)


def valid_type_or(text: str | Column, default: str) -> Column:
    value = F.lower(strip(F.coalesce(_col(text), F.lit(""))))
    return F.when(value.isin(V.TRANSACTION_TYPES), value).otherwise(F.lit(default))


def validate_confidence(raw: str | Column) -> Column:
    parsed = F.coalesce(_col(raw).try_cast("double"), F.lit(V.DEFAULT_CONFIDENCE))
    return F.round(F.least(F.greatest(parsed, F.lit(0.0)), F.lit(1.0)), 2)


def validate_reason(raw: str | Column) -> Column:
    text = strip(F.coalesce(_col(raw), F.lit("")))
    return F.when(text == "", F.lit(V.DEFAULT_CLASSIFICATION_REASON)).otherwise(text)


def normalize_text(text: str | Column) -> Column:
    """Control characters and runs of white space become one space."""
    spaced = F.regexp_replace(_col(text), r"[\x00-\x1f\x7f]", " ")
    return strip(F.regexp_replace(spaced, r"(?U)\s+", " "))


def clean_description(text: str | Column) -> Column:
    """From the first letter, digit or opening bracket to the last letter, digit or closing one."""
    cleaned = F.regexp_replace(normalize_text(text), r"^[^a-zA-Z0-9(]+", "")
    return F.regexp_extract(cleaned, r"(?s)^.*[a-zA-Z0-9)]", 0)  # from the end backwards: looking for the tail takes the text's length squared


def is_reference_code(token: str | Column) -> Column:
    """At least eight letters and digits, with one of each."""
    word = strip(token)
    return word.rlike(r"^(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{8,}$")


def drop_reference_codes(text: str | Column) -> Column:
    return F.array_join(F.filter(words(text), lambda word: ~is_reference_code(word)), " ")


def redact_digits(text: str | Column, run: int = 5) -> Column:
    """Replace every run of at least `run` digits (5 for statements, 6 for the cleanup audit)."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"(?U)\d{{{run},}}", "[redacted]")


def strip_code_fences(text: str | Column) -> Column:
    return strip(F.regexp_replace(_col(text), r"(?m)^```(?:json)?\s*|\s*```$", ""))


def format_money(amount: str | Column, decimals: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(_col(amount), decimals))


def dedupe_key(date: str | Column, description: str | Column, amount: str | Column) -> Column:
    """date | lower-case description with single spaces | absolute amount; a bad amount counts as 0."""
    text = F.regexp_replace(F.lower(strip(F.coalesce(_col(description), F.lit("")))), r"(?U)\s+", " ")
    size = F.round(F.abs(F.coalesce(_col(amount).try_cast("double"), F.lit(0.0))), 2)
    return F.concat_ws("|", F.coalesce(_col(date).cast("string"), F.lit("None")), text, F.format_string("%.2f", size))
