"""Row checks that never abort a job: every bad row keeps its reason in an error column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.functions import text as X
from coinweir.functions.text import is_blank, strip


def parse_timestamp(text: str | Column) -> Column:
    """ISO date or date-time; a bare date or a time without a zone is UTC. Null when it does not parse."""
    value = strip(F.col(text) if isinstance(text, str) else text)
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    zoned = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & value.rlike(r"\d{2}:\d{2}")
    instant = (
        F.when(F.length(value) == 10, F.concat(value, F.lit("T00:00:00Z")))
        .when(zoned, value)
        .otherwise(F.concat(value, F.lit("Z")))
    )
    return F.when(iso, F.try_to_timestamp(instant))


def validate_import_rows(rows: DataFrame) -> DataFrame:
    """Adds description, created_at, transaction_type (by sign) and `error`, null for a good row."""
    checked = rows.withColumns(
        {
            "description": strip(F.coalesce("description", F.lit(""))),
            "created_at": parse_timestamp(F.coalesce("transaction_date", F.lit(""))),
            "transaction_type": F.when(F.col("amount") < 0, "expense").otherwise("income"),
        }
    )
    error = (
        F.when(F.col("description") == "", "description is empty")
        .when(F.col("amount").isNull() | F.isnan("amount") | (F.abs("amount") == float("inf")), "amount is missing")
        .when(F.col("amount") == 0, "amount is zero")
        .when(is_blank("transaction_date"), "empty transaction_date")
        .when(F.col("created_at").isNull(), "invalid transaction_date")
    )
    return checked.withColumn("error", error)


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull()).drop("error")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNotNull())


def validate_manual_rows(rows: DataFrame) -> DataFrame:
    """A given type must be expense or income; without one the sign decides."""
    given = F.lower(strip("transaction_type"))
    by_sign = F.when(F.col("amount") < 0, "expense").otherwise("income")
    known = given.isin(V.TRANSACTION_TYPES)
    return rows.withColumn(
        "error",
        F.when(F.col("transaction_type").isNotNull() & ~known, "transaction_type must be 'expense' or 'income'"),
    ).withColumn("transaction_type", F.when(F.col("transaction_type").isNull(), by_sign).when(known, given))


def validate_entry_form(rows: DataFrame) -> DataFrame:
    """One message per field of a manual entry form; amount is text here."""
    number = F.trim("amount").try_cast("double")
    return rows.withColumns(
        {
            "merchant_error": F.when(is_blank("merchant"), "Merchant is required"),
            "amount_error": F.when(is_blank("amount"), "Amount is required")
            .when(number.isNull(), "Enter a valid decimal number")
            .when(number <= 0, "Amount must be greater than zero"),
            "notes_error": F.when(is_blank("notes"), "Notes is required"),
        }
    )


def validate_classification(raw: DataFrame) -> DataFrame:
    """Repair classifier answers: type, category, confidence in [0, 1] and reason."""
    category = X.validate_category("category_name")
    return raw.withColumns(
        {
            "transaction_type": X.valid_type_or("transaction_type", "expense"),
            "category_name": category,
            "normalized_category": X.normalize_category(category),
            "confidence": X.validate_confidence("confidence"),
            "reason": X.validate_reason("reason"),
        }
    )


CLASSIFICATION_KEYS = ["transaction_type", "category_name", "normalized_category", "confidence", "reason"]


def classification_shape_ok(payload: str | Column) -> Column:
    """True when a JSON answer carries all five keys."""
    keys = F.json_object_keys(F.col(payload) if isinstance(payload, str) else payload)
    return F.coalesce(F.size(F.array_intersect(keys, F.lit(CLASSIFICATION_KEYS))) == len(CLASSIFICATION_KEYS), F.lit(False))
