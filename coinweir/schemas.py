"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _L, _I, _B, _TS = (
    T.StringType(),
    T.DoubleType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)

CATEGORIES = _schema(("id", _L), ("name", _S), ("normalized_name", _S), ("transaction_type", _S), ("created_at", _TS))
TRANSACTIONS = _schema(
    ("id", _L), ("user_id", _S), ("merchant", _S), ("amount", _D), ("notes", _S), ("transaction_type", _S),
    ("category_id", _L), ("category_name", _S), ("confidence", _D), ("reason", _S), ("created_at", _TS),
    ("is_anomaly", _B), ("anomaly_status", _S), ("anomaly_score", _D), ("anomaly_reason", _S),
    ("anomaly_checked_at", _TS), ("ml_model_version", _S),
)
MERCHANT_CACHE = _schema(
    ("user_id", _S), ("normalized_merchant", _S), ("transaction_type", _S), ("category_name", _S),
    ("normalized_category", _S), ("confidence", _D), ("reason", _S), ("source", _S), ("created_at", _TS),
    ("updated_at", _TS),
)
CLASSIFICATION = _schema(
    ("transaction_type", _S), ("category_name", _S), ("normalized_category", _S), ("confidence", _D), ("reason", _S)
)
STATEMENT_UPLOADS = _schema(
    ("id", _S), ("user_id", _S), ("file_name", _S), ("status", _S), ("total_transactions", _L),
    ("imported_transactions", _L), ("failed_transactions", _L), ("created_at", _TS),
)
LABELLED = _schema(
    ("transaction_id", _S), ("user_id", _S), ("transaction_date", _TS), ("merchant", _S), ("amount", _D),
    ("category", _S), ("transaction_type", _S), ("notes", _S), ("is_anomaly", _I),
)
IMPORT_ROWS = _schema(("transaction_date", _S), ("description", _S), ("amount", _D), ("raw_text", _S))
STATEMENT_LINES = _schema(("statement_id", _L), ("page_no", _L), ("line_no", _L), ("line", _S))
STATEMENT_TABLES = T.StructType(
    [
        *_schema(("statement_id", _L), ("page_no", _L), ("table_no", _L), ("row_no", _L)).fields,
        T.StructField("cells", T.ArrayType(_S), True),
    ]
)
# Rows of a cleanup answer: text fields, so that one bad value drops its row and not the whole answer.
CLEANUP_ANSWER = T.StructType(
    [
        T.StructField(
            "transactions",
            T.ArrayType(
                _schema(
                    ("transaction_date", _S), ("description", _S), ("amount", _S), ("raw_text", _S), ("transaction_type", _S)
                )
            ),
        )
    ]
)
EVENTS = _schema(("event_id", _L), ("ts", T.TimestampType()), ("user_id", _L), ("event_type", _S), ("value", _D), ("props", _S))
