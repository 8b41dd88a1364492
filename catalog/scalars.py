"""Text, category, sign and validation columns over whole tables."""

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.book import enter
from coinweir.functions import fixed_values as V
from coinweir.functions import statement_text as S
from coinweir.functions import text as X
from coinweir.operators import validation as C


def docs(s, d):
    return T.read(s, d, "documents").select("doc_id", "text")


# RE2 has no look-ahead, so the checks say the same in its terms; \\s and \\d are ASCII there.
MERCHANT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(
    regexp_replace({0}, '(?i)\b(?:store|shop|location|branch|no\.?)\s*\d+\b', ' ', 'g'), '#\S+', ' ', 'g'), '\b\d+\b', ' ', 'g')),
    '(?i)\b(?:inc|ltd|corp|llc|trip)\b', ' ', 'g'), '[^\w\s-]', ' ', 'g'), '\s+', ' ', 'g')"""
KEY_SQL = "array_to_string(list_slice(list_filter(string_split(trim({0}), ' '), lambda w, i: w <> '' AND list_position(string_split(trim({0}), ' '), w) = i), 1, 3), ' ')"


def merchant_key_sql(raw: str) -> str:
    return KEY_SQL.format(MERCHANT_SQL.format(f"replace({raw}, '*', ' ')"))


enter(
    "normalize_merchant",
    lambda s, d: T.raw_merchants(s, d).select("l_orderkey", "l_linenumber", "raw", X.normalize_merchant("raw").alias("merchant_key")),
    f"WITH {T.RAW_MERCHANTS} SELECT l_orderkey, l_linenumber, raw, {merchant_key_sql('raw')} AS merchant_key FROM raw_merchants",
)
# A host of the page table: its last label before the top-level domain is the brand; the number is dropped.
enter(
    "normalize_merchant_url",
    lambda s, d: T.read(s, d, "pages").select(
        "page_id",
        X.normalize_merchant(F.concat(F.lit("STORE 12 "), F.upper(F.regexp_extract("url", "//([^/?#]+)", 1)), F.lit(" #A-9 77"))).alias("merchant_key"),
    ),
    rf"""SELECT page_id, {KEY_SQL.format("trim(regexp_replace(regexp_replace(host, '[^a-zA-Z0-9_ -]', ' ', 'g'), ' +', ' ', 'g'))")} AS merchant_key FROM (
      SELECT page_id, regexp_replace(lower(regexp_extract(url, '//([^/?#]+)', 1)), '(^|[^\w])(?:\w+\.)*(\w+)\.(?:{"|".join(V.TOP_LEVEL_DOMAINS)})$', '\1 \2 ') AS host FROM pages)""",
)
# Raw categories: order priorities such as '4-NOT SPECIFIED' and long, punctuated labels.
RAW_CATEGORY = "CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '  Food & Drinks ' WHEN 2 THEN o_orderpriority || ' & very  long label' ELSE ' ' END"


def raw_categories(s, d):
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.col("o_orderpriority"))
        .when(k == 1, "  Food & Drinks ")
        .when(k == 2, F.concat("o_orderpriority", F.lit(" & very  long label")))
        .otherwise(" ")
    )
    return T.read(s, d, "orders").select("o_orderkey", text.alias("raw"), "o_totalprice", "o_orderstatus")


NORM_CATEGORY = r"regexp_replace(regexp_replace(trim(lower({0})), '[^a-z0-9\s]', '', 'g'), '\s+', '_', 'g')"
VALID_CATEGORY = r"""CASE WHEN trim({0}) = '' THEN 'Other' ELSE replace(CASE WHEN len(string_split_regex(trim({0}), '\s+')) > 3
  THEN array_to_string(list_slice(string_split_regex(trim({0}), '\s+'), 1, 3), ' ') ELSE trim({0}) END, '&', 'and') END"""
enter(
    "normalize_category",
    lambda s, d: raw_categories(s, d).select("o_orderkey", X.normalize_category("raw").alias("normalized")),
    f"SELECT o_orderkey, {NORM_CATEGORY.format(RAW_CATEGORY)} AS normalized FROM orders",
)
enter(
    "validate_category",
    lambda s, d: raw_categories(s, d).select("o_orderkey", X.validate_category("raw").alias("category")),
    f"SELECT o_orderkey, {VALID_CATEGORY.format('raw')} AS category FROM (SELECT o_orderkey, {RAW_CATEGORY} AS raw FROM orders)",
)
ANSWERS = f"""answers AS (SELECT o_orderkey, {RAW_CATEGORY} AS category_name,
  CASE o_orderkey % 3 WHEN 0 THEN ' Income ' WHEN 1 THEN 'EXPENSE' ELSE 'gift' END AS transaction_type,
  CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN '1.7' WHEN 2 THEN '-0.2' ELSE CAST(o_orderkey % 97 / 100.0::DOUBLE AS VARCHAR) END AS confidence,
  CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE ' by name ' END AS reason FROM orders)"""


def answers(s, d):
    k = F.col("o_orderkey")
    return raw_categories(s, d).select(
        "o_orderkey",
        F.col("raw").alias("category_name"),
        F.when(k % 3 == 0, " Income ").when(k % 3 == 1, "EXPENSE").otherwise("gift").alias("transaction_type"),
        F.when(k % 5 == 0, "high").when(k % 5 == 1, "1.7").when(k % 5 == 2, "-0.2").otherwise((k % 97 / F.lit(100.0)).cast("string")).alias("confidence"),
        F.when(k % 2 == 0, " ").otherwise(" by name ").alias("reason"),
    )


enter(
    "validate_classification",
    lambda s, d: C.validate_classification(answers(s, d)),
    f"""WITH {ANSWERS}, v AS (SELECT *, {VALID_CATEGORY.format('category_name')} AS category FROM answers)
      SELECT o_orderkey, category AS category_name, CASE WHEN trim(lower(transaction_type)) IN ('income', 'expense') THEN trim(lower(transaction_type)) ELSE 'expense' END AS transaction_type,
        round(least(greatest(coalesce(TRY_CAST(confidence AS DOUBLE), 0.5), 0.0), 1.0), 2) AS confidence,
        CASE WHEN trim(reason) = '' THEN 'Classified based on merchant name.' ELSE trim(reason) END AS reason,
        {NORM_CATEGORY.format('category')} AS normalized_category FROM v""",
)


def _payload(s, d):
    keep = lambda divisor, value: F.when(F.col("o_orderkey") % divisor != 0, value)
    return answers(s, d).select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 == 0, "not json").otherwise(
            F.to_json(
                F.struct(
                    keep(7, F.col("transaction_type")).alias("transaction_type"),
                    "category_name",
                    keep(5, F.lit("x")).alias("normalized_category"),
                    "confidence",
                    "reason",
                )
            )
        ).alias("payload"),
    )


enter(
    "classification_shape_ok",
    lambda s, d: _payload(s, d).select("o_orderkey", C.classification_shape_ok("payload").alias("ok")),
    "SELECT o_orderkey, o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS ok FROM orders",
)
enter(
    "normalize_text",
    lambda s, d: docs(s, d).select("doc_id", F.md5(X.normalize_text("text")).alias("digest")),
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '[\s\x{0b}\x{85}\p{Z}]+', ' ', 'g'))) AS digest FROM documents""",
)
enter(
    "clean_description",
    lambda s, d: docs(s, d).select("doc_id", F.md5(X.clean_description("text")).alias("digest")),
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '[\s\x{0b}\x{85}\p{Z}]+', ' ', 'g')),
      '^[^a-zA-Z0-9(]+', ''), '[^a-zA-Z0-9)]+$', ''))) AS digest FROM documents""",
)


def tokens(s, d):
    return docs(s, d).select("doc_id", F.explode(X.words("text")).alias("token"))


TOKENS = r"tokens AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\s\x{0b}\x{85}\p{Z}]+'), lambda w: w <> '')) AS token FROM documents)"
IS_CODE = "regexp_full_match({0}, '[A-Za-z0-9]{{8,}}') AND regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Za-z]')"
enter(
    "is_reference_code",
    lambda s, d: tokens(s, d).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count(F.when(X.is_reference_code("token"), 1)).alias("n_codes")),
    f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(*) FILTER ({IS_CODE.format('token')}) AS n_codes FROM tokens GROUP BY doc_id",
)
# Descriptions with a code between words: the document id as eight digits behind REF.
enter(
    "clean_prefix",
    lambda s, d: T.raw_merchants(s, d).select(
        "l_orderkey",
        "l_linenumber",
        X.drop_reference_codes(F.concat(F.upper("p_name"), F.lit("  REF"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit(" "), F.col("l_orderkey").cast("string"))).alias("prefix"),
    ),
    f"WITH {T.RAW_MERCHANTS} SELECT l_orderkey, l_linenumber, upper(p_name) || ' ' || l_orderkey AS prefix FROM raw_merchants",
)
for runs in (5, 6):
    enter(
        "redact_digits" if runs == 5 else "redact_digits_cleanup",
        lambda s, d, runs=runs: docs(s, d).select("doc_id", F.md5(X.redact_digits("text", runs)).alias("digest"), X.redact_digits("text", runs).contains("[redacted]").alias("redacted")),
        rf"SELECT doc_id, md5(regexp_replace(text, '[0-9]{{{runs},}}', '[redacted]', 'g')) AS digest, contains(regexp_replace(text, '[0-9]{{{runs},}}', '[redacted]', 'g'), '[redacted]') AS redacted FROM documents",
    )
enter(
    "strip_fences",
    lambda s, d: T.read(s, d, "events").select("event_id", X.strip_code_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("body")),
    "SELECT event_id, props AS body FROM events",
)
enter(
    "dedupe_key",
    lambda s, d: T.txn_orders(s, d).select(
        "id", X.dedupe_key(F.to_date("created_at"), F.concat(F.lit("  "), "category_name", F.lit("   x ")), F.when(F.col("id") % 9 == 0, "n/a").otherwise((-F.col("amount")).cast("string"))).alias("key")
    ),
    rf"""WITH {T.TXN_ORDERS} SELECT id, strftime(created_at, '%Y-%m-%d') || '|' || regexp_replace(lower(category_name), '\s+', ' ', 'g') || ' x|'
      || CASE WHEN id % 9 = 0 THEN '0.00' ELSE format('{{:.2f}}', amount) END AS key FROM txn""",
)

# ---- noise filters over every document line ----------------------------------------------------------------


def lines(s, d):
    return docs(s, d).select("doc_id", F.posexplode(F.split("text", r"\R")).alias("line_no", "line"))


LINES = r"lines AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x{0b}\x{0c}\r\x{85}\x{2028}\x{2029}]') AS p FROM documents))"


def _re2(patterns):
    return "|".join(patterns).replace("'", "''")


_MONTHS = "|".join(V.MONTHS)
_DATE = _re2(V.DATE_TOKEN).replace("MONTH", _MONTHS)
IS_META = rf"""(trim({{0}}) = '' OR regexp_matches(trim({{0}}), '{V.PHONE_ONLY}') OR regexp_matches(trim({{0}}), '(?i){V.PAGE_LINE}')
  OR regexp_matches(lower({{0}}), '\b({_re2(V.METADATA_PHRASES)})\b')
  OR (regexp_matches(lower({{0}}), '{_re2(V.CONTACT_PHRASES)}') AND NOT (regexp_matches(lower({{0}}), '{_DATE}') AND regexp_matches({{0}}, '{V.AMOUNT_TOKEN}'))))"""
IS_META = IS_META.replace("{7,}", "{{7,}}").replace("{1,2}", "{{1,2}}").replace("{2,4}", "{{2,4}}").replace("{4}", "{{4}}").replace("{1,3}", "{{1,3}}").replace("{3}", "{{3}}").replace("{2}", "{{2}}")
# Lines that look like statement lines: a document line behind a phrase chosen by its number.
PHRASES = ["", "Opening Balance ", "Apr 06 PIZZA 416-967-1111 12.50 call us ", "visit us ", "Page 3 of 9", "416-967-1111"]
PHRASE_SQL = "CASE (doc_id + line_no) % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END || CASE WHEN (doc_id + line_no) % 6 >= 4 THEN '' ELSE line END"


def noisy_lines(s, d):
    k = (F.col("doc_id") + F.col("line_no")) % 6
    phrase = F.element_at(F.lit(PHRASES), (k + 1).cast("int"))
    return lines(s, d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.concat(phrase, F.when(k >= 4, "").otherwise(F.col("line"))).alias("line"))


NOISY = f"{LINES}, noisy AS (SELECT doc_id, line_no, {PHRASE_SQL} AS line FROM lines)"
enter(
    "is_metadata_line",
    lambda s, d: noisy_lines(s, d).select("doc_id", "line_no", S.is_metadata_line(F.col("line")).alias("is_metadata")),
    f"WITH {NOISY} SELECT doc_id, line_no, {IS_META.format('line')} AS is_metadata FROM noisy",
)
SUMMARY = _re2(V.SUMMARY_LINE).replace(r"\#", "#")
enter(
    "is_summary_line",
    lambda s, d: noisy_lines(s, d).select("doc_id", "line_no", S.is_summary_line(F.col("line")).alias("is_summary")),
    rf"WITH {NOISY} SELECT doc_id, line_no, regexp_matches(line, '(?i)\b({SUMMARY})\b') AS is_summary FROM noisy",
)
enter(
    "cleanup_is_metadata",
    lambda s, d: noisy_lines(s, d).select("doc_id", "line_no", S.cleanup_is_metadata(F.lit("Total"), F.col("line")).alias("is_metadata"), S.cleanup_is_metadata(F.col("line"), F.lit("")).alias("alone")),
    rf"WITH {NOISY} SELECT doc_id, line_no, TRUE AS is_metadata, regexp_matches(line || ' ', '(?i)\b({_re2(V.CLEANUP_METADATA)})\b') AS alone FROM noisy",
)
LEAD = _re2(V.LEADING_DATE).replace("MONTH", _MONTHS)
# The amount pattern without look-around: the neighbours are matched instead.
ANY_AMOUNT = r"(?:^|[^,\d])(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}(?:[^,\d]|$)"
enter(
    "is_probable_txn_line",
    lambda s, d: noisy_lines(s, d).select("doc_id", "line_no", S.is_probable_transaction_line(F.col("line")).alias("probable")),
    rf"""WITH {NOISY} SELECT doc_id, line_no, length(trim(line)) >= 10 AND NOT regexp_matches(trim(line), '(?i)\b({SUMMARY})\b')
      AND regexp_matches(trim(line), '(?i)^(?:{LEAD})') AND regexp_matches(trim(line), '{ANY_AMOUNT}') AS probable FROM noisy""",
)
enter(
    "is_continuation_line",
    lambda s, d: noisy_lines(s, d).select("doc_id", "line_no", S.is_continuation_line(F.col("line")).alias("continues")),
    rf"""WITH {NOISY} SELECT doc_id, line_no, length(trim(line)) >= 3 AND NOT regexp_matches(trim(line), '(?i)\b({SUMMARY})\b')
      AND NOT regexp_matches(trim(line), '(?i)^(?:{LEAD})') AND regexp_matches(line, '[a-zA-Z]') AS continues FROM noisy""",
)
enter(
    "valid_statement_row",
    lambda s, d: noisy_lines(s, d).select(
        "doc_id", "line_no",
        S.is_valid_row(F.when(F.col("line_no") % 7 != 0, F.lit("2024-01-01")), F.col("line"), F.when(F.col("line_no") % 5 != 0, F.lit("12.00")).otherwise("x"), F.lit("")).alias("valid"),
    ),
    f"""WITH {NOISY} SELECT doc_id, line_no, line_no % 7 <> 0 AND line_no % 5 <> 0 AND length(trim(line)) >= 2 AND NOT {IS_META.format("(line || ' ')")} AS valid FROM noisy""",
)

# ---- sections and signs ------------------------------------------------------------------------------------

HEADERS = ["Payments", " deposits and credits: ", "FEES", "Interest charges", "card purchases", "withdrawals", "Deposits 12.00", "Point of  Sale"]
TYPES = ["credit_card", "bank_account", "unknown"]
HEADER_SQL = "list_extract([" + ", ".join(f"'{h}'" for h in HEADERS) + "], CAST(o_orderkey % 8 + 1 AS INTEGER))"
TYPE_SQL = "list_extract(['credit_card', 'bank_account', 'unknown'], CAST(o_custkey % 3 + 1 AS INTEGER))"


def headed(s, d):
    pick = lambda values, n: F.element_at(F.lit(values), (n + 1).cast("int"))
    return T.read(s, d, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        pick(HEADERS, F.col("o_orderkey") % 8).alias("header"),
        pick(TYPES, F.col("o_custkey") % 3).alias("statement_type"),
        pick(WORDINGS, F.col("o_orderkey") % len(WORDINGS)).alias("wording"),
    )


WORDINGS = [
    "e-Transfersent JOE", "e-Transfer-Autodeposit ANN", "Interest charged", "interest earned", "REFUND shop", "ATM withdrawal",
    "Payment thank you", "annual fee", "credit card payment", "transfer from savings", "SMALL RING", "Cheque 12", "Deposit",
]
HEADED = f"""headed AS (SELECT o_orderkey, o_orderstatus, o_totalprice, {HEADER_SQL} AS header, {TYPE_SQL} AS statement_type,
  list_extract([{", ".join(f"'{w}'" for w in WORDINGS)}], CAST(o_orderkey % {len(WORDINGS)} + 1 AS INTEGER)) AS wording FROM orders)"""


def _section_case(sections, text):
    whens = " ".join(rf"WHEN regexp_matches({text}, '(?i)^\s*({p})\s*:?\s*$') THEN '{k}'" for k, p in sections)
    return f"CASE {whens} END"


SECTION_SQL = f"""CASE WHEN trim(header) <> '' AND length(trim(header)) <= 40 AND NOT regexp_matches(header, '{V.AMOUNT_TOKEN}') THEN
  CASE statement_type WHEN 'credit_card' THEN {_section_case(V.CARD_SECTIONS, 'trim(header)')} WHEN 'bank_account' THEN {_section_case(V.BANK_SECTIONS, 'trim(header)')} END END"""
enter(
    "detect_section",
    lambda s, d: headed(s, d).select("o_orderkey", S.detect_section(F.col("header"), F.col("statement_type")).alias("section")),
    f"WITH {HEADED} SELECT o_orderkey, {SECTION_SQL} AS section FROM headed",
)


def _has(words):
    return "(" + " OR ".join(f"contains(blob, '{w}')" for w in words) + ")"


DIRECTION_SQL = rf"""CASE WHEN regexp_matches(blob, '{V.TRANSFER_SENT}') THEN 'debit' WHEN regexp_matches(blob, '{V.TRANSFER_RECEIVED}') THEN 'credit'
  WHEN regexp_matches(blob, '{V.INTEREST_CHARGED}') THEN 'debit' WHEN regexp_matches(blob, '{V.INTEREST_PAID}') THEN 'credit'
  WHEN {_has(V.ANY_CREDIT_WORDS)} THEN 'credit' WHEN {_has(V.ANY_DEBIT_WORDS)} THEN 'debit'
  WHEN statement_type = 'credit_card' AND {_has(V.CARD_CREDIT_WORDS)} THEN 'credit' WHEN statement_type = 'credit_card' AND {_has(V.CARD_DEBIT_WORDS)} THEN 'debit'
  WHEN statement_type = 'bank_account' AND {_has(V.BANK_DEBIT_WORDS)} THEN 'debit' WHEN statement_type = 'bank_account' AND {_has(V.BANK_CREDIT_WORDS)} THEN 'credit' END"""
enter(
    "keyword_direction",
    lambda s, d: headed(s, d).select("o_orderkey", S.keyword_direction(F.lower("wording"), F.col("statement_type")).alias("direction")),
    f"WITH {HEADED}, blobs AS (SELECT *, lower(wording) AS blob FROM headed) SELECT o_orderkey, {DIRECTION_SQL} AS direction FROM blobs",
)
enter(
    "normalize_sign",
    lambda s, d: headed(s, d).select(
        "o_orderkey",
        S.normalize_sign(
            F.col("o_totalprice"), F.col("wording"), F.col("statement_type"), S.detect_section(F.col("header"), F.col("statement_type")),
            F.when(F.col("o_orderkey") % 10 == 0, "5.00 CR").when(F.col("o_orderkey") % 10 == 1, "5.00 DR").otherwise("line"),
        ).alias("amount"),
    ),
    f"""WITH {HEADED}, blobs AS (SELECT *, lower(wording) || ' line' AS blob, {SECTION_SQL} AS section FROM headed), dirs AS (SELECT *, {DIRECTION_SQL} AS direction FROM blobs)
      SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice WHEN o_orderkey % 10 = 1 THEN -o_totalprice
        WHEN section IN ('payments', 'credits', 'deposits') THEN o_totalprice
        WHEN section IN ('purchases', 'fees', 'interest', 'cash_advances', 'withdrawals', 'card', 'service_charges') THEN -o_totalprice
        WHEN direction = 'credit' THEN o_totalprice WHEN direction = 'debit' THEN -o_totalprice
        WHEN statement_type = 'credit_card' THEN -o_totalprice ELSE o_totalprice END AS amount FROM dirs""",
)
enter(
    "sign_by_type",
    lambda s, d: headed(s, d).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("before"), F.when(F.col("o_orderstatus") == "O", " Income").when(F.col("o_orderstatus") == "F", "expense").alias("kind"))
    .select("o_orderkey", S.sign_by_type(F.col("before"), F.col("kind")).alias("amount"), (S.sign_by_type(F.col("before"), F.col("kind")) != F.col("before")).alias("corrected")),
    """WITH b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS before FROM orders),
      a AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN abs(before) WHEN 'F' THEN -abs(before) ELSE before END AS amount FROM b)
      SELECT o_orderkey, amount, amount <> before AS corrected FROM a""",
)

# ---- validation --------------------------------------------------------------------------------------------

IMPORT = """import_rows AS (SELECT o_orderkey AS row_no, o_custkey AS upload_id,
  CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT08:30:00') ELSE strftime(o_orderdate, ' %Y-%m-%d ') END AS transaction_date,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' #' || o_orderkey END AS description,
  CASE WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount, '' AS raw_text FROM orders)"""


def import_rows(s, d):
    k = F.col("o_orderkey")
    return T.read(s, d, "orders").select(
        k.alias("row_no"),
        F.col("o_custkey").alias("upload_id"),
        F.when(k % 11 == 0, "")
        .when(k % 11 == 1, "soon")
        .when(k % 11 == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'08:30:00"))
        .otherwise(F.date_format("o_orderdate", " yyyy-MM-dd "))
        .alias("transaction_date"),
        F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" #"), k)).alias("description"),
        F.when(k % 13 == 0, 0.0).when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
        F.lit("").alias("raw_text"),
    )


CHECKED = f"""{IMPORT}, checked AS (SELECT row_no, upload_id, trim(description) AS description, amount,
  CASE WHEN amount < 0 THEN 'expense' ELSE 'income' END AS transaction_type,
  CASE WHEN row_no % 11 > 1 THEN CAST(trim(transaction_date) AS TIMESTAMP) END AS created_at,
  CASE WHEN row_no % 7 = 0 THEN 'description is empty' WHEN amount = 0 THEN 'amount is zero' WHEN row_no % 11 = 0 THEN 'empty transaction_date'
    WHEN row_no % 11 = 1 THEN 'invalid transaction_date' END AS error FROM import_rows)"""
enter(
    "validate_import_rows",
    lambda s, d: C.validate_import_rows(import_rows(s, d)).select("row_no", "upload_id", "description", "amount", "transaction_type", "created_at", "error"),
    f"WITH {CHECKED} SELECT row_no, upload_id, description, amount, transaction_type, created_at, error FROM checked",
)
enter(
    "validate_manual_rows",
    lambda s, d: C.validate_manual_rows(
        _signed_orders(s, d).withColumn("transaction_type", F.when(F.col("id") % 5 == 0, " Expense ").when(F.col("id") % 5 == 1, "gift").when(F.col("id") % 5 == 2, "income"))
    ),
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount,
      CASE o_orderkey % 5 WHEN 0 THEN 'expense' WHEN 1 THEN NULL WHEN 2 THEN 'income' ELSE CASE WHEN o_orderstatus = 'F' THEN 'expense' ELSE 'income' END END AS transaction_type,
      CASE WHEN o_orderkey % 5 = 1 THEN 'transaction_type must be ''expense'' or ''income''' END AS error FROM orders""",
)


def _signed_orders(s, d):
    return T.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"))


enter(
    "validate_entry_form",
    lambda s, d: C.validate_entry_form(
        T.read(s, d, "events").select(
            "event_id",
            F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")).alias("merchant"),
            F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "abc").when(F.col("event_id") % 4 == 2, "-5").otherwise(F.col("value").cast("string")).alias("amount"),
            F.when(F.col("event_id") % 5 == 0, "").otherwise("n").alias("notes"),
        )
    ).select("event_id", "merchant_error", "amount_error", "notes_error"),
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Merchant is required' END AS merchant_error,
      CASE event_id % 4 WHEN 0 THEN 'Amount is required' WHEN 1 THEN 'Enter a valid decimal number' WHEN 2 THEN 'Amount must be greater than zero' END AS amount_error,
      CASE WHEN event_id % 5 = 0 THEN 'Notes is required' END AS notes_error FROM events""",
)
