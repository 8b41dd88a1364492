"""Statement parsing, round trip: orders are rendered as statement lines, so the right rows are known."""

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.book import enter
from coinweir import schemas
from coinweir.plans import statements as P
from coinweir.plans import uploads as U
from coinweir.session import cut_lineage
from coinweir.sources import files as I

REF_YEAR = 1998
PAGE_ORDERS = 100_000  # a page covers this many order keys, so that no page outgrows a task

# Date layouts by order key; the last two carry no year.
SPARK_LAYOUTS = ["MM/dd/yyyy", "yyyy-MM-dd", "MMM d, yyyy", "d MMM yyyy", "dd-MMM-yyyy", "MM/dd/yy", "ddMMM", "MMM d"]


def orders_with_names(s, d):
    """Orders with a part name."""
    part = T.read(s, d, "part").select("p_partkey", F.upper("p_name").alias("name"))
    orders = T.read(s, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    date = F.when(F.lit(False), "")
    for i, layout in enumerate(SPARK_LAYOUTS):
        date = date.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", layout))
    suffix = F.when(F.col("o_orderstatus") == "O", " CR").when(F.col("o_orderstatus") == "F", " DR").otherwise("")
    return T.with_part(orders, part).select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("statement_id"),
        (F.floor(F.col("o_orderkey") / PAGE_ORDERS) + 1).cast("bigint").alias("page_no"),
        "name",
        "o_orderdate",
        "o_totalprice",
        "o_orderstatus",
        date.alias("date_text"),
        F.concat(F.lit("REF"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("code"),
        F.concat(F.format_number("o_totalprice", 2), suffix).alias("money"),
    )


def plain_lines(s, d):
    """One line per order: date, name, code, amount."""
    return orders_with_names(s, d).select(
        "statement_id", "page_no", F.col("k").alias("line_no"), F.concat_ws(" ", "date_text", "name", "code", "money").alias("line")
    )


def mixed_lines(s, d):
    """Orders as one, two or three lines, a quarter of them without a date, between headers and balances."""
    k = F.col("k")
    variant = F.floor(k / 8) % 4
    noise = F.when(k % 10 == 0, "Opening Balance 1,000.00").when(
        k % 10 == 5, F.when(F.floor(k / 10) % 2 == 0, "Deposits").otherwise("Withdrawals")
    )
    words = lambda *names: F.concat_ws(" ", *names)
    body = (
        F.when(variant == 0, F.array(words("date_text", "name", "code", "money")))
        .when(variant == 1, F.array(words("date_text", "name", "code"), F.col("money")))
        .when(variant == 2, F.array(words("date_text", "name"), F.lit("ONLINE ORDER"), words("code", "money")))
        .otherwise(F.array(words("name", "code", "money")))
    )
    shown = F.concat(F.when(noise.isNotNull(), F.array(noise)).otherwise(F.array().cast("array<string>")), body)
    return orders_with_names(s, d).select("statement_id", "page_no", "k", F.posexplode(shown).alias("pos", "line")).select(
        "statement_id", "page_no", (F.col("k") * 10 + F.col("pos")).alias("line_no"), "line"
    )


NAMED = f"""named AS (SELECT o_orderkey AS k, o_custkey AS statement_id, o_orderkey // {PAGE_ORDERS} + 1 AS page_no, upper(p_name) AS name,
    o_orderdate, o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount,
    (o_orderkey // 8) % 4 AS variant,
    CASE WHEN o_orderkey % 8 < 6 THEN CAST(o_orderdate AS DATE)
         WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE make_date({REF_YEAR}, month(o_orderdate), day(o_orderdate)) END AS parsed
  FROM orders JOIN part ON o_orderkey % (SELECT count(*) FROM part) = p_partkey)"""


def typed(lines):
    return P.with_statement_type(lines, cut_lineage(P.statement_types(lines)))  # one row per statement, read three times


enter(
    "scan_statement_lines",
    lambda s, d: I.scan_statement_lines(
        T.read(s, d, "documents").select(F.col("doc_id").alias("statement_id"), F.lit(1).cast("bigint").alias("page_no"), "text")
    ).select("statement_id", "page_no", "line_no", F.md5("line").alias("digest")),
    r"""SELECT doc_id AS statement_id, CAST(1 AS BIGINT) AS page_no, unnest(range(len(p))) AS line_no, md5(unnest(p)) AS digest
      FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x{0b}\x{0c}\r\x{85}\x{2028}\x{2029}]') AS p FROM documents)""",
)
enter(
    "parse_text_lines",
    lambda s, d: P.parse_text_lines(typed(plain_lines(s, d)), REF_YEAR).select(
        "statement_id", "page_no", "line_no", "transaction_date", "description", "amount"
    ),
    f"WITH {NAMED} SELECT statement_id, page_no, k AS line_no, parsed AS transaction_date, name AS description, amount FROM named WHERE parsed IS NOT NULL",
)
enter(
    "match_date",
    lambda s, d: plain_lines(s, d).select("line_no", P.S.match_date(F.col("line")).alias("date_text")),
    """SELECT o_orderkey AS line_no, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 2 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 3 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 4 THEN strftime(o_orderdate, '%d-%b-%Y')
      WHEN 5 THEN strftime(o_orderdate, '%m/%d/%y') WHEN 6 THEN strftime(o_orderdate, '%d%b') ELSE strftime(o_orderdate, '%b %-d') END AS date_text FROM orders""",
)
enter(
    "parse_date",
    lambda s, d: orders_with_names(s, d).select("k", P.S.parse_date(F.col("date_text"), REF_YEAR).alias("parsed")),
    f"WITH {NAMED} SELECT k, parsed FROM named",
)
enter(
    "find_amounts",
    lambda s, d: orders_with_names(s, d).select(
        "k", F.size(P.S.find_amounts(F.concat_ws(" ", "name", F.lit("416-967-1111 0.00"), "money"))).alias("n_amounts"),
        P.S.text_before_amount(F.concat_ws(" ", "name", "code", "money")).alias("before"),
    ),
    f"WITH {NAMED} SELECT k, CAST(2 AS INTEGER) AS n_amounts, name || ' REF' || lpad(CAST(k AS VARCHAR), 8, '0') || ' ' AS before FROM named",
)
enter(
    "pick_amount",
    lambda s, d: orders_with_names(s, d).select(
        "k", P.S.amount_size(P.S.pick_amount(P.S.find_amounts(F.concat_ws(" ", F.when(F.col("k") % 2 == 0, "0.00"), "money", F.when(F.col("k") % 3 == 0, "9,999.99"))))).alias("size")
    ),
    f"WITH {NAMED} SELECT k, o_totalprice AS size FROM named",
)
enter(
    "parse_amount",
    lambda s, d: orders_with_names(s, d).select(
        "k",
        P.S.parse_amount(F.col("money")).alias("by_suffix"),
        P.S.parse_amount(F.concat(F.lit("($"), F.format_number("o_totalprice", 2), F.lit(")"))).alias("bracketed"),
        P.S.parse_amount(F.format_number("o_totalprice", 2), F.when(F.col("k") % 3 == 0, "VisaDebitpurchase").when(F.col("k") % 3 == 1, "payroll").otherwise("x")).alias("by_words"),
    ),
    f"WITH {NAMED} SELECT k, amount AS by_suffix, -o_totalprice AS bracketed, CASE WHEN k % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS by_words FROM named",
)
# Statement type and sections of the mixed pages.
TYPED = f"""{NAMED}, scores AS (SELECT statement_id,
    max(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) + max(CASE WHEN k % 20 = 5 THEN 1 ELSE 0 END) + max(CASE WHEN k % 20 = 15 THEN 1 ELSE 0 END) AS bank FROM named GROUP BY statement_id),
  typed AS (SELECT statement_id, CAST(bank AS DOUBLE) AS bank_score, CASE WHEN bank >= 2 THEN 'bank_account' ELSE 'unknown' END AS statement_type FROM scores),
  placed AS (SELECT n.*, t.statement_type,
    last_value(CASE WHEN t.statement_type = 'bank_account' AND k % 10 = 5 THEN CASE WHEN (k // 10) % 2 = 0 THEN 'deposits' ELSE 'withdrawals' END END IGNORE NULLS) OVER w AS section,
    last_value(CASE WHEN variant < 3 THEN parsed END IGNORE NULLS) OVER w AS last_date
    FROM named n JOIN typed t USING (statement_id) WINDOW w AS (PARTITION BY statement_id, page_no ORDER BY k ROWS UNBOUNDED PRECEDING)),
  blocks AS (SELECT *, CASE WHEN variant = 3 OR (variant = 2 AND parsed IS NULL) THEN last_date ELSE parsed END AS transaction_date,
    CASE WHEN variant = 2 THEN CASE WHEN parsed IS NULL THEN '' ELSE name || ' ' END || 'ONLINE ORDER'
      WHEN word IS NOT NULL THEN word || ' ' || name ELSE name END AS description,
    CASE WHEN o_orderstatus = 'P' AND word = 'Withdrawals' THEN -amount ELSE amount END AS signed,
    variant = 3 AND contains(lpad(CAST(k AS VARCHAR), 8, '0'), '1800') AS looks_like_contact
    FROM (SELECT *, CASE WHEN statement_type = 'unknown' AND variant = 3 AND k % 10 = 5 THEN CASE WHEN (k // 10) % 2 = 0 THEN 'Deposits' ELSE 'Withdrawals' END END AS word FROM placed)),
  good AS (SELECT * EXCLUDE (amount, signed), signed AS amount FROM blocks WHERE transaction_date IS NOT NULL)"""
# A line that is a header only for a typed statement is, without a type, text of the date-less row behind it. A
# reference number with 1800 inside reads like a toll-free number, so a date-less row with one counts as contact text.
enter(
    "statement_type_score",
    lambda s, d: P.statement_types(mixed_lines(s, d)).select("statement_id", "card_score", "bank_score", "statement_type"),
    f"WITH {TYPED} SELECT statement_id, CAST(0 AS DOUBLE) AS card_score, bank_score, statement_type FROM typed",
)
SECTION_LINES = f"""WITH {TYPED} SELECT statement_id, k * 10 + pos AS line_no, section FROM placed, range(4) r(pos)
      WHERE pos < CASE variant WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END"""
enter("carry_section", lambda s, d: P.carry_section(typed(mixed_lines(s, d))).select("statement_id", "line_no", "section"), SECTION_LINES)
enter("carry_section_lines", lambda s, d: P.carry_section(typed(mixed_lines(s, d))).select("statement_id", "line_no", "section"), SECTION_LINES)
enter(
    "carry_date",
    lambda s, d: P.carry_date(plain_lines(s, d), REF_YEAR).select("statement_id", "line_no", "last_date"),
    f"""WITH {NAMED} SELECT statement_id, k AS line_no, last_value(parsed IGNORE NULLS) OVER (PARTITION BY statement_id, page_no ORDER BY k ROWS UNBOUNDED PRECEDING) AS last_date FROM named""",
)
enter(
    "parse_blocks",
    lambda s, d: P.parse_blocks(typed(mixed_lines(s, d)), REF_YEAR).select("statement_id", "transaction_date", "description", "amount", "section"),
    f"WITH {TYPED} SELECT statement_id, transaction_date, description, amount, section FROM good",
)
enter(
    "block_ids",
    lambda s, d: P.block_lines(typed(mixed_lines(s, d)), REF_YEAR).where("kind IN ('A', 'D+')").groupBy("statement_id", "page_no").agg(
        F.count_distinct("block_id").alias("n_blocks"), F.count("*").alias("n_lines")
    ),
    f"""WITH {TYPED} SELECT statement_id, page_no, count(*) AS n_blocks, count(*) AS n_lines FROM blocks
      WHERE transaction_date IS NOT NULL OR last_date IS NOT NULL GROUP BY statement_id, page_no""",
)


def candidates(s, d):
    return P.parse_lines(typed(mixed_lines(s, d)), REF_YEAR)


enter(
    "union_strategies",
    lambda s, d: P.union_strategies(P.parse_text_lines(typed(mixed_lines(s, d)), REF_YEAR), P.parse_blocks(typed(mixed_lines(s, d)), REF_YEAR))
    .groupBy("statement_id", "priority").agg(F.count("*").alias("n_rows")),
    f"""WITH {TYPED} SELECT statement_id, CAST(2 AS INTEGER) AS priority, count(*) AS n_rows FROM good GROUP BY 1
      UNION ALL SELECT statement_id, CAST(1 AS INTEGER), count(*) FROM good WHERE variant = 0 GROUP BY 1""",
)
FINAL = """final AS (SELECT DISTINCT statement_id, transaction_date, lower(description) AS key,
    CASE WHEN o_orderstatus = 'O' THEN o_totalprice WHEN o_orderstatus = 'F' THEN -o_totalprice
      WHEN section = 'withdrawals' THEN -o_totalprice ELSE amount END AS amount FROM good WHERE NOT looks_like_contact)"""
enter(
    "finalize_statement",
    lambda s, d: P.finalize_statement(candidates(s, d)).select("statement_id", "transaction_date", F.lower("description").alias("key"), "amount"),
    f"WITH {TYPED}, {FINAL} SELECT * FROM final",
)
enter(
    "finalize_counts",
    lambda s, d: P.finalize_counts(candidates(s, d)),
    f"""WITH {TYPED} SELECT statement_id, count(*) + count(*) FILTER (variant = 0) AS n_candidates, count(*) FILTER (looks_like_contact) AS n_dropped,
      CAST(sum(CASE WHEN o_orderstatus = 'P' AND section = 'withdrawals' AND NOT looks_like_contact THEN CASE WHEN variant = 0 THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS n_sign_changes
      FROM good GROUP BY statement_id""",
)
enter(
    "dedup_transactions",
    lambda s, d: P.dedup_transactions(
        T.raw_merchants(s, d).select(
            F.col("l_suppkey").alias("statement_id"), F.lit(1).alias("page_no"), F.col("l_orderkey").alias("line_no"), F.lit("2024-01-01").alias("transaction_date"),
            F.concat(F.lit(" "), F.when(F.col("l_orderkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name"))).alias("description"), F.col("l_linenumber").cast("double").alias("amount"), F.lit(1).alias("priority"),
        )
    ).select("statement_id", "line_no", F.lower(F.trim("description")).alias("key"), "amount"),
    f"WITH {T.RAW_MERCHANTS} SELECT l_suppkey AS statement_id, min(l_orderkey) AS line_no, lower(p_name) AS key, CAST(l_linenumber AS DOUBLE) AS amount FROM raw_merchants GROUP BY 1, 3, 4",
)

# ---- tables ------------------------------------------------------------------------------------------------

HEADERS = [
    ["Date", "Description", "Amount", "Balance"],
    ["Posted Date", "Details", "Withdrawals ($)", "Deposits ($)", "Running Balance"],
    ["Transaction Date", "Merchant", "Debit", "Credit"],
    ["When", "What", "Amount"],
]


# One word each, in the writing of the file they come from.
RUN_TOGETHER = [
    ["TransactionDate", "Description", "AmountCAD", "RUNNINGBALANCE"],
    ["POSTEDDATE", "Payee", "moneyout", "MoneyIn", "Balance"],
    ["transdate", "Particulars", "AmountDebit", "amountcredit"],
    ["When", "Descriptive", "Accretion"],
]


def nested_tables(s, d, headers=HEADERS):
    """Every statement page as one table: a header row, then a row per order of a page of 1,000 order keys."""
    money, kind = F.format_number("o_totalprice", 2), F.col("statement_id") % 4
    debit = F.when(F.col("o_orderstatus") == "F", money).otherwise("")
    credit = F.when(F.col("o_orderstatus") != "F", money).otherwise("")
    cells = (
        F.when(kind == 0, F.array("date_text", "name", "money", F.lit("1.00")))
        .when(kind == 1, F.array(F.col("date_text"), F.col("name"), debit, credit, F.lit("1.00")))
        .when(kind == 2, F.array(F.col("date_text"), F.col("name"), debit, credit))
        .otherwise(F.array(F.col("date_text"), F.col("name"), F.col("money")))
    )
    header = F.element_at(F.lit(headers), (kind + 1).cast("int"))
    # A page covers 1,000 order keys, so its rows are few.
    return (
        orders_with_names(s, d)
        .withColumn("page_no", (F.floor(F.col("k") / 1000) + 1).cast("bigint"))
        .withColumn("cells", cells)
        .groupBy("statement_id", "page_no")
        .agg(F.sort_array(F.collect_list(F.struct("k", "cells"))).alias("rows"))
        .select("statement_id", "page_no", F.array(F.concat(F.array(header), F.transform("rows", lambda r: r["cells"]))).alias("tables"))
    )


enter(
    "scan_statement_tables",
    lambda s, d: I.scan_statement_tables(nested_tables(s, d)).select("statement_id", "page_no", "table_no", "row_no", F.element_at("cells", 2).alias("second_cell")),
    f"""WITH {NAMED}, rows AS (SELECT statement_id, k // 1000 + 1 AS page_no, row_number() OVER (PARTITION BY statement_id, k // 1000 ORDER BY k) AS row_no, name FROM named)
      SELECT statement_id, page_no, CAST(0 AS BIGINT) AS table_no, row_no, name AS second_cell FROM rows
      UNION ALL SELECT DISTINCT statement_id, page_no, CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_extract(['Description', 'Details', 'Merchant', 'What'], CAST(statement_id % 4 + 1 AS INTEGER)) FROM rows""",
)
TABLE_ROWS = f"""{NAMED}, table_rows AS (SELECT statement_id, k // 1000 + 1 AS page_no, parsed AS transaction_date, name AS description, amount,
    CASE WHEN statement_id % 4 IN (1, 2) THEN CASE WHEN amount < 0 THEN 'withdrawals' ELSE 'deposits' END END AS section
  FROM named WHERE statement_id % 4 < 3 AND parsed IS NOT NULL)"""
enter(
    "parse_tables",
    lambda s, d: P.parse_tables(I.scan_statement_tables(nested_tables(s, d)), REF_YEAR).select("statement_id", "page_no", "transaction_date", "description", "amount", "section"),
    f"WITH {TABLE_ROWS} SELECT * FROM table_rows",
)


enter(
    "parse_tables_run_together",
    lambda s, d: P.parse_tables(I.scan_statement_tables(nested_tables(s, d, RUN_TOGETHER)), REF_YEAR).select("statement_id", "page_no", "transaction_date", "description", "amount", "section"),
    f"WITH {TABLE_ROWS} SELECT * FROM table_rows",
)


def _mixed_input(s, d):
    """Statements 0 mod 3 also come as tables; statements 2 mod 3 are blank pages."""
    n = F.col("statement_id") % 3
    return mixed_lines(s, d).withColumn("line", F.when(n == 2, "  ").otherwise(F.col("line"))), I.scan_statement_tables(nested_tables(s, d).where(n == 0))


enter(
    "choose_strategy",
    lambda s, d: P.parse_statements(*_mixed_input(s, d), REF_YEAR)[1].select("statement_id", "strategy", "n_transactions"),
    f"""WITH {TYPED}, {FINAL}, from_table AS (SELECT statement_id, count(DISTINCT (parsed, amount, lower(name))) AS n FROM named
        WHERE statement_id % 3 = 0 AND statement_id % 4 < 3 AND parsed IS NOT NULL GROUP BY 1),
      from_text AS (SELECT statement_id, count(*) AS n FROM final GROUP BY 1), text_kinds AS (SELECT statement_id, count(*) FILTER (variant = 0) AS n_text FROM good GROUP BY 1)
      SELECT s.statement_id, CASE WHEN t.n > 0 THEN 'table' WHEN s.statement_id % 3 = 2 THEN 'no_text' WHEN x.n IS NULL THEN 'no_transactions'
          WHEN k.n_text > 0 THEN 'text+block' ELSE 'block' END AS strategy,
        CASE WHEN t.n > 0 THEN t.n WHEN s.statement_id % 3 = 2 THEN CAST(0 AS BIGINT) ELSE coalesce(x.n, CAST(0 AS BIGINT)) END AS n_transactions
      FROM (SELECT DISTINCT statement_id FROM named) s LEFT JOIN from_table t USING (statement_id) LEFT JOIN from_text x USING (statement_id) LEFT JOIN text_kinds k USING (statement_id)""",
)
# The transactions themselves; signs are compared by finalize_statement and normalize_sign.
enter(
    "parse_statements",
    lambda s, d: P.parse_statements(*_mixed_input(s, d), REF_YEAR)[0].select(
        "statement_id", "transaction_date", F.lower("description").alias("key"), F.abs("amount").alias("size")
    ),
    f"""WITH {TYPED}, {FINAL}, from_table AS (SELECT DISTINCT statement_id, parsed AS transaction_date, lower(name) AS key, amount FROM named
        WHERE statement_id % 3 = 0 AND statement_id % 4 < 3 AND parsed IS NOT NULL)
      SELECT statement_id, transaction_date, key, abs(amount) AS size FROM from_table
      UNION ALL SELECT statement_id, transaction_date, key, abs(amount) FROM final
      WHERE statement_id % 3 <> 2 AND statement_id NOT IN (SELECT statement_id FROM from_table)""",
)
enter(
    "line_diagnostics",
    lambda s, d: P.line_diagnostics(plain_lines(s, d), 5).select("statement_id", "line_no", F.size("amounts").alias("n_amounts"), "is_summary", "would_parse"),
    f"""WITH {NAMED} SELECT statement_id, k AS line_no, CAST(1 AS INTEGER) AS n_amounts, FALSE AS is_summary, TRUE AS would_parse
      FROM (SELECT *, row_number() OVER (PARTITION BY statement_id, page_no ORDER BY k) AS rn FROM named) WHERE rn <= 5""",
)
enter(
    "chunk_rows",
    lambda s, d: P.chunk_rows(_by_segment(s, d)).select("statement_id", "line_no", "chunk_no"),
    """SELECT o_custkey % 7 AS statement_id, o_orderkey AS line_no, (row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1) // 50 AS chunk_no FROM orders""",
)


def _by_segment(s, d):
    return T.read(s, d, "orders").select(
        (F.col("o_custkey") % 7).alias("statement_id"), F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("page_no"), F.col("o_orderkey").alias("line_no"),
        F.to_date("o_orderdate").alias("transaction_date"), F.col("o_orderpriority").alias("description"), F.col("o_totalprice").alias("amount"),
    )


# ---- cleanup audit -----------------------------------------------------------------------------------------

# Candidates are orders by customer. The cleaner drops totals and, for some customers, much more.
CAND = """cand AS (SELECT o_orderkey AS k, o_custkey AS statement_id, CAST(o_orderdate AS DATE) AS transaction_date,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Total fees' ELSE o_orderpriority END AS description, -o_totalprice AS amount,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'line ' || o_orderkey END AS raw_text FROM orders),
  clean AS (SELECT k, statement_id, transaction_date, description, CASE WHEN k % 5 = 0 THEN -amount ELSE amount END AS amount, raw_text,
    CASE WHEN k % 5 = 0 AND k % 4 <> 0 THEN ' Expense' END AS transaction_type FROM cand
    WHERE CASE statement_id % 4 WHEN 0 THEN k % 3 <> 0 WHEN 1 THEN k % 2 = 0 WHEN 2 THEN FALSE ELSE TRUE END)"""


def cleanup_sides(s, d):
    k = F.col("k")
    cand = T.read(s, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("statement_id"), F.to_date("o_orderdate").alias("transaction_date"),
        F.when(F.col("o_orderkey") % 3 == 0, "Total fees").otherwise(F.col("o_orderpriority")).alias("description"), (-F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("line "), F.col("o_orderkey"))).alias("raw_text"),
    )
    n = F.col("statement_id") % 4
    clean = cand.where(F.when(n == 0, k % 3 != 0).when(n == 1, k % 2 == 0).when(n == 2, False).otherwise(True)).withColumn(
        "amount", F.when(k % 5 == 0, -F.col("amount")).otherwise(F.col("amount"))
    ).withColumn("transaction_type", F.when((k % 5 == 0) & (k % 4 != 0), " Expense"))
    return cand, clean


DIFF = """clean_signed AS (SELECT * REPLACE (CASE WHEN transaction_type IS NOT NULL AND amount > 0 THEN -amount ELSE amount END AS amount) FROM clean),
  keys AS (SELECT DISTINCT statement_id, CASE WHEN raw_text <> '' THEN raw_text ELSE transaction_date || '|' || description || '|' || amount END AS key FROM {side}),
  gone AS (SELECT c.* FROM cand c ANTI JOIN keys y ON c.statement_id = y.statement_id
    AND CASE WHEN c.raw_text <> '' THEN c.raw_text ELSE c.transaction_date || '|' || c.description || '|' || c.amount END = y.key)"""
FRACTION = """facts AS (SELECT statement_id, count(*) AS n_input FROM cand GROUP BY 1),
  gone_facts AS (SELECT statement_id, count(*) AS n_removed, bool_or(description <> 'Total fees') AS ambiguous FROM gone GROUP BY 1),
  verdict AS (SELECT f.statement_id, n_input, coalesce(n_removed, CAST(0 AS BIGINT)) AS n_removed, coalesce(n_removed, 0) / n_input AS removed_share,
    (coalesce(n_removed, 0) / n_input > 0.4 AND coalesce(ambiguous, FALSE)) OR NOT EXISTS (SELECT 1 FROM clean c WHERE c.statement_id = f.statement_id) AS keep_input
    FROM facts f LEFT JOIN gone_facts g ON f.statement_id = g.statement_id)"""
enter(
    "cleanup_diff",
    lambda s, d: P.cleanup_diff(*cleanup_sides(s, d)).select("k", "statement_id"),
    f"WITH {CAND}, {DIFF.format(side='clean')} SELECT k, statement_id FROM gone",
)
enter(
    "removal_fraction",
    lambda s, d: P.removal_fraction(*cleanup_sides(s, d)).withColumn("removed_share", F.round("removed_share", 6)),
    f"WITH {CAND}, {DIFF.format(side='clean')}, {FRACTION} SELECT statement_id, n_input, n_removed, round(removed_share, 6) AS removed_share, keep_input FROM verdict",
)
enter(
    "cleanup_apply",
    lambda s, d: P.cleanup_apply(*cleanup_sides(s, d)),
    f"""WITH {CAND}, {DIFF.format(side='clean_signed')}, {FRACTION}
      SELECT c.statement_id, transaction_date, description, amount, raw_text FROM cand c JOIN verdict v ON c.statement_id = v.statement_id WHERE keep_input
      UNION ALL SELECT c.statement_id, transaction_date, description, amount, raw_text FROM clean_signed c JOIN verdict v ON c.statement_id = v.statement_id WHERE NOT keep_input""",
)


def _answers(s, d):
    """A JSON answer per chunk: most list their rows, some are fenced, some broken, some without the key."""
    chunks = P.chunk_rows(_by_segment(s, d).withColumn("raw_text", F.concat(F.lit("line "), "line_no")))
    k = F.col("line_no")
    row = F.struct(
        F.col("transaction_date").cast("string").alias("transaction_date"),
        F.when(k % 10 != 0, F.col("description")).alias("description"),
        F.when(k % 10 == 1, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"),
        "raw_text",
    )
    # A chunk holds 50 rows, so its answer is one small list.
    listed = chunks.groupBy("statement_id", "chunk_no").agg(F.sort_array(F.collect_list(row)).alias("transactions"))
    body = F.to_json(F.struct("transactions"))
    n = F.col("chunk_no") % 5
    text = F.when(n == 0, "{broken").when(n == 1, '{"rows": []}').when(n == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return listed.select("statement_id", "chunk_no", text.alias("body")), chunks


enter(
    "ingest_json_rows",
    lambda s, d: I.ingest_json_rows(*_answers(s, d)).select("statement_id", "chunk_no", "raw_text", "description", "amount"),
    """WITH c AS (SELECT o_custkey % 7 AS statement_id, o_orderkey AS k, (row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1) // 50 AS chunk_no,
        o_orderpriority AS description, o_totalprice AS amount FROM orders)
      SELECT statement_id, chunk_no, 'line ' || k AS raw_text, description, amount FROM c WHERE chunk_no % 5 < 2 OR k % 10 > 1""",
)


# ---- upload to preview -------------------------------------------------------------------------------------


def previews(s, d):
    """Plain statements with a cleaner's answer for each chunk; some answers are broken, all leave some rows out."""
    lines = plain_lines(s, d)
    no_tables = s.createDataFrame([], schemas.STATEMENT_TABLES)
    chunks = P.chunk_rows(P.parse_statements(lines, no_tables, REF_YEAR)[0])
    row = F.struct(
        F.col("transaction_date").cast("string").alias("transaction_date"), "description", F.abs("amount").cast("string").alias("amount"), "raw_text",
        F.when(F.col("amount") < 0, " Expense").otherwise("income").alias("transaction_type"),
    )
    listed = chunks.groupBy("statement_id", "chunk_no").agg(F.collect_list(F.when(F.col("line_no") % 7 != 3, row)).alias("transactions"))  # a chunk has 50 rows
    body = F.when((F.col("statement_id") + F.col("chunk_no")) % 5 == 0, "{broken").otherwise(F.to_json(F.struct("transactions")))
    return U.upload_preview(lines, no_tables, listed.select("statement_id", "chunk_no", body.alias("body")), REF_YEAR)


PREVIEW = f"""{NAMED}, p AS (SELECT * FROM named WHERE parsed IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY statement_id, parsed, round(amount, 2), lower(name) ORDER BY page_no, k) = 1),
  c AS (SELECT *, (row_number() OVER (PARTITION BY statement_id ORDER BY page_no, k) - 1) // 50 AS chunk_no FROM p),
  d AS (SELECT *, (statement_id + chunk_no) % 5 <> 0 AND k % 7 = 3 AS gone FROM c),
  v AS (SELECT statement_id, count(*) FILTER (gone) / count(*) > 0.4 OR count(*) FILTER (NOT gone) = 0 AS keep FROM d GROUP BY 1),
  preview AS (SELECT statement_id, parsed AS transaction_date, name AS description, amount FROM d JOIN v USING (statement_id) WHERE keep OR NOT gone)"""
enter(
    "upload_preview",
    lambda s, d: previews(s, d)[0].select("statement_id", "transaction_date", F.upper("description").alias("description"), "amount"),
    f"WITH {PREVIEW} SELECT * FROM preview",
)
enter(
    "upload_preview_uploads",
    lambda s, d: previews(s, d)[1].select("statement_id", "status", "total_transactions", "expense_count", "income_count", "total_expense", "total_income", "parse_error"),
    f"""WITH {PREVIEW} SELECT s.statement_id, CASE WHEN count(p.amount) > 0 THEN 'parsed' ELSE 'parse_failed' END AS status, count(p.amount) AS total_transactions,
      count(*) FILTER (p.amount < 0) AS expense_count, count(*) FILTER (p.amount >= 0) AS income_count,
      round(coalesce(sum(-p.amount) FILTER (p.amount < 0), 0.0), 2) AS total_expense, round(coalesce(sum(p.amount) FILTER (p.amount >= 0), 0.0), 2) AS total_income,
      CASE WHEN count(p.amount) = 0 THEN 'no_transactions' END AS parse_error
      FROM (SELECT DISTINCT statement_id FROM named) s LEFT JOIN preview p USING (statement_id) GROUP BY 1""",
)
