"""Statement text and tables to signed, de-duplicated transactions, for all statements at once.

Order matters only within a page, so every window is one page wide; a statement as a whole is only ever
aggregated, or joined to a one-row summary with its hot keys salted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.functions import statement_text as S
from coinweir.functions.text import any_of, clean_description, drop_reference_codes, let, strip
from coinweir.plans.skew import attach, running_index
from coinweir.session import cut_lineage

PAGE = ["statement_id", "page_no"]
CANDIDATE = [
    "statement_id", "page_no", "line_no", "transaction_date", "description", "amount", "raw_text", "section", "priority",
]


# ---- statement type ----------------------------------------------------------------------------------------


def statement_types(lines: DataFrame) -> DataFrame:
    """Card, bank or unknown per statement, with both scores.

    No indicator spans a line break, so flags per line, or-ed per statement, equal a search in the whole text.
    """
    text = F.lower("line")
    names = [*V.CARD_INDICATORS, *V.CARD_WEAK_INDICATORS, *V.BANK_INDICATORS]
    flags = lines.groupBy("statement_id").agg(
        *[F.max(F.contains(text, F.lit(name)).cast("double")).alias(f"f{i}") for i, name in enumerate(names)],
        F.max((strip("line") != "").cast("int")).alias("_has_text"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    n_card, n_weak = len(V.CARD_INDICATORS), len(V.CARD_WEAK_INDICATORS)

    def total(positions: range) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"f{i}"), F.lit(0.0)) for i in positions])

    card = total(range(n_card)) + total(range(n_card, n_card + n_weak)) * 0.5
    bank = total(range(n_card + n_weak, len(names)))
    return flags.select("statement_id", card.alias("card_score"), bank.alias("bank_score"), "_has_text", "n_lines").select(
        "statement_id",
        "card_score",
        "bank_score",
        F.when((F.col("card_score") >= 2) & (F.col("card_score") >= F.col("bank_score")), "credit_card")
        .when((F.col("bank_score") >= 2) & (F.col("bank_score") > F.col("card_score")), "bank_account")
        .otherwise("unknown")
        .alias("statement_type"),
        (F.coalesce("_has_text", F.lit(0)) == 1).alias("has_text"),
        "n_lines",
    )


def _place() -> Column:
    return F.struct("page_no", "line_no")


def with_statement_type(rows: DataFrame, types: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Rows with their statement's type; statements with very many rows (`n_lines`) are salted."""
    typed = attach(
        rows,
        types.select("statement_id", "statement_type"),
        ["statement_id"],
        _place(),
        counted=types if counted is None else counted,
        weight="n_lines",
    )
    return typed.withColumn("statement_type", F.coalesce("statement_type", F.lit("unknown")))


# ---- lines -------------------------------------------------------------------------------------------------


def _analysis(ref_year: int) -> Callable[[Column], Column]:
    """What one line of text says, each pattern applied once.

    Kinds: D+ date and amount, D- date only, B unreadable date, A amount only, T more text, null anything else.
    """

    def facts(text: Column) -> Column:
        return let(S.match_date(text), lambda date_text: dated(text, date_text))

    def dated(text: Column, date_text: Column) -> Column:
        head = F.struct(
            S.parse_date(date_text, ref_year).alias("date"),
            strip(F.substring(text, F.length(date_text) + 1, F.length(text))).alias("rest"),
        )
        return let(head, lambda h: let(S.find_amounts(h["rest"]), lambda amounts: priced(text, date_text, h, amounts)))

    def priced(text: Column, date_text: Column, head: Column, amounts: Column) -> Column:
        has_date, has_amount = date_text != "", F.size(amounts) > 0
        kind = (
            F.when(has_date & head["date"].isNull(), "B")
            .when(has_date & has_amount, "D+")
            .when(has_date, "D-")
            .when(has_amount, "A")
            .when(S.is_continuation_line(text), "T")
        )
        before = F.when(has_amount, drop_reference_codes(S.text_before_amount(head["rest"])))
        picked = F.when(has_amount, S.pick_amount(amounts))
        return let(
            F.struct(kind.alias("kind"), before.alias("before"), picked.alias("picked")),
            lambda found: result(text, head, found),
        )

    def result(text: Column, head: Column, found: Column) -> Column:
        kind, before = found["kind"], found["before"]
        part = (
            F.when(kind == "D+", before)
            .when(kind == "D-", F.coalesce(F.nullif(drop_reference_codes(head["rest"]), F.lit("")), head["rest"]))
            .when(kind == "T", text)
            .when((kind == "A") & S.is_continuation_line(before), before)
        )
        return F.struct(
            text.alias("text"),
            F.when(S.is_summary_line(text), F.lit(None)).otherwise(kind).alias("kind"),
            head["date"].alias("date"),
            before.alias("before"),
            F.nullif(part, F.lit("")).alias("part"),
            found["picked"].alias("picked"),
            S.section_of(text, V.CARD_SECTIONS).alias("card_header"),
            S.section_of(text, V.BANK_SECTIONS).alias("bank_header"),
        )

    return facts


def analyse_lines(lines: DataFrame, ref_year: int) -> DataFrame:
    """Lines that may matter, with their facts; blank, summary and noise lines never reach a shuffle."""
    facts = F.array(let(strip("line"), _analysis(ref_year)))
    kept = F.filter(
        facts, lambda f: f["kind"].isNotNull() | f["card_header"].isNotNull() | f["bank_header"].isNotNull()
    )
    return lines.select(*[c for c in lines.columns if c != "line"], F.explode(kept).alias("f")).select("*", "f.*").drop("f")


def _page_so_far():
    return Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def _with_header(analysed: DataFrame) -> DataFrame:
    """`header` by the statement's type; a header line is no other kind of line."""
    header = F.when(F.col("statement_type") == "credit_card", F.col("card_header")).when(
        F.col("statement_type") == "bank_account", F.col("bank_header")
    )
    return (
        analysed.withColumn("header", header)
        .withColumn("kind", F.when(F.col("header").isNotNull(), "H").otherwise(F.col("kind")))
        .drop("card_header", "bank_header")
        .where(F.col("kind").isNotNull())
        .withColumn("section", F.last("header", ignorenulls=True).over(_page_so_far()))
    )


def carry_section(lines: DataFrame) -> DataFrame:
    """`header` marks section header lines, `section` the section in force, page by page."""
    return lines.withColumn("header", S.detect_section(F.col("line"), F.col("statement_type"))).withColumn(
        "section", F.last("header", ignorenulls=True).over(_page_so_far())
    )


def carry_date(lines: DataFrame, ref_year: int) -> DataFrame:
    """`line_date` is a line's own leading date, `last_date` the latest one so far on the page."""
    return lines.withColumn("line_date", S.parse_date(S.match_date(strip("line")), ref_year)).withColumn(
        "last_date", F.last("line_date", ignorenulls=True).over(_page_so_far())
    )


# ---- one-line rows -----------------------------------------------------------------------------------------


def _text_amount() -> Column:
    return S.parse_amount(F.col("picked"), F.col("text"))


def parse_text_lines(lines: DataFrame, ref_year: int) -> DataFrame:
    """Rows from lines that hold a leading date and an amount; needs `statement_type`."""
    analysed = analyse_lines(lines, ref_year)
    # Only these two kinds of line decide the result, so only they are shuffled by page.
    wanted = analysed.where((F.col("kind") == "D+") | F.col("card_header").isNotNull() | F.col("bank_header").isNotNull())
    row = F.struct(_text_amount().alias("amount"), clean_description("before").alias("description"))
    rows = F.filter(F.array(row), lambda r: r["amount"].isNotNull() & (r["description"] != ""))
    return (
        _with_header(wanted)
        .where((F.col("kind") == "D+") & (F.length("text") >= 10))
        .select(*PAGE, "line_no", "date", "text", "section", "statement_type", F.explode(rows).alias("r"))
        .select(
            *PAGE,
            "line_no",
            F.col("date").alias("transaction_date"),
            "r.description",
            "r.amount",
            F.col("text").alias("raw_text"),
            "section",
            F.lit(1).alias("priority"),
            "statement_type",
        )
    )


# ---- blocks ------------------------------------------------------------------------------------------------


def block_lines(lines: DataFrame, ref_year: int) -> DataFrame:
    """Kept lines with their kind, the date in force and the number of their block on the page."""
    own_date = F.when(F.col("kind").isin("D+", "D-"), F.col("date"))
    dated = _with_header(analyse_lines(lines, ref_year)).withColumn(
        "last_date", F.last(own_date, ignorenulls=True).over(_page_so_far())
    )
    used = dated.where(~(F.col("kind").isin("A", "T") & F.col("last_date").isNull()))
    before = F.lag("kind").over(Window.partitionBy(*PAGE).orderBy("line_no"))
    starts = F.col("kind").isin("H", "D+", "D-", "B") | before.isNull() | before.isin("A", "D+")
    return used.withColumn("_starts", starts.cast("int")).withColumn(
        "block_id", F.sum("_starts").over(_page_so_far())
    ).drop("_starts")


def parse_lines(lines: DataFrame, ref_year: int) -> DataFrame:
    """Candidates of both text strategies in one pass: one-line rows (1) and block rows (2)."""
    kind = F.col("kind")
    closing = F.col("picked").isNotNull()
    blocks = (
        block_lines(lines, ref_year)
        .where(kind.isin("D+", "D-", "A", "T"))
        .groupBy(*PAGE, "block_id")
        .agg(
            F.max(F.when(closing, F.col("line_no"))).alias("line_no"),
            F.max(F.when(closing, F.col("last_date"))).alias("transaction_date"),
            F.max("picked").alias("picked"),
            F.max("section").alias("section"),
            F.max("statement_type").alias("statement_type"),
            F.max(kind == "D+").alias("one_line"),
            F.max(kind != "A").alias("in_parts"),
            F.max(F.when(closing, F.col("before"))).alias("before"),
            F.max(F.when(closing, F.col("text"))).alias("text"),
            F.sort_array(F.collect_list(F.struct("line_no", "text", "part"))).alias("pieces"),  # one page at most
        )
        .where(F.col("picked").isNotNull())
    )
    parts = F.filter(F.transform("pieces", lambda p: p["part"]), lambda p: p.isNotNull())
    flowing = F.array_join(F.transform("pieces", lambda p: p["text"]), " ")
    words = F.when(F.col("in_parts"), F.array_join(parts, " ")).otherwise(clean_description("before"))

    def from_block(said: Column) -> Column:
        return F.struct(
            F.lit(2).alias("priority"),
            clean_description(said).alias("description"),
            S.parse_amount(F.col("picked"), F.concat(flowing, F.lit(" "), said)).alias("amount"),
        )

    from_line = F.when(
        F.col("one_line") & (F.length("text") >= 10),
        F.struct(F.lit(1).alias("priority"), clean_description("before").alias("description"), _text_amount().alias("amount")),
    )
    rows = F.filter(
        F.array(from_line, let(words, from_block)),
        lambda r: r.isNotNull() & r["amount"].isNotNull() & (r["description"] != ""),
    )
    raw = F.array_join(F.transform("pieces", lambda p: p["text"]), " | ")
    return blocks.withColumn("raw_text", raw).withColumn("r", F.explode(rows)).select("*", "r.*").select(*CANDIDATE, "statement_type")


def parse_blocks(lines: DataFrame, ref_year: int) -> DataFrame:
    """Rows from blocks of lines: dated one-liners, multi-line rows and rows that reuse the last date."""
    return parse_lines(lines, ref_year).where(F.col("priority") == 2)


# ---- tables ------------------------------------------------------------------------------------------------


def _find_column(role: str, headers: Column, taken: list[Column]) -> Column:
    """0-based column of a role: an exact header first, then a whole word; a column serves one role only."""
    keywords = V.TABLE_HEADERS[role]
    pattern = rf"(?U)(?<!\w)(?:{any_of([k.replace('.', chr(92) + '.') for k in keywords])})(?!\w)"

    def first(fits: Callable[[Column], Column]) -> Column:
        def usable(i: Column) -> Column:
            free = reduce(lambda a, b: a & b, [~F.equal_null(i, t) for t in taken], F.lit(True))
            return free & F.coalesce(fits(F.try_element_at(headers, i + 1)), F.lit(False))

        positions = F.sequence(F.lit(0), F.greatest(F.size(headers) - 1, F.lit(0)))
        return F.try_element_at(F.filter(positions, usable), F.lit(1))

    return F.coalesce(first(lambda name: name.isin(keywords)), first(lambda name: name.rlike(pattern)))


def _roles(headers: Column) -> Column:
    """Column of every role, in order of precedence, as a struct."""

    def assign(pending: list[str], taken: list[Column]) -> Column:
        if not pending:
            return F.struct(*[column.alias(role) for role, column in zip(V.TABLE_HEADERS, taken)])
        return let(_find_column(pending[0], headers, taken), lambda column: assign(pending[1:], [*taken, column]))

    return assign(list(V.TABLE_HEADERS), [])


HEADER_WORDS = sorted({w.strip(".") for names in V.TABLE_HEADERS.values() for name in names for w in name.split()} | set(V.HEADER_FILLERS), key=lambda w: (-len(w), w))


UNCUT = "?"


def _cut_into_words(text: Column) -> Column:
    """A text made up of header words alone, with spaces between them; else UNCUT.

    `ends` holds for every place of the text how the part before it is cut; a place is reached from those that one word
    leads from, long words first.
    """

    def reached(ends: Column, place: Column) -> Column:
        def by(word: Column) -> Column:
            start = place - F.length(word)
            before = F.element_at(ends, F.greatest(start, F.lit(0)) + 1)
            fits = (start >= 0) & (before != UNCUT) & (F.substring(text, start + 1, F.length(word)) == word)
            return F.when(fits, F.trim(F.concat(before, F.lit(" "), word))).otherwise(F.lit(UNCUT))

        ways = F.filter(F.transform(F.lit(HEADER_WORDS), by), lambda way: way != UNCUT)
        return F.concat(ends, F.array(F.element_at(F.concat(ways, F.array(F.lit(UNCUT))), 1)))

    places = F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: i > 0)
    return F.element_at(F.aggregate(places, F.array(F.lit("")), reached), -1)


def header_name(cell: Column) -> Column:
    """A header in lower case; words written together are taken apart, by their capitals or as header words."""
    text = strip(F.coalesce(cell, F.lit("")))
    spaced = F.lower(F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])", " "))
    plain = F.lower(text)
    whole = spaced.contains(" ") | plain.isin(HEADER_WORDS) | (F.length(plain) > 60)
    return F.when(whole, spaced).otherwise(let(_cut_into_words(plain), lambda words: F.when(words == UNCUT, plain).otherwise(words)))


def table_roles(tables: DataFrame) -> DataFrame:
    """Column roles of every table, from its header row; one row per usable table.

    Each distinct header is read once, however many tables have it.
    """
    heads = tables.where(F.col("row_no") == 0).select(*PAGE, "table_no", "cells")

    def usable(r: Column) -> Column:
        return r["date"].isNotNull() & r["desc"].isNotNull() & F.coalesce(r["debit"], r["credit"], r["amount"]).isNotNull()

    roles = F.filter(F.array(let(F.transform("cells", header_name), _roles)), usable)
    layouts = heads.select("cells").distinct().select("cells", F.explode(roles).alias("roles"))
    return heads.join(layouts, "cells").select(*PAGE, "table_no", "roles")  # few layouts: Spark sees their bytes and splits hot ones


def parse_tables(tables: DataFrame, ref_year: int) -> DataFrame:
    """Rows of extracted tables; the amount column wins, then debit (negative), then credit (positive)."""

    def cell(role: str) -> Column:
        return F.coalesce(strip(F.try_element_at("cells", F.col(f"roles.{role}") + 1)), F.lit(""))

    def found(amount: Column, debit: Column, credit: Column) -> Column:
        return F.struct(
            F.coalesce(amount, debit, credit).alias("amount"),
            F.when(debit.isNotNull(), "withdrawals").when(credit.isNotNull(), "deposits").alias("section"),
        )

    def priced(raw: Column) -> Column:
        def with_credit(amount: Column, debit: Column) -> Column:
            credit = F.when(amount.isNull() & debit.isNull(), F.abs(S.parse_amount(cell("credit"))))
            return let(credit, lambda c: found(amount, debit, c))

        def with_debit(amount: Column) -> Column:
            return let(F.when(amount.isNull(), -F.abs(S.parse_amount(cell("debit")))), lambda debit: with_credit(amount, debit))

        return let(S.parse_amount(cell("amount"), raw), with_debit)

    def whole(row: Column) -> Column:
        return F.struct(
            row["date"].alias("transaction_date"),
            row["description"].alias("description"),
            row["raw"].alias("raw_text"),
            priced(row["raw"]).alias("found"),
        )

    data = tables.where((F.col("row_no") > 0) & F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    raw = F.array_join(F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))), " | ")
    # Every text is worked on inside one generator: as columns and filters, Spark would repeat the work for each mention.
    dated = F.filter(F.array(S.parse_date(cell("date"), ref_year)), lambda date: date.isNotNull())
    told = F.filter(
        F.transform(dated, lambda date: F.struct(date.alias("date"), clean_description(cell("desc")).alias("description"))),
        lambda row: (row["description"] != "") & ~S.is_summary_line(row["description"]),
    )
    rows = F.transform(told, lambda row: F.struct(row["date"].alias("date"), row["description"].alias("description"), raw.alias("raw")))
    kept = F.filter(F.transform(rows, whole), lambda row: row["found"]["amount"].isNotNull())
    return (
        data.join(table_roles(tables), [*PAGE, "table_no"])
        .select(*PAGE, "table_no", "row_no", F.explode(kept).alias("r"))
        .select(*PAGE, "table_no", "row_no", "r.*")
        .select("*", "found.*")
        .withColumn("line_no", F.col("table_no") * 1_000_000_000 + F.col("row_no"))
        .withColumn("priority", F.lit(0))
        .select(*CANDIDATE)
    )


# ---- finishing ---------------------------------------------------------------------------------------------


def union_strategies(text_rows: DataFrame, block_rows: DataFrame) -> DataFrame:
    return text_rows.unionByName(block_rows)


def dedup_transactions(rows: DataFrame) -> DataFrame:
    """First row, by strategy and place, of equal date, cents and lower-case description in a statement."""
    key = ["statement_id", "transaction_date", F.round("amount", 2), F.lower(strip("description"))]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("priority", "page_no", "line_no"))
    return rows.withColumn("_first", first).where(F.col("_first") == 1).drop("_first")


def judge_candidates(rows: DataFrame) -> DataFrame:
    """Adds `is_metadata`, the corrected `new_amount` and `sign_changed`; needs `statement_type`."""
    blob = F.concat_ws(" ", "description", "raw_text")
    new_amount = S.normalize_sign(
        F.col("amount"), F.col("description"), F.col("statement_type"), F.col("section"), F.col("raw_text")
    )
    return (
        rows.withColumn("is_metadata", S.is_metadata_line(blob))
        .withColumn("new_amount", new_amount)
        .withColumn("sign_changed", ~F.col("is_metadata") & ((F.col("new_amount") < 0) != (F.col("amount") < 0)))
    )


def finalize_statement(rows: DataFrame) -> DataFrame:
    """Without metadata, with corrected signs and without duplicates; needs `statement_type`."""
    kept = judge_candidates(rows).where(~F.col("is_metadata")).withColumn("amount", F.col("new_amount"))
    return dedup_transactions(kept.drop("is_metadata", "new_amount", "sign_changed"))


def finalize_counts(rows: DataFrame) -> DataFrame:
    """Per statement: candidates, dropped metadata rows and changed signs."""
    return judge_candidates(rows).groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count(F.when(F.col("is_metadata"), 1)).alias("n_dropped"),
        F.count(F.when(F.col("sign_changed"), 1)).alias("n_sign_changes"),
    )


def parse_statements(lines: DataFrame, tables: DataFrame, ref_year: int) -> tuple[DataFrame, DataFrame]:
    """Transactions of all statements and, per statement, the strategy or the failure.

    A statement with any finished table row uses its tables only; every other one uses text and blocks.
    """
    # One row per statement, per candidate and per transaction: written once, read by every step below and by the caller.
    types = cut_lineage(statement_types(lines))
    table_sizes = tables.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_lines"))
    from_tables = cut_lineage(
        finalize_statement(with_statement_type(parse_tables(tables, ref_year), types, table_sizes))
    )
    by_table = from_tables.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_table"))
    undecided = types.join(by_table, "statement_id", "left_anti").select("statement_id", "statement_type")
    # Statements decided by their tables need no text work at all.
    rest = attach(lines, undecided, ["statement_id"], _place(), counted=types, weight="n_lines", how="inner")
    candidates = cut_lineage(parse_lines(rest, ref_year))
    found = candidates.groupBy("statement_id").agg(
        F.count(F.when(F.col("priority") == 1, 1)).alias("n_text"), F.count(F.when(F.col("priority") == 2, 1)).alias("n_block")
    )
    from_text = cut_lineage(finalize_statement(candidates))
    finished = from_text.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_finished"))
    everything = types.select("statement_id", "statement_type", "has_text").join(
        tables.select("statement_id").distinct(), "statement_id", "full_outer"
    )
    strategy = (
        F.when(F.col("n_table") > 0, "table")
        .when(~F.coalesce("has_text", F.lit(False)), "no_text")
        .when(F.coalesce("n_finished", F.lit(0)) == 0, "no_transactions")
        .when((F.col("n_text") > 0) & (F.col("n_block") > 0), "text+block")
        .when(F.col("n_text") > 0, "text")
        .otherwise("block")
    )
    status = (
        everything.join(by_table, "statement_id", "left")
        .join(found, "statement_id", "left")
        .join(finished, "statement_id", "left")
        .select(
            "statement_id",
            F.coalesce("statement_type", F.lit("unknown")).alias("statement_type"),
            strategy.alias("strategy"),
            F.coalesce("n_table", "n_finished", F.lit(0)).cast("bigint").alias("n_transactions"),
        )
    )
    return from_tables.unionByName(from_text), status


def line_diagnostics(lines: DataFrame, per_page: int = 30) -> DataFrame:
    """What the parser sees in the first lines of every page, blank lines aside."""
    text = F.col("text")
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no"))
    first = lines.withColumn("text", strip("line")).where(text != "").withColumn("_rank", rank).where(F.col("_rank") <= per_page)
    date, amounts = S.match_date(text), S.find_amounts(text)
    summary = S.is_summary_line(text)
    return first.select(
        *PAGE,
        "line_no",
        F.substring("text", 1, 120).alias("line"),
        F.nullif(date, F.lit("")).alias("date_at_start"),
        amounts.alias("amounts"),
        summary.alias("is_summary"),
        ((date != "") & (F.size(amounts) > 0) & ~summary).alias("would_parse"),
    )


# ---- cleanup audit -----------------------------------------------------------------------------------------


def chunk_rows(rows: DataFrame, size: int = V.CLEANUP_CHUNK_ROWS) -> DataFrame:
    """Chunk number of every row: runs of `size` rows of a statement, in page and line order."""
    numbered = running_index(rows, ["statement_id"], F.col("page_no"), [F.asc("line_no")], "_seq")
    return numbered.withColumn("chunk_no", F.floor((F.col("_seq") - 1) / size).cast("bigint")).drop("_seq")


def row_key() -> Column:
    """Raw text of a row, or date|description|amount without one."""
    amount = F.col("amount").cast("string")
    return F.coalesce(
        F.nullif(strip("raw_text"), F.lit("")), F.concat_ws("|", F.col("transaction_date").cast("string"), "description", amount)
    )


def cleanup_diff(candidates: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Candidates whose key is missing from the cleaned rows."""
    keys = cleaned.select("statement_id", row_key().alias("_key")).distinct()
    return candidates.withColumn("_key", row_key()).join(keys, ["statement_id", "_key"], "left_anti").drop("_key")


def removal_fraction(candidates: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Per statement: counts, removed share and whether to keep the input after all."""
    totals = candidates.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_input"))
    removed = cleanup_diff(candidates, cleaned).groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("n_removed"),
        F.bool_or(~S.cleanup_is_metadata(F.col("description"), F.col("raw_text"))).alias("some_ambiguous"),
    )
    kept = cleaned.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_cleaned"))
    share = F.coalesce("n_removed", F.lit(0)) / F.col("n_input")
    suspicious = (share > V.MAX_REMOVAL_FRACTION) & F.coalesce("some_ambiguous", F.lit(False))
    return (
        totals.join(removed, "statement_id", "left")
        .join(kept, "statement_id", "left")
        .select(
            "statement_id",
            "n_input",
            F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
            share.alias("removed_share"),
            (suspicious | (F.coalesce("n_cleaned", F.lit(0)) == 0)).alias("keep_input"),
        )
    )


def cleanup_apply(candidates: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Cleaned rows with enforced signs, or the input where cleaning removed too much or everything."""
    columns = ["statement_id", "transaction_date", "description", "amount", "raw_text"]
    signed = cleaned.withColumn("amount", S.sign_by_type(F.col("amount"), F.col("transaction_type")))
    verdict = removal_fraction(candidates, signed).select("statement_id", "keep_input")

    def side(rows: DataFrame, keep_input: bool) -> DataFrame:
        judged = attach(rows.select(*columns), verdict, ["statement_id"], F.struct("raw_text", "description"))
        return judged.where(F.coalesce("keep_input", F.lit(False)) == keep_input).select(*columns)

    return side(candidates, True).unionByName(side(signed, False))
