"""URL filters (10): rules, and a ratio of two character language models where no rule fits.

DataFrame functions only. URLs that rules allow and block are the accepted and rejected examples. Each class has a
variable-order Markov model of its characters: counts of 1 to 3 symbols, each order smoothed with the next shorter
one. As the alphabet is fixed, the log ratio of both models is a table of ALPHABET_SIZE ** 3 rows, whatever the
input, so that it may be broadcast. A URL's score is the mean of its symbols' log ratios; the limit lies between the
scores of both classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweir.llm.common import written

# symbols of a URL in lower case; 0 stands for every digit, what is not listed counts as one symbol of its own
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0-._/?=&%#:+"
ALPHABET_SIZE = len(SYMBOLS) + 2  # place 0: other symbols; the last place: before the beginning
SMOOTHING = 4.0  # weight of the shorter context, in occurrences
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # verdict, host and path as in "example.org/en/"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without `://` or for null."""
    begin = F.locate("://", url)
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, null if none; of equally long ones the first."""
    tests = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*tests, F.lit(None).cast("struct<verdict:string,rule:string>"))


def symbol_codes(url: Column) -> Column:
    """Places of the URL's symbols in the alphabet, behind two begin marks."""
    text = F.translate(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"\d", "0"), "\n", " ")
    text = F.when(F.locate("://", text) > 0, F.substring(text, F.locate("://", text) + 3, F.length(text))).otherwise(text)
    begin = F.lit(ALPHABET_SIZE - 1)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(SYMBOLS), c))
    return F.concat(F.array(begin, begin), codes)


def trigram_codes(codes: str) -> Column:
    """Number of each symbol with the two before it, from a column of symbol codes."""
    a, n = ALPHABET_SIZE, F.size(codes) - 2
    runs = F.arrays_zip(*(F.slice(codes, k, n).alias(name) for k, name in ((1, "a"), (2, "b"), (3, "c"))))
    return F.transform(runs, lambda x: (x["a"] * (a * a) + x["b"] * a + x["c"]).cast("int"))


def log_ratios(examples: DataFrame) -> DataFrame:
    """t and r: for each symbol behind two others, log P(accepted) - log P(rejected) in millionths.

    `examples` has a row for each trigram t of a URL and accepted (boolean). Counts are added up before the shuffle,
    so no more than ALPHABET_SIZE ** 3 of them leave a task. Without examples of both classes every ratio is 0.
    """
    a = ALPHABET_SIZE
    spark = examples.sparkSession
    counts = examples.groupBy("t").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    grid = spark.range(a**3).select(
        F.col("id").cast("int").alias("t"),
        (F.col("id") % (a * a)).cast("int").alias("bc"),
        (F.col("id") % a).cast("int").alias("c"),
        F.floor(F.col("id") / a).cast("int").alias("ab"),
    )
    filled = grid.join(counts, "t", "left").na.fill(0, ["yes", "no"])
    sums = lambda key, kind: filled.groupBy(key).agg(F.sum("yes").alias(f"yes_{kind}"), F.sum("no").alias(f"no_{kind}"))
    pairs = sums("bc", "bc").withColumn("b", F.floor(F.col("bc") / a).cast("int")).withColumn("c", F.col("bc") % a)
    singles, firsts = sums("c", "c"), pairs.groupBy("b").agg(F.sum("yes_bc").alias("yes_b"), F.sum("no_bc").alias("no_b"))
    total = filled.agg(F.sum("yes").alias("yes_all"), F.sum("no").alias("no_all"))
    # all of these tables are as small as the alphabet makes them
    table = (
        filled.join(F.broadcast(pairs.drop("c")), "bc")
        .join(F.broadcast(singles), "c")
        .join(F.broadcast(firsts), "b")
        .join(F.broadcast(sums("ab", "ab")), "ab")
        .withColumns({"yes_all": total.select("yes_all").scalar(), "no_all": total.select("no_all").scalar()})
    )

    def log_p(kind: str) -> Column:
        n = lambda of: F.col(f"{kind}_{of}").cast("double")
        one = (n("c") + 1) / (n("all") + a)
        two = (n("bc") + SMOOTHING * one) / (n("b") + SMOOTHING)
        return F.log((F.col(kind) + SMOOTHING * two) / (n("ab") + SMOOTHING))

    both = (F.col("yes_all") > 0) & (F.col("no_all") > 0)
    ratio = F.when(both, F.round((log_p("yes") - log_p("no")) * 1_000_000)).otherwise(0).cast("bigint")
    return table.select("t", ratio.alias("r"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score of every row.

    A null URL, or one without `://`, has an empty host and path and no rule. A URL without symbols has no score; it,
    and every URL without a rule while a class has no example, is allowed. Repeated rows are judged one by one, but a
    URL is an example once; a null id is kept; other columns are not read.
    """
    urls = pages.select(F.col(id_column).alias("page_id"), F.coalesce(url_column, F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    judged = urls.withColumns({"host": host, "path": path}).withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    grams = (
        judged.select("url", (F.col("match.verdict") == "allow").alias("accepted"))
        .distinct()
        .withColumn("codes", symbol_codes(F.col("url")))
        .select("url", "accepted", F.explode(trigram_codes("codes")).alias("t"))
    )
    model = written(log_ratios(grams.where("accepted IS NOT NULL")), "ratios")
    scores = grams.join(F.broadcast(model), "t").groupBy("url", "accepted").agg(F.sum("r").alias("sum"), F.count(F.lit(1)).alias("n"))
    scores = written(scores.select(F.col("url").alias("scored"), "accepted", (F.col("sum") / F.col("n") / 1_000_000).alias("score")), "scores")
    # the limit is as many standard deviations away from either class
    yes, no = F.col("accepted"), ~F.col("accepted")
    middle = lambda x: F.avg(F.when(x, F.col("score")))
    spread = lambda x: F.stddev_pop(F.when(x, F.col("score"))) + 1e-9
    limit = scores.agg(((middle(yes) * spread(no) + middle(no) * spread(yes)) / (spread(yes) + spread(no))).alias("limit")).scalar()
    method = F.when(F.col("score") < limit, "block").otherwise("allow")
    return judged.join(scores, F.col("url") == F.col("scored"), "left").select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", method).alias("verdict"), "score"
    )
