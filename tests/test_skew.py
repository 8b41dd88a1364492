"""Salted joins and cell-wise windows against the plain way, on data where one key holds most rows."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from coinweir.operators import detectors as D
from coinweir.plans import skew


def skewed(spark):
    key = F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 5) * 3571)
    return spark.range(3000).select("id", key.alias("key"), ts.alias("ts"), ((F.col("id") * 7919) % 1000 / 10.0).alias("amount"))


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_salted_attach_equals_join(spark):
    rows = skewed(spark)
    lookup = rows.groupBy("key").agg(F.sum("id").alias("total"), F.count("*").alias("n"))
    for counted, weight in ((None, "n_rows"), (lookup, "n")):
        got = skew.attach(rows, lookup, ["key"], F.col("id"), counted=counted, weight=weight)
        assert same(got.select("id", "total"), rows.join(lookup, "key", "left").select("id", "total"))


def test_attach_spreads_the_hot_key(spark):
    rows = skewed(spark)
    keys = [r.key for r in skew.hot_keys(rows.groupBy("key").agg(F.count("*").alias("n")), ["key"], "n").collect()]
    assert "hot" in keys and len(keys) <= skew.HOT_SHARE
    salts = rows.where("key = 'hot'").select(F.pmod(F.xxhash64("id"), F.lit(skew.SALTS)).alias("s")).groupBy("s").count()
    assert salts.count() == skew.SALTS


def test_running_index_equals_row_number(spark):
    rows = skewed(spark)
    for down in (False, True):
        order = [F.desc("ts"), F.desc("id")] if down else [F.asc("ts"), F.asc("id")]
        got = skew.running_index(rows.dropna(), ["key"], skew.time_cell("ts", skew.DAY_US), order, "n", descending_cells=down)
        plain = rows.dropna().withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("bigint"))
        assert same(got.select("id", "n"), plain.select("id", "n"))


def test_prior_totals_equal_a_running_window(spark):
    rows = skewed(spark).dropna()
    before = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    got = skew.prior_totals(rows, ["key"], "ts", "id", "amount", "p", counted_when=F.col("id") % 2 == 0)
    value = F.when(F.col("id") % 2 == 0, F.col("amount"))
    plain = rows.select(
        "id", F.count(value).over(before).alias("p_n"), F.round(F.coalesce(F.sum(value).over(before), F.lit(0.0)), 6).alias("p_sum")
    )
    assert same(got.select("id", "p_n", F.round("p_sum", 6).alias("p_sum")), plain)


def test_overlap_cells_keep_every_look_back(spark):
    rows = skewed(spark).dropna()
    span = 3 * skew.HOUR_US
    sliced = skew.overlap_cells(rows, "ts", span).withColumn("us", F.unix_micros("ts"))
    window = Window.partitionBy("key", "_slice").orderBy("us").rangeBetween(-span, 0)
    got = sliced.withColumn("n", F.count("*").over(window)).where("_core").select("id", "n")
    whole = Window.partitionBy("key").orderBy("us").rangeBetween(-span, 0)
    plain = rows.withColumn("us", F.unix_micros("ts")).withColumn("n", F.count("*").over(whole)).select("id", "n")
    assert same(got, plain)


def test_sorted_index_is_dense_and_ordered(spark):
    got = skew.sorted_index(spark.range(5000).select(((F.col("id") * 37) % 5000).alias("v")).repartition(7), ["v"], "n")
    assert got.where("v <> n").count() == 0 and got.count() == 5000


def test_top_n_limits_before_the_shuffle(spark):
    from coinweir.operators.reports import top_n_per_user

    rows = skewed(spark).select("id", F.col("key").alias("user_id"), F.col("ts").alias("created_at"))
    assert "WindowGroupLimit" in top_n_per_user(rows, 10)._jdf.queryExecution().executedPlan().toString()


def _charges(spark, rows):
    at = F.timestamp_micros((F.col("minute") * 60_000_000).cast("bigint"))
    frame = spark.createDataFrame(rows, "id long, user_id string, category_name string, minute double")
    return frame.select("id", "user_id", "category_name", F.lit("expense").alias("transaction_type"), F.lit(1.0).alias("amount"), at.alias("created_at"))


def test_look_backs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y", "z", None]), float(rng.choice([rng.randrange(300), rng.randrange(9) * 60]))) for i in range(300)]
    rows += [(900, "a", "x", None)]
    charges = _charges(spark, rows)
    got = {r.id: (r.n_charges, r.n_categories) for r in D.velocity(charges, 1, 0).collect()}
    small = {r.id: r.n_charges for r in D.card_testing(charges, min_charges=1).collect()}
    for i, user, category, minute in rows[:-1]:
        seen = [r for r in rows[:-1] if r[1] == user and minute - 60 <= r[3] <= minute]
        assert got[i] == (len(seen), len({r[2] for r in seen} - {None}))
        assert small[i] == sum(r[2] == category for r in seen)
    assert len(got) == len(small) == 300  # the charge without a time is in neither


def test_look_backs_are_linear_in_a_hot_hour(spark):
    ids = spark.range(40_000)
    hot = ids.select(
        "id",
        F.lit("a").alias("user_id"),
        F.concat(F.lit("c"), F.col("id") % 7).alias("category_name"),
        F.lit("expense").alias("transaction_type"),
        F.lit(1.0).alias("amount"),
        F.timestamp_micros(F.col("id") * 80_000).alias("created_at"),
    )
    took = time.monotonic()
    last = D.velocity(hot).agg(F.max("n_charges").alias("n"), F.max("n_categories").alias("c")).first()
    assert (last.n, last.c) == (40_000, 7)
    assert time.monotonic() - took < 30  # a frame rescanned for every row takes minutes
