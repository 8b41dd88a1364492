"""Building blocks that keep a hot key from landing in one task.

One key may hold a large share of all rows, so nothing here lets a window partition or a join key grow
with it. Ordered computations are split into *cells* (a time slice or a page of the key), solved inside
each cell and stitched together from per-cell totals, which are small. Lookups spread a hot key over
`SALTS` copies of its single lookup row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweir.session import cut_lineage

HOT_SHARE = 1000  # a key is hot above 1/1000 of all rows, so there are at most 1000 hot keys to broadcast
SALTS = 64

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000


def hot_keys(counted: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Keys above 1/HOT_SHARE of the total weight: at most HOT_SHARE rows whatever the input size."""
    total = counted.agg(F.sum(weight).alias("total")).scalar()
    return counted.where(F.col(weight) * HOT_SHARE > total).select(*keys)


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Column,
    counted: DataFrame | None = None,
    weight: str = "n_rows",
    how: str = "left",
) -> DataFrame:
    """Join `rows` to one `lookup` row per key, salting the hot keys.

    `counted` holds the row count of each key (`weight`); without it the keys of `rows` are counted with
    map-side combine. `spread` is any deterministic value that differs between rows of one key.
    """
    keys = list(keys)
    if counted is None:
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))
    hot = F.broadcast(hot_keys(counted, keys, weight).withColumn("_hot", F.lit(True)))
    salted = (
        rows.join(hot, keys, "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
        .drop("_hot")
    )
    copies = (
        lookup.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("_hot")
    )
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def time_cell(ts: str | Column, width_us: int) -> Column:
    """Number of the time slice a timestamp falls into."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(column) / F.lit(width_us)).cast("bigint")


def running_index(
    df: DataFrame,
    keys: Sequence[str],
    cell: Column,
    order: Sequence[Column],
    name: str,
    descending_cells: bool = False,
) -> DataFrame:
    """1-based position of each row of a key, in `order`, numbered cell by cell.

    `cell` must follow the order: every row of an earlier cell comes before every row of a later one.
    """
    keys = list(keys)
    celled = df.withColumn("_cell", cell)
    by_cell = Window.partitionBy(*keys).orderBy(F.desc("_cell") if descending_cells else F.asc("_cell"))
    before = (
        celled.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    return (
        celled.withColumn("_inside", F.row_number().over(inside))
        .join(before, [*keys, "_cell"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_cell", "_before", "_inside")
    )


def prior_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    amount: str,
    prefix: str,
    width_us: int = DAY_US,
    counted_when: Column | None = None,
) -> DataFrame:
    """Count and sum of `amount` over the strictly earlier rows of each key, as `<prefix>_n`, `<prefix>_sum`.

    Rows order by (ts, tie). `counted_when` limits which earlier rows are counted.
    """
    keys = list(keys)
    wanted = counted_when if counted_when is not None else F.lit(True)
    celled = df.withColumn("_cell", time_cell(ts, width_us)).withColumn("_value", F.when(wanted, F.col(amount)))
    earlier_cells = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        celled.groupBy(*keys, "_cell")
        .agg(F.count("_value").alias("_n"), F.sum("_value").alias("_s"))
        .withColumn("_n_before", F.coalesce(F.sum("_n").over(earlier_cells), F.lit(0)))
        .withColumn("_s_before", F.coalesce(F.sum("_s").over(earlier_cells), F.lit(0.0)))
        .drop("_n", "_s")
    )
    earlier_rows = (
        Window.partitionBy(*keys, "_cell").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        celled.withColumn("_n_in", F.coalesce(F.count("_value").over(earlier_rows), F.lit(0)))
        .withColumn("_s_in", F.coalesce(F.sum("_value").over(earlier_rows), F.lit(0.0)))
        .join(totals, [*keys, "_cell"])
        .withColumn(f"{prefix}_n", F.col("_n_before") + F.col("_n_in"))
        .withColumn(f"{prefix}_sum", F.col("_s_before") + F.col("_s_in"))
        .drop("_cell", "_value", "_n_in", "_s_in", "_n_before", "_s_before")
    )


def overlap_cells(df: DataFrame, ts: str, span_us: int) -> DataFrame:
    """Put every row into its own slice and, as context, into the next one.

    With slices as wide as `span_us`, a look-back of `span_us` never leaves the slice; rows to report are
    those with `_core`. Meant for short spans, so that a slice of a hot key stays small.
    """
    home = time_cell(ts, span_us)
    return df.withColumn(
        "_copy",
        F.explode(
            F.array(
                F.struct(home.alias("slice"), F.lit(True).alias("core")),
                F.struct((home + 1).alias("slice"), F.lit(False).alias("core")),
            )
        ),
    ).select("*", F.col("_copy.slice").alias("_slice"), F.col("_copy.core").alias("_core")).drop("_copy")


def sorted_index(df: DataFrame, order: Sequence[str], name: str, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """0-based dense position of each row in the total order, numbered from a range-partitioned sort.

    The sorted rows are checkpointed, or written by `keep`: positions then stay the same when a task is run again.
    """
    spark_rows = keep(
        df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    )
    numbered = spark_rows.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    parts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per sort partition
    offsets = parts.withColumn(
        "_offset",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("_n")
    return (
        numbered.join(F.broadcast(offsets), "_part")  # as many rows as sort partitions
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_mid", "_part", "_row", "_offset")
    )
