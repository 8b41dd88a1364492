"""Connected components of links, in rounds of contraction with written tables between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweir.llm.common import arrow_schema, written

AT_ONCE = 100_000  # links that one task merges


def _merged(edges: DataFrame) -> DataFrame:
    """a, to of every end of at most AT_ONCE links: `to` is the same node for all that are connected."""
    kind = edges.schema["a"].dataType.simpleString()
    columns = f"a {kind}, to {kind}"
    fields = arrow_schema(edges.sparkSession, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = list(batches)
        ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in links], fields.field("a").type).combine_chunks().dictionary_encode()
        nodes, places, half = ends.dictionary, ends.indices.to_pylist(), len(ends) // 2
        to = list(range(len(nodes)))

        def top(x: int) -> int:
            while to[x] != x:
                to[x] = x = to[to[x]]
            return x

        for x, y in zip(places[:half], places[half:], strict=True):
            x, y = top(x), top(y)
            to[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array([top(x) for x in to], pa.int64()))], schema=fields)

    return edges.select("a", "b").coalesce(1).mapInArrow(run, columns)


def components(links: DataFrame, left: str = "a", right: str = "b", known: DataFrame | None = None) -> DataFrame:
    """node, root of every node that has a link: root is the smallest node reachable.

    `known` is what this function gave for links before; those count too, and only the components that `links` join
    go through the rounds again.

    In a round each node points at the neighbour with the smallest hash, or at itself, and pointed-at nodes
    stand for their followers in the next round's links; hashes differ from round to round, so long chains
    shrink by a constant factor too. Once no more than AT_ONCE links are left, one task merges them: many rounds
    over few links would cost the driver jobs, plans and broadcasts. Nothing but a count comes to the driver.
    Loops and repeated links are fine; a null end is no link.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    if known is not None:
        for end in ("a", "b"):
            edges = edges.join(known.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        more = written(components(edges), "joined")
        if more.isEmpty():
            return known
        # a node of `more` is a root of `known`, which `known` has as its own root, or new
        placed = known.unionByName(more.select("node", F.col("node").alias("root"))).distinct()
        return placed.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    edges = written(edges.distinct(), "links")
    rounds: list[DataFrame] = []
    while left_over := edges.count():
        if left_over <= AT_ONCE:
            rounds.append(written(_merged(edges), "points"))
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("id"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        points = written(nearest.select("a", F.least("m", rank("a"))["id"].alias("to")), "points")
        rounds.append(points)
        edges = written(
            edges.join(points.withColumnRenamed("to", "ta"), "a")
            .join(points.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct(),
            "links",
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select(F.col("a").alias("node"), F.col("to").alias("top"))
    for points in rounds[1:]:
        found = found.join(points, found["top"] == points["a"], "left").select("node", F.coalesce("to", "top").alias("top"))
    if len(rounds) > 1:
        found = written(found, "tops")
    smallest = found.groupBy("top").agg(F.min("node").alias("root"))
    return found.join(smallest, "top").select("node", "root")
