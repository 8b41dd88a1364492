"""Exact top-k by inner product (4): norm-bucketed retrieval.

Candidates are ordered by length (norm) and cut into buckets of equal size. The longest of them give each query a
first threshold, which no later score may stay under. A bucket whose longest vector cannot reach it is never sent.
In the others the threshold becomes a cosine threshold local to query and bucket: if it is high, the query's largest
coordinates bound those of a candidate, which leaves few; if it is low, candidates long enough are taken. All
that remain are multiplied exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweir.llm.common import arrow_schema, in_batches, written
from coinweir.plans.skew import sorted_index

SCALE = 64
BUCKET_ROWS = 8_192
QUERY_ROWS = 2_048
TILE_ROWS = 256  # queries multiplied at once: 256 x 8192 scores
HIGH_COSINE = 0.8  # from this local threshold on candidates are chosen by coordinates
FOCUS = 3  # coordinates looked at
_LONG = (1 << 63) - 1


def quantise(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, dim, norm and packed integers floor(SCALE * x) of the usable vectors: in 32 bits each, or as doubles, which
    hold them exactly, if one of the vector's does not fit.

    Vectors null, or holding null or non-finite components, are left out.
    """

    def step(batch):
        made = {"vec_id": [], "dim": [], "norm": [], "packed": []}
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = vector.values
            if not vector.is_valid or key is None or values.null_count:
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.nan_to_num(np.floor(SCALE * x))  # beyond all doubles: the largest
                made["norm"].append(float(np.sqrt((x * x).sum())))
            made["vec_id"].append(key)
            made["dim"].append(len(x))
            made["packed"].append(x.astype("<f8" if (np.abs(x) >= 1 << 31).any() else "<i4").tobytes())
        yield made

    chosen = df.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("v"))
    return in_batches(chosen, step, "vec_id bigint, dim int, norm double, packed binary")


def _same_width(packed: list[bytes], dim: int) -> bytes:
    """Vectors of a block one behind the other: in 32 bits a component if all are so, else as doubles."""
    if all(len(p) == 4 * dim for p in packed):
        return b"".join(packed)
    return b"".join(_components(p, dim).tobytes() for p in packed)


def _components(packed: bytes, places: int) -> np.ndarray:
    return np.frombuffer(packed, "<i4" if len(packed) == 4 * places else "<f8").astype(np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; those beyond 64 bits become the nearest long."""
    bound = float(a.shape[1]) * max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0)))
    if bound < 1 << 53:
        return a @ b.T
    if bound < 1 << 62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    found = whole(a) @ whole(b).T
    return np.array([[min(max(int(v), -_LONG), _LONG) for v in row] for row in found], np.int64).reshape(len(a), len(b))


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Neighbours in order of falling norm, packed: one row for each block and dimension."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        norms = table.column("norm").to_numpy()
        order = np.lexsort((table.column("vec_id").to_numpy(), -norms))
        packed = table.column("packed").to_pylist()
        return pa.table(
            {
                name: pa.array([key[0].as_py()], pa.int64()),
                "dim": pa.array([key[1].as_py()], pa.int32()),
                "n": pa.array([len(order)], pa.int64()),
                "longest": pa.array([float(norms.max())]),
                "ids": [table.column("vec_id").to_numpy()[order].astype("<i8").tobytes()],
                "norms": [norms[order].tobytes()],
                "packed": [_same_width([packed[i] for i in order], key[1].as_py())],
            }
        )

    numbered = sorted_index(vectors, [F.desc("norm"), F.asc("vec_id"), F.asc("packed")], "at")
    grouped = numbered.withColumn(name, F.floor(F.col("at") / rows)).groupBy(name, "dim")
    return written(
        grouped.applyInArrow(pack, f"{name} bigint, dim int, n bigint, longest double, ids binary, norms binary, packed binary"), name
    )


def _candidates(q: np.ndarray, length: float, theta: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of a bucket that may reach `theta`, by coordinates if the local cosine threshold is high."""
    enough = int(np.searchsorted(-norms, -theta / length, side="right")) if theta > 0 else len(norms)
    if not enough:
        return np.zeros(0, np.int64)
    t = theta / (length * norms[0]) - 1e-9
    if t < HIGH_COSINE:
        return np.arange(enough)
    rows = np.arange(enough)
    direction = q / length
    slack = np.sqrt(max(0.0, 1 - t * t))
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        middle, reach = direction[f] * t, slack * np.sqrt(max(0.0, 1 - direction[f] ** 2))
        x = unit[rows, f]
        keep = x >= middle - reach - 1e-9 if direction[f] > 0 else x <= middle + reach + 1e-9
        rows = rows[keep]
    return rows


def search_bucket(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k (query, candidate, score) of one block of queries in one bucket, thresholds respected."""
    dim = row["dim"]
    q_ids, c_ids = (np.frombuffer(row[x], "<i8") for x in ("q_ids", "ids"))
    q, c = (_components(row[x], n * dim).reshape(n, dim) for x, n in (("q_packed", len(q_ids)), ("packed", len(c_ids))))
    q_norms, norms = (np.frombuffer(row[x], np.float64) for x in ("q_norms", "norms"))
    theta = np.frombuffer(row["thetas"], np.float64) if row["thetas"] is not None else np.full(len(q), -np.inf)
    unit = c / np.maximum(norms, 1e-300)[:, None]
    repeated = len(np.unique(c_ids)) < len(c_ids)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best(scores, queries, ids):
        for s, i in zip(scores, queries, strict=True):
            ok = np.flatnonzero((s >= theta[i]) & (ids != q_ids[i]))
            if repeated and len(ok):  # an id and score count once
                ok = ok[np.unique(np.stack([ids[ok], s[ok].astype(np.int64)]), axis=1, return_index=True)[1]]
            if len(ok) > k:
                least = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                ok = ok[s[ok] >= least]
                ok = ok[np.lexsort((ids[ok], -s[ok]))][:k]
            found.append((np.full(len(ok), q_ids[i]), ids[ok], s[ok].astype(np.int64)))

    wide = []
    for i in range(len(q)):
        if q_norms[i] > 0 and norms[0] > 0 and theta[i] > q_norms[i] * norms[0] * (1 + 1e-9):
            continue
        high = q_norms[i] > 0 and norms[0] > 0 and theta[i] > 0 and theta[i] / (q_norms[i] * norms[0]) >= HIGH_COSINE
        if high:
            rows = _candidates(q[i], q_norms[i], theta[i] * (1 - 1e-9), unit, norms)
            best(_products(q[i : i + 1], c[rows]), [i], c_ids[rows])
        else:
            wide.append(i)
    for a in range(0, len(wide), TILE_ROWS):
        tile = np.array(wide[a : a + TILE_ROWS])
        need = [theta[i] / q_norms[i] * (1 - 1e-9) if q_norms[i] > 0 and theta[i] > 0 else 0.0 for i in tile]
        enough = int(np.searchsorted(-norms, -min(need), side="right"))  # length bound of the easiest query
        best(_products(q[tile], c[:enough]), tile, c_ids[:enough])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _search(pairs: DataFrame, k: int) -> DataFrame:
    fields = arrow_schema(pairs.sparkSession, "query_id bigint, vec_id bigint, score bigint")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in search_bucket(row, k)], schema=fields)

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    df: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query row. A product beyond
    64 bits counts as the nearest long.

    Candidates are all usable rows (see `quantise`) of the query's dimension but those with its id; ties go to the
    smaller id. Rows that repeat an id and score count once; a null id takes no part; a query without candidates
    has no row; other columns are not read.
    """
    vectors = quantise(df, id_column, vector_column)
    buckets = _blocks(vectors, bucket_rows, "bucket")
    queries = _blocks(quantise(df.where(is_query), id_column, vector_column), QUERY_ROWS, "q_block")
    queries = queries.select("q_block", "dim", *(F.col(c).alias(f"q_{c}") for c in ("ids", "norms", "packed", "longest")))

    # one row of numbers for each bucket: which of them come first
    before = Window.partitionBy("dim").orderBy(F.desc("longest"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = buckets.select("bucket", "dim", "n", "longest").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    head, tail = (places.where(x).select("bucket", "dim", "longest") for x in (F.col("before") < bucket_rows, F.col("before") >= bucket_rows))
    content = buckets.select("bucket", "dim", "ids", "norms", "packed")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def visits(blocks, wanted, bound=None):
        plan = blocks.select("q_block", "dim", *([bound] if bound is not None else [])).join(wanted, "dim")
        if bound is not None:
            plan = plan.where("need IS NULL OR longest >= need")
        return plan.select("q_block", "bucket", "dim").join(blocks, ["q_block", "dim"]).join(content, ["bucket", "dim"]).repartition(tasks, "q_block", "bucket")

    first = written(_search(visits(queries.withColumn("thetas", F.lit(None).cast("binary")), head), k), "first")
    least = _ranked(first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("theta")).where(F.col("n") == k)

    def members(batch):
        for block, dim, ids in zip(*(batch.column(c).to_pylist() for c in ("q_block", "dim", "q_ids")), strict=True):
            ids = np.frombuffer(ids, "<i8")
            yield {"q_block": [block] * len(ids), "dim": [dim] * len(ids), "at": np.arange(len(ids)), "query_id": ids}

    limits = in_batches(queries, members, "q_block bigint, dim int, at int, query_id bigint")
    limits = limits.join(least, "query_id", "left").groupBy("q_block", "dim").agg(
        F.sort_array(F.collect_list(F.struct("at", "query_id", "theta"))).alias("limits")
    )

    def attach(batch):
        made = {c: batch.column(c) for c in ("q_block", "dim", "q_ids", "q_norms", "q_packed")} | {"thetas": [], "need": []}
        for limit, norms in zip(batch.column("limits").to_pylist(), batch.column("q_norms").to_pylist(), strict=True):
            theta = np.array([-np.inf if x["theta"] is None else x["theta"] for x in limit], np.float64)
            norm = np.frombuffer(norms, np.float64)
            made["thetas"].append(theta.tobytes())
            positive = (theta > 0).all() and (norm > 0).all() and len(theta) > 0
            made["need"].append(float((theta / norm).min() * (1 - 1e-9)) if positive else None)
        yield made

    bounded = written(
        in_batches(
            queries.join(limits, ["q_block", "dim"]), attach, "q_block bigint, dim int, q_ids binary, q_norms binary, q_packed binary, thetas binary, need double"
        ),
        "bounded",
    )
    second = _search(visits(bounded, tail, "need"), k)
    return _ranked(first.unionByName(second), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

