"""Centroid clustering (11): rounds of assignment and mean, with Orchard's search for the nearest centroid.

Every centroid has a list of the others, nearest first. A vector walks along the list of the best centroid it knows,
measures those it has not met, and jumps to the list of a closer one as soon as it finds it. It stops where the list
is strictly farther from the best centroid than twice the vector's own distance: nothing behind can be as near.

Rows never move: a round is one pass over the vectors that sends each task's sums, one row for each of its clusters.
Centroids, their lists and the sums have k rows whatever the input. All arithmetic is on integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweir.llm.common import arrow_schema, release, written

SCALE, DIM = 256, 64
SMALL = 1 << 25  # components below it: squared distances of 64 components stay within 64 bits
ROWS = 4_096  # vectors that walk their lists together
WHOLE = float(1 << 53)  # from here on a double is a whole number
LONG = (1 << 63) - 1


def _exact(x: float) -> int:
    return SCALE * int(x) if abs(x) >= WHOLE else int(np.floor(SCALE * x))


def quantise(df: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """vec_id and floor(SCALE * x) of the vectors with `dim` components, none null or non-finite: packed 32-bit
    integers, or decimal numbers joined by commas (large) where one of them does not stay below SMALL."""
    schema = "vec_id bigint, packed binary, large string"
    fields = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
            batch = batch.filter(fit)
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten()
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            keep = np.isfinite(x).all(axis=1)
            ids, x = batch.column(0).filter(pa.array(keep)), x[keep]
            small = (np.abs(x) < SMALL // SCALE).all(axis=1)
            packed = [np.floor(SCALE * row).astype("<i4").tobytes() if s else None for row, s in zip(x, small, strict=True)]
            large = [None if s else ",".join(str(_exact(v)) for v in row.tolist()) for row, s in zip(x, small, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, fields[1].type), pa.array(large, fields[2].type)], schema=fields)

    chosen = df.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, schema)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


class Lists:
    """Centroids with their sorted neighbour lists, as 64-bit integers or, for large ones, as Python integers."""

    def __init__(self, numbers: list[int], centroids: np.ndarray):
        self.numbers, self.c = np.array(numbers, np.int64), centroids
        k = len(numbers)
        gaps = np.array([_squares(centroids - centroids[i]) for i in range(k)], centroids.dtype).reshape(k, k)
        self.order = np.array([[j for j in sorted(range(k), key=lambda j: (gaps[i][j], j)) if j != i] for i in range(k)], np.int64).reshape(k, k - 1)
        self.gaps = np.array([[gaps[i][j] for j in self.order[i]] for i in range(k)], centroids.dtype).reshape(k, k - 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; of equally near ones the smallest number."""
        n, k = len(x), len(self.c)
        cur, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = _squares(x - self.c[0])
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        walking = np.arange(n)
        while len(walking := walking[at[walking] < k - 1]):
            here = cur[walking], at[walking]
            go = (self.gaps[here] <= 4 * best[walking]).astype(bool)  # distances are squared
            walking, near = walking[go], self.order[here][go]
            at[walking] += 1
            new = ~seen[walking, near]
            rows, near = walking[new], near[new]
            seen[rows, near] = True
            d = _squares(x[rows] - self.c[near])
            closer = ((d < best[rows]) | ((d == best[rows]) & (near < cur[rows]))).astype(bool)
            rows, near = rows[closer], near[closer]
            best[rows], cur[rows], at[rows] = d[closer], near, 0
        return self.numbers[cur], best


class Centroids:
    """Exact centroids; those with small components alone are searched with 64-bit integers."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        small = [i for i, row in enumerate(rows) if all(abs(v) < SMALL for v in row)]
        self.small = Lists(small, np.array([rows[i] for i in small], np.int64)) if small else None
        self.large = [row for i, row in enumerate(rows) if i not in set(small)]
        self.exact = Lists(list(range(len(rows))), np.array(rows, object)) if rows else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For vectors of 64-bit integers below SMALL, or of Python integers."""
        if x.dtype != object and self.small is not None:
            number, best = self.small.nearest(x)
            if not self.large:
                return number, best
            farthest, widest = int(best.max(initial=0)), int(np.abs(x).max(initial=0))
            if all((max(map(abs, row)) - widest) ** 2 > farthest for row in self.large):
                return number, best  # no large centroid comes as near as the small ones
        return self.exact.nearest(x.astype(object))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the batch, vectors) of its small vectors, and of its large ones."""
    packed, large = batch.column("packed"), batch.column("large")
    for at in (np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False)), np.flatnonzero(large.is_valid().to_numpy(zero_copy_only=False))):
        for k in range(0, len(at), ROWS):
            rows = at[k : k + ROWS]
            if packed[int(rows[0])].is_valid:
                flat = np.frombuffer(b"".join(packed.take(pa.array(rows)).to_pylist()), "<i4")
                yield rows, flat.reshape(len(rows), -1).astype(np.int64)
            else:
                yield rows, np.array([[int(v) for v in text.split(",")] for text in large.take(pa.array(rows)).to_pylist()], object)


def round_totals(vectors: DataFrame, centroids: Centroids) -> dict[int, tuple[int, int, list[int]]]:
    """For each cluster that has vectors: their number, summed squared distance and componentwise sums.

    A task sends one row for each of its clusters, at most k; these are added by cluster, in Python integers.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = "cluster int, n bigint, totals string"
    fields = arrow_schema(vectors.sparkSession, schema)

    def rows_of(found: dict[int, list[int]]) -> pa.RecordBatch:
        keys = sorted(found)
        totals = [",".join(map(str, found[k][1:])) for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array(totals, fields[2].type)], schema=fields)

    def add(found: dict[int, list[int]], key: int, numbers: list[int]) -> None:
        found[key] = [a + b for a, b in zip(found[key], numbers, strict=True)] if key in found else numbers

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for batch in batches:
            for _, x in _parts(batch):
                number, best = shared.value.nearest(x)
                for key in np.unique(number).tolist():
                    mine = number == key
                    add(found, key, [int(mine.sum()), sum(best[mine].tolist()), *x[mine].sum(axis=0).tolist()])
        yield rows_of(found)
        release()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for batch in batches:
            for n, totals in zip(batch.column("n").to_pylist(), batch.column("totals").to_pylist(), strict=True):
                add(found, key[0].as_py(), [n, *map(int, totals.split(","))])
        yield rows_of(found)

    sums = vectors.mapInArrow(assign, schema).groupBy("cluster").applyInArrow(merge, schema).toArrow()  # k rows at most
    read = zip(*(sums.column(c).to_pylist() for c in ("cluster", "n", "totals")), strict=True)
    numbers = {k: (n, [int(v) for v in totals.split(",")]) for k, n, totals in read}
    return {k: (n, totals[0], totals[1:]) for k, (n, totals) in numbers.items()}


def first_centroids(vectors: DataFrame, k: int, place: Column) -> list[list[int]]:
    """The `k` first vectors by `place`; of equal places those with the smaller packed vector."""
    rows = vectors.select("vec_id", "packed", "large", place.alias("place")).orderBy(F.col("vec_id").isNull(), "place", "packed", "large").limit(k).collect()
    return [np.frombuffer(bytes(r.packed), "<i4").tolist() if r.packed is not None else [int(v) for v in r.large.split(",")] for r in rows]


def cluster(
    df: DataFrame, k: int = 40, rounds: int = 5, dim: int = DIM, salt: str = "2:", id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Vectors null, of another length than `dim`, or with null or non-finite components are left out. The first
    centroids are the vectors with the smallest sha256 of `salt` and the id; rows without an id come last. With
    fewer vectors than `k` there are fewer centroids, with none no rows. Repeated rows count as often as they
    occur and ties go to the smaller number. Sums of squares beyond 64 bits are computed exactly and shown as null.
    Other columns are not read.
    """
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    vectors = written(quantise(df, id_column, vector_column, dim), "vectors")
    rows = first_centroids(vectors, k, F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        totals = round_totals(vectors, Centroids(rows))
        rows = [[s // totals[i][0] for s in totals[i][2]] if i in totals else row for i, row in enumerate(rows)]
    last = Centroids(rows)
    inertia = {i: found[1] for i, found in round_totals(vectors, last).items()}
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]
    shared = df.sparkSession.sparkContext.broadcast((last, inertia, digest))
    fields = arrow_schema(df.sparkSession, schema)
    shown = lambda v: v if v <= LONG else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, inertia, digest = shared.value
        whole = shown(sum(inertia.values()))
        for batch in batches:
            for at, x in _parts(batch):
                number, best = centroids.nearest(x)
                found = number.tolist()
                made = [
                    batch.column("vec_id").take(pa.array(at)), found, [shown(v) for v in best.tolist()],
                    [shown(inertia[i]) for i in found], [whole] * len(found), [digest[i] for i in found],
                ]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(made, fields, strict=True)], schema=fields)
        release()

    return vectors.mapInArrow(assign, schema)
