"""Helpers shared by the operators: reading, folds, Arrow batches, written intermediate tables, bounded bit maps."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coinweir.session import fresh_path

GROUP_BYTES = 4 << 20  # text handled at once inside a task; a longer document is handled alone
# Unicode white space, for a character class of re or regex
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Pieces of a text at whose ends every match of the byte-level pattern ends too: it never joins text with white
# space behind it, nor letters with one of these marks behind them.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
CHUNK = re.compile(
    f" ?[{LETTERS}]+(?=[ ,.!?;:])|[{SPACE}]*(?:[{LETTERS}]+(?=[,.!?;:])|[^{SPACE}]+)|[{SPACE}]+"
)
BATCH_ROWS = 1_000  # rows handed to a step at once
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = 2 << 20  # bytes that Spark puts in one Arrow batch, about; a longer row is a batch of its own
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
FILTER_BITS = 24  # a bit map has 2**24 bits, 2 MB, however many keys are put in


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def may_be_among_first(key: Column, rows: int, of: Column, share: int = 4) -> Column:
    """Whether a key is in the part of all hashes that holds about `share` x `rows` of `of` rows.

    A ranking for a sample of `rows` then needs these alone, and no task ranks a whole group.
    """
    place = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)).cast("double") / (1 << 30)
    return place * of <= share * rows


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand BATCH_ROWS rows at a time to Python: whole texts in larger batches take much memory
    outside the heap. The session's own setting is put back."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`mapInArrow` with batches of BATCH_BYTES.

    Spark holds a batch twice outside the heap, and the Python worker once more; by its own setting that is a whole
    task's texts. The frame runs when the caller writes it, so the setting stays; a session's own one is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(BYTES_SETTING, None) is None:
        conf.set(BYTES_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def in_batches(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Run `step` over Arrow batches of `df`; it yields dictionaries of column arrays that fit `schema`."""
    fields = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            for made in step(batch):
                yield pa.RecordBatch.from_arrays([_as(made[f.name], f.type) for f in fields], schema=fields)
        release()

    return map_batches(df, run, schema)


def rows_where(df: DataFrame, wanted: Callable[[list[bytes | None]], np.ndarray]) -> DataFrame:
    """Whole rows of `df` whose text is wanted, decided in the pass that reads them."""

    def run(batches):
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            yield batch.filter(pa.array(wanted(text_bytes(batch)), pa.bool_()))
        release()

    return map_batches(df, run, df.schema)


_CACHES: dict[int, dict] = {}  # what this Python worker remembers, and which of it the task at hand has used
_USED: set[int] = set()


def remembered(cache: dict) -> dict:
    """Marks a worker's cache as used by the task at hand. At the end of a task that did not use it, or when a task
    begins to fill another, it is emptied: a worker goes on to other operators' tasks, which need the memory."""
    _CACHES[id(cache)] = cache
    _USED.add(id(cache))
    if not cache:
        _forget()
    return cache


def _forget() -> None:
    for key, cache in _CACHES.items():
        if key not in _USED:
            cache.clear()


def release() -> None:
    """Give freed memory back to the system: a Python worker stays for later tasks, beside its executor's JVM."""
    _forget()
    _USED.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
        if trim is not None:
            trim(0)


def _as(values, kind):
    return values.cast(kind) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a text column, without decoding; null stays None."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary()).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a column; null is empty, broken UTF-8 becomes the replacement character."""
    return [b.decode("utf-8", "replace") if b else "" for b in text_bytes(batch, name)]


def groups(sizes: list[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring rows whose sizes add up to about `limit`."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def unknown(cut: list[list[str]], known: dict) -> list[str]:
    """Distinct pieces that are not in `known`."""
    found: set[str] = set()
    for pieces in cut:
        found.update(filterfalse(known.__contains__, pieces))
    return list(found)


# --- hashing ---------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words, remembered for the common ones (a bounded number)."""

    LIMIT = 150_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = remembered(self.known)
        if len(known) > self.LIMIT:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


WORD_HASHES = WordHashes()  # one for each Python worker


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of every run of `n` word hashes; empty if there are fewer words."""
    if len(h) < n:
        return h[:0]
    last = len(h) - n + 1
    out = mix(h[:last] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * _M1 + h[k : k + last])
    return out


# --- bounded bit maps ------------------------------------------------------------------------------------


def cell(key: Column) -> Column:
    """Place of a key in the bit map."""
    return F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).cast("int")


def bit_map(cells: DataFrame, name: str) -> bytes:
    """2**FILTER_BITS bits with those of the column's values set.

    It is put together by Spark in words of 64 bits, so the driver gets 4 MB at most, whatever the number of
    keys. A set bit only says that a key may be there; what passes is checked by an exact join.
    """
    words = cells.groupBy((F.col(name) / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pmod({name}, 64))")).alias("bits")
    )
    found = words.toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.tobytes()


def bit_test(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether the bits of `cells` are set; `bits` are the map's bytes as uint8."""
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
