"""N-gram Jaccard join (5) with prefix filters under several global token orders.

Tokens are word shingles. Sets that are equal form a class at once, by their fingerprint. For the rest:

* Order A puts shingles by how many documents have their cell of a fixed-size count table that covers all
  documents, rare ones first. Two sets that are similar enough share one of the first `n - ceil(t n) + 1` shingles
  of either: these prefixes are joined.
* Orders B and C put shingles by two hashes. A candidate must share prefix shingles under these too; the prefixes
  are intersected before the sets are.
* A set is first compared with one other, the most central of those that lead one of its prefix shingles; central
  are sets whose own prefix is shared by many. Links merge sets to components. Sets outside the largest component
  of a shingle are then compared with its most central member, and what is left after that with all sets of other
  components. A group of near copies so costs rows in proportion to its size, and no link between components is
  lost. Places in the prefixes bound what two sets can have in common (positional filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweir.llm.common import WORD_HASHES, bit_map, bit_test, cell, groups, in_batches, mix, release, shingle_hashes, small_batches, text_bytes, written
from coinweir.llm.components import components

WORDS = 5
PERCENT = 80
COUNT_BITS = 25  # cells of the count table: 32 MB when read, whatever the input
_RANGE_BITS = 16  # cells in one range of it
_B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8864B)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than `n` are one shingle, none are none."""
    words = text.lower().split() if text else []  # A-Z to lower case; ASCII white space separates
    return np.unique(shingle_hashes(WORD_HASHES(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def count_table(docs: DataFrame, n: int) -> np.ndarray:
    """For each cell the documents that have a shingle of it, as 8 * log2: 2**COUNT_BITS bytes.

    Tasks send the cells that they met, two bytes each, to an owner of a range of cells, of which there is one for
    every 256 tasks; owners add up what comes in and send full ranges to be added. The driver puts the finished
    ranges together, 32 MB at most.
    """
    owners = 1 + docs.rdd.getNumPartitions() // 256

    def send(batch):
        raw = text_bytes(batch)
        for a, b in groups([len(t or b"") for t in raw]):
            cells = np.sort(np.concatenate([_cells(shingle_set(t, n)) for t in raw[a:b]]))
            owner = cells >> _RANGE_BITS
            ends = np.flatnonzero(np.concatenate((owner[1:] != owner[:-1], [True]))) + 1 if len(cells) else []
            low, start, made = (cells & ((1 << _RANGE_BITS) - 1)).astype("<u2"), 0, ([], [])
            for end in ends:
                made[0].append(int(owner[start]))
                made[1].append(low[start:end].tobytes())
                start = end
            mine = np.full(len(made[0]), TaskContext.get().partitionId() % owners, np.int32)
            yield {"range": made[0], "owner": mine, "cells": made[1]}

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << _RANGE_BITS, np.int64)
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                sums += np.bincount(np.frombuffer(cells, "<u2"), minlength=1 << _RANGE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["range", "sums"])

    def finish(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sum(np.frombuffer(raw, np.int64) for batch in batches for raw in batch.column("sums").to_pylist())
        steps = np.minimum(np.ceil(8 * np.log2(sums + 1)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([steps.tobytes()], pa.binary())], ["range", "steps"])

    sent = in_batches(docs, send, "range int, owner int, cells binary")
    added = sent.groupBy("range", "owner").applyInArrow(add, "range int, sums binary")
    with small_batches(docs.sparkSession):
        found = added.groupBy("range").applyInArrow(finish, "range int, steps binary").toArrow()
    table = np.zeros(1 << COUNT_BITS, np.uint8)
    for key, steps in zip(found.column("range").to_pylist(), found.column("steps"), strict=True):
        table[key << _RANGE_BITS : (key + 1) << _RANGE_BITS] = np.frombuffer(steps.as_buffer(), np.uint8)
    del found
    release()
    return table


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _first_by(order: np.ndarray, tokens: np.ndarray, k: int) -> np.ndarray:
    if k < len(order):
        return tokens[np.argpartition(order, k - 1)[:k]]
    return tokens


def prefixes(docs: DataFrame, n: int, percent: int, kind: str) -> DataFrame:
    """Written rows of two kinds: for each document (doc_id, cls, n) without token; for each class met in a task
    (token, cls, n, at) of its prefix under order A. cls is a 64-bit fingerprint; with n it names a set."""
    shared = docs.sparkSession.sparkContext.broadcast(count_table(docs.select("text"), n))

    def step(batch, met={}):  # noqa: B006  classes of this task whose prefix is sent
        from xxhash import xxh3_64_intdigest

        task = TaskContext.get().taskAttemptId()
        if task not in met:
            met.clear()
            met[task] = set()
        counts, seen = shared.value, met[task]
        sizes, names, rows, tokens = [], [], [], []
        for text in text_bytes(batch):
            s = shingle_set(text, n)
            name = xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
            sizes.append(len(s))
            names.append(name)
            if len(s) and (name, len(s)) not in seen:
                seen.add((name, len(s)))
                k = prefix_length(len(s), percent)
                order = (counts[_cells(s)].astype(np.uint64) << np.uint64(56)) | (mix(s) >> np.uint64(8))
                first = s[np.argsort(order)[:k]]
                tokens.append(first.view(np.int64))
                rows.append((name, len(s), len(first)))
        yield {"doc_id": batch.column(0), "token": pa.nulls(len(sizes), pa.int64()), "cls": names, "n": sizes, "at": pa.nulls(len(sizes), pa.int32())}
        if rows:
            per = np.array([r[2] for r in rows])
            yield {
                "doc_id": pa.nulls(int(per.sum()), batch.column(0).type),
                "token": np.concatenate(tokens),
                "cls": np.repeat(np.array([r[0] for r in rows], np.int64), per),
                "n": np.repeat(np.array([r[1] for r in rows], np.int64), per),
                "at": np.concatenate([np.arange(k) for k in per]),
            }

    made = written(in_batches(docs, step, f"doc_id {kind}, token bigint, cls bigint, n int, at int"), "prefixes")
    shared.destroy()  # what is written needs it no more
    return made


def sets_of(docs: DataFrame, ids: DataFrame, n: int, percent: int, kind: str) -> DataFrame:
    """doc_id, tokens and the prefixes b and c under orders B and C, of the documents with these ids."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(ids.select(cell(F.col("doc_id")).alias("c")), "c"))

    def step(batch):
        wanted = bit_test(np.frombuffer(shared.value, np.uint8), batch.column(2).to_numpy().astype(np.int64))
        raw = text_bytes(batch)
        rows, made = [], {"tokens": [], "b": [], "c": []}
        for row in np.flatnonzero(wanted):
            s = shingle_set(raw[row], n)
            if len(s):
                k = prefix_length(len(s), percent)
                rows.append(row)
                made["tokens"].append(s.view(np.int64))
                made["b"].append(_first_by(mix(s ^ _B), s, k).view(np.int64))
                made["c"].append(_first_by(mix(s ^ _C), s, k).view(np.int64))
        if rows:
            yield {"doc_id": batch.column(0).take(pa.array(rows))} | {k: _lists(v) for k, v in made.items()}

    found = in_batches(docs.withColumn("place", cell(F.col("doc_id"))), step, f"doc_id {kind}, tokens array<bigint>, b array<bigint>, c array<bigint>")
    return found.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and position bounds for rows of one shingle, columns n<a>, at<a>, n<b>, at<b>.

    If the shingle is the first that both prefixes have, the sets have no more in common than what follows it in
    either. A row for a later shingle may fail where the pair is good; the row of the first one does not.
    """
    na, nb, ia, ib = (F.col(x).cast("bigint") for x in (f"n{a}", f"n{b}", f"at{a}", f"at{b}"))
    length = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return length & (F.least(na - ia, nb - ib) * (100 + percent) >= (na + nb) * percent)


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, kind: str) -> DataFrame:
    """Those pairs of documents a, b that pass orders B and C and are similar enough by their whole sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = written(sets_of(docs, ids, n, percent, kind), "sets")
    of = lambda x, *columns: sets.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    prefixed = pairs.join(of("a", "b", "c"), "a").join(of("b", "b", "c"), "b")
    near = written(prefixed.where(F.arrays_overlap("b_a", "b_b") & F.arrays_overlap("c_a", "c_b")).select("a", "b").distinct(), "near")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    whole = near.join(of("a", "tokens"), "a").join(of("b", "tokens"), "b")
    found = whole.where(both * 100 >= (F.size("tokens_a") + F.size("tokens_b") - both) * percent)
    return written(found.select("a", "b"), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep", "rep_l").alias("a"), F.greatest("rep", "rep_l").alias("b")).distinct()


def _placed(shared: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix rows with the component of their set (top), and for each shingle that several components have
    the largest one (main)."""
    placed = shared.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("top", F.coalesce("root", "rep")).drop("root")
    placed = written(placed, "placed")
    main = (
        placed.groupBy("token", "top")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("token")
        .agg(F.max(F.struct("size", "top"))["top"].alias("main"), F.count(F.lit(1)).alias("tops"))
        .where("tops > 1")
        .select("token", "main")
    )
    return placed, main


def jaccard_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) of every row.

    Two rows link if 100 * |intersection| >= percent * |union| of their sets of `words`-word shingles. A null,
    empty or blank text has an empty set, links with nothing and is its own component. Rows that repeat an id and
    its text give equal rows; an id with several texts stands for all of them. A row without an id takes part in
    no group: its component is null. Other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    made = prefixes(docs, words, percent, kind)
    members = made.where("token IS NULL").select("doc_id", "cls", "n")
    named = members.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(named.groupBy("cls", "n").agg(F.min("doc_id").alias("rep")), "classes")
    tokens = made.where("token IS NOT NULL").select("token", "cls", "n", "at")

    # shingles that only one class has can link nothing
    sizes = tokens.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count(F.lit(1)).alias("size"))
    shared = tokens.join(sizes.where("low <> high").select("token", "size"), "token").distinct()
    shared = written(shared.join(classes, ["cls", "n"]).select("token", "rep", "n", "at", "size"), "shared")
    weights = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    shared = written(shared.drop("size").join(weights, "rep"), "weighed")

    # each set with the most central leader of its shingles
    central = F.max(F.struct(F.col("weight"), F.col("rep"), F.col("n").alias("nl"), F.col("at").alias("atl"))).alias("lead")
    led = shared.join(shared.groupBy("token").agg(central).select("token", "lead.*").toDF("token", "weight_l", "rep_l", "nl", "atl"), "token")
    star = (
        led.withColumnsRenamed({"n": "nx", "at": "atx"})
        .where((F.col("rep") != F.col("rep_l")) & _may_link("x", "l", percent))
        .groupBy("rep")
        .agg(F.max(F.struct("weight_l", "rep_l"))["rep_l"].alias("rep_l"))
    )
    links = verified(written(_ordered(star), "pairs"), docs, words, percent, kind)
    # then with the most central member of each shingle's largest component
    found = written(components(links), "found")
    placed, main = _placed(shared, found)
    heads = (
        placed.join(main, "token")
        .where("top = main")
        .groupBy("token", "main")
        .agg(central)
        .select("token", "main", "lead.*")
        .toDF("token", "main", "weight_l", "rep_l", "nl", "atl")
    )
    near = (
        placed.join(heads, "token")
        .where("top <> main")
        .withColumnsRenamed({"n": "nx", "at": "atx"})
        .where(_may_link("x", "l", percent))
        .groupBy("rep", "main")
        .agg(F.max(F.struct("weight_l", "rep_l"))["rep_l"].alias("rep_l"))
    )
    found = written(components(verified(written(_ordered(near), "pairs"), docs, words, percent, kind), known=found), "found")

    # pairs of different components: one of them lies outside the shingle's largest component
    placed, main = _placed(shared, found)
    outside = placed.join(main, "token").where("top <> main").select("token", *(F.col(c).alias(f"{c}x") for c in ("rep", "n", "at", "top")))
    rest = (
        outside.join(placed.select("token", *(F.col(c).alias(f"{c}y") for c in ("rep", "n", "at", "top"))), "token")
        .where(F.col("topx") != F.col("topy"))
        .where(_may_link("x", "y", percent))
        .select(F.col("repx").alias("rep"), F.col("repy").alias("rep_l"))
    )
    more = verified(written(_ordered(rest), "pairs"), docs, words, percent, kind)
    found = components(more, known=found)

    shown = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "n", F.coalesce("root", "rep").alias("component_id"))
    linked = members.join(shown, ["cls", "n"], "left")
    return linked.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
