"""MinHash near-duplicates (13) with SuperMinHash signatures, banding, verification and grouping by components.

Every shingle of a set draws a random order of the signature's slots and gives its j-th slot the rank j plus a
fraction; a slot keeps the smallest rank that any shingle gives it. Ranks of one shingle are a permutation, so slots
are correlated and the estimate varies less than with independent hashes. Once all slots have a rank up to j, later
ranks cannot change any: a large set stops after a few.

* BANDS bands of ROWS slots are keys. Sets of similarity s share a key but for (1 - s**ROWS)**BANDS: 3 in a million at
  0.8, one in 10 million million at 0.9.
* Equal sets are one class. Keys that only one class has are dropped. Nothing is paired with all others of its key:
  each class is compared with the most central one of its keys, links become components, and classes outside the
  largest component of a key are compared with its most central member, the head.
* What is left after that is found by edits: the shingles in which a class differs from the head. Of two classes that
  are similar while one is not similar to the head, both must have made some of the same edits, and how many follows
  from their sizes. So prefixes of the edits are joined, rare ones first, with the usual bounds by place. Near copies
  of one text that differ from it in their own ways share too few edits to meet, however many.
* Pairs whose signatures agree in fewer than LEAST_EQUAL slots are dropped (at 0.8 more than 6 standard deviations
  below the mean). All others are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinweir.llm.common import WORD_HASHES, arrow_schema, bit_map, bit_test, cell, groups, in_batches, mix, release, shingle_hashes, text_bytes, written
from coinweir.llm.components import components

WORDS, PERCENT = 4, 80
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
LEAST_EQUAL = 96 / 160  # share of equal slots below which no pair of similarity 0.8 is to be expected
ELEMENTS = 1 << 16  # shingles that draw their slots together
_STEP, _BAND = 0x9E3779B97F4A7C15, np.uint64(0xA24BAED4963EE407)
_LOW = np.uint64(0xFFFFFFFF)


def word_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than `n` are one shingle, no words none."""
    words = text.lower().split() if text else []  # bytes: A-Z to lower case, ASCII white space separates
    return np.unique(shingle_hashes(WORD_HASHES(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def _draws(tokens: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """For every token its j-th rank (j and a fraction, as 32.32 bits) and a place from j on."""
    u = mix(tokens + np.uint64((j + 1) * _STEP & (1 << 64) - 1))
    return np.uint64(j << 32) | (u >> np.uint64(32)), np.uint64(j) + ((u & _LOW) * np.uint64(SLOTS - j) >> np.uint64(32))


def _lower(signs: np.ndarray, tokens: np.ndarray, owner: np.ndarray) -> None:
    """Lower the signatures `signs` (one row for each owner) by the ranks of the owners' tokens."""
    flat = signs.reshape(-1)
    rank, slot = _draws(tokens, 0)
    np.minimum.at(flat, owner * SLOTS + slot.astype(np.int64), rank)
    open_ = signs.max(axis=1) >> np.uint64(32) >= 1
    go = open_[owner]
    tokens, owner, slot = tokens[go], owner[go], slot[go].astype(np.int64)
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(tokens), 1))
    row = np.arange(len(tokens))
    order[row, slot] = 0
    for j in range(1, SLOTS):
        if not len(tokens):
            return
        rank, place = _draws(tokens, j)
        place = place.astype(np.int64)
        slot = order[row, place]
        order[row, place] = order[row, j]  # what stood at j may still be drawn; places before j are never looked at again
        np.minimum.at(flat, owner * SLOTS + slot, rank)
        if j % 4 == 3:
            go = (signs.max(axis=1) >> np.uint64(32) > j)[owner]
            if not go.all():
                tokens, owner, order = tokens[go], owner[go], order[go]
                row = np.arange(len(tokens))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures of the sets, SLOTS numbers each; those of empty sets are never lowered."""
    signs = np.full((len(sets), SLOTS), ~np.uint64(0))
    for a, b in groups([len(s) for s in sets], ELEMENTS):
        tokens, owner = np.concatenate(sets[a:b]), np.repeat(np.arange(a, b), [len(s) for s in sets[a:b]])
        for k in range(0, len(tokens), ELEMENTS):  # a signature is lowered by one part of a long set after the other
            mine = owner[k : k + ELEMENTS]
            if len(mine):
                _lower(signs[mine[0] : mine[-1] + 1], tokens[k : k + ELEMENTS], mine - mine[0])
    return signs


def _keys(signs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    rows = signs.reshape(len(signs), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _BAND, rows.shape[:2])
    for k in range(ROWS):
        out = mix(out * np.uint64(_STEP) + rows[:, :, k])
    return out


def signed(docs: DataFrame, n: int, kind: str) -> DataFrame:
    """Written rows doc_id, cls, n of all documents; cls, a fingerprint, and n name a set, empty ones have none.

    The first row of a class in a task also has the keys of its bands and its sketch, 16 bits of each slot.
    """

    def step(batch, met={}):  # noqa: B006  classes of this task whose keys are sent
        from xxhash import xxh3_64_intdigest

        task = TaskContext.get().taskAttemptId()
        if task not in met:
            met.clear()
            met[task] = set()
        seen, raw = met[task], text_bytes(batch)
        for a, b in groups([len(t or b"") for t in raw]):
            sets = [word_set(t, n) for t in raw[a:b]]
            names = [xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            new = [i for i, (s, name) in enumerate(zip(sets, names, strict=True)) if len(s) and (name, len(s)) not in seen and not seen.add((name, len(s)))]
            signs = signatures([sets[i] for i in new])
            keys, sketch = [None] * len(sets), [None] * len(sets)
            for i, row, sign in zip(new, _keys(signs).view(np.int64), signs, strict=True):
                keys[i], sketch[i] = row.tolist(), mix(sign).astype(np.uint16).tobytes()
            yield {"doc_id": batch.column(0).slice(a, b - a), "cls": names, "n": [len(s) for s in sets], "keys": keys, "sketch": sketch}

    return written(in_batches(docs, step, f"doc_id {kind}, cls bigint, n int, keys array<bigint>, sketch binary"), "signed")


def _sets_of(docs: DataFrame, ids: DataFrame, n: int, kind: str) -> DataFrame:
    """rep and packed sorted shingle hashes of the documents with these ids, written; texts of others are not split."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(ids.select(cell(F.col("rep")).alias("c")), "c"))

    def step(batch):
        wanted = np.flatnonzero(bit_test(np.frombuffer(shared.value, np.uint8), batch.column(2).to_numpy().astype(np.int64)))
        raw = text_bytes(batch)
        for a, b in groups([len(raw[i] or b"") for i in wanted]):
            rows = wanted[a:b]
            yield {"rep": batch.column(0).take(pa.array(rows)), "tokens": [word_set(raw[i], n).tobytes() for i in rows]}

    chosen = docs.where("doc_id IS NOT NULL").withColumn("place", cell(F.col("doc_id")))
    found = in_batches(chosen, step, f"rep {kind}, tokens binary").join(ids, "rep", "left_semi")
    return written(found.where("length(tokens) > 0"), "sets")


def _keep(pairs: DataFrame, good, columns: str) -> DataFrame:
    """a and b of the pairs that are `good` by the arrays in their two last columns."""
    fields = arrow_schema(pairs.sparkSession, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i) for i in (2, 3))
            kept = pa.array([good(p.as_buffer(), q.as_buffer()) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(kept) for i in (0, 1)], schema=fields)
        release()

    return pairs.mapInArrow(run, columns)


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Written pairs a, b whose signatures agree often enough and whose full sets are similar enough."""

    def alike(p, q) -> bool:
        return (np.frombuffer(p, np.uint16) == np.frombuffer(q, np.uint16)).sum() >= LEAST_EQUAL * SLOTS

    def similar(p, q) -> bool:
        x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def joined(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
        of = lambda end: table.select(F.col("rep").alias(end), F.col(column).alias(f"{column}_{end}"))
        return rows.join(of("a"), "a").join(of("b"), "b").select("a", "b", f"{column}_a", f"{column}_b")

    columns = f"a {kind}, b {kind}"
    near = written(_keep(joined(pairs, sketches, "sketch"), alike, columns), "alike")
    return written(_keep(joined(near, sets, "tokens"), similar, columns).distinct(), "links")


def shared_edits(members: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """rep and other of members of different components that can be similar by their edits.

    members: distinct lead, rep, top and main, the component of the lead; those with another top are not similar to
    it. With E the edits of a class and n its size, |E & E'| >= (|E| + |E'| - g (n + n')) / 2 for similar ones, where
    g = (100 - percent) / (100 + percent). |E| - g n is at least - g m for a lead of size m, and more than g m for a
    class that is not similar to the lead: that bounds the number of common edits from below for each class alone.
    """
    columns = f"lead {kind}, token bigint, rep {kind}, top {kind}, e int, n int, first int, inside boolean"
    fields = arrow_schema(members.sparkSession, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, rows = [], []
            for i, (x, h, inside) in enumerate(zip(batch.column(3), batch.column(4), batch.column(5).to_pylist(), strict=True)):
                x, h = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64)
                tokens = np.setxor1d(x, h, assume_unique=True)
                common = (100 + percent) * len(tokens) - (100 - percent) * (len(x) - len(h) if inside else len(x) + len(h))
                first = len(tokens) - max(1, -(-common // (2 * (100 + percent)))) + 1
                if first > 0:
                    made.append(tokens.view(np.int64))
                    rows.append((i, len(tokens), len(x), first))
            if rows:
                back = pa.array(np.repeat([r[0] for r in rows], [len(tokens) for tokens in made]))
                numbers = [pa.array(np.array([r[k] for r in rows], np.int32)) for k in (1, 2, 3)]
                again = pa.array(np.repeat(np.arange(len(rows)), [len(tokens) for tokens in made]))
                arrays = [batch.column(0).take(back), pa.array(np.concatenate(made)), *(batch.column(k).take(back) for k in (1, 2)), *(v.take(again) for v in numbers), batch.column(5).take(back)]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)
        release()

    of = lambda end: sets.select(F.col("rep").alias(end), F.col("tokens").alias(f"of_{end}"))
    several = members.groupBy("lead").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("lead")
    joined = members.join(several, "lead").join(of("rep"), "rep").join(of("lead"), "lead")
    inside = (F.col("top") == F.col("main")).alias("inside")
    edits = written(joined.select("lead", "rep", "top", "of_rep", "of_lead", inside).mapInArrow(run, columns), "edits")
    made = edits.groupBy("lead", "token").agg(F.count(F.lit(1)).alias("made"), (F.min("top") < F.max("top")).alias("shared"))
    place = Window.partitionBy("lead", "rep", "top").orderBy("made", "token")
    edits = edits.join(made, ["lead", "token"]).withColumn("at", F.row_number().over(place) - 1).where("shared AND at < first")
    edits = written(edits.drop("made", "shared", "first"), "edits")
    other = edits.where("NOT inside").select("lead", "token", *(F.col(c).alias(f"{c}_o") for c in ("rep", "top", "at", "e", "n")))
    n, n_o = F.col("n").cast("bigint"), F.col("n_o").cast("bigint")
    follow = F.least(F.col("e") - F.col("at"), F.col("e_o") - F.col("at_o")).cast("bigint") * (2 * (100 + percent))
    bound = follow >= (F.col("e") + F.col("e_o")) * F.lit(100 + percent).cast("bigint") - (n + n_o) * (100 - percent)
    length = F.least(n, n_o) * 100 >= F.greatest(n, n_o) * percent
    return edits.join(other, ["lead", "token"]).where(F.col("top") != F.col("top_o")).where(length & bound).select("rep", F.col("rep_o").alias("other"))


def _pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    ends = rows.where(F.col(left) != F.col(right))
    return written(ends.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct(), "pairs")


def _placed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of keys that several components have, with the component (top), and each such key's largest one (main)."""
    placed = written(shared.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("top", F.coalesce("root", "rep")).drop("root"), "placed")
    sizes = placed.groupBy("key", "top").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "top"))["top"].alias("main"), F.count(F.lit(1)).alias("tops"))
    return written(placed.join(main.where("tops > 1").select("key", "main"), "key"), "placed")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept of every row.

    Two rows link if 100 * |intersection| >= percent * |union| of their sets of `words`-word shingles. A null, empty
    or blank text has an empty set, links with nothing and is its own component. Rows that repeat an id and its text
    give equal rows; an id with several texts stands for all of them. A row without an id takes part in no group: its
    component is null and it is not kept. Other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    made = signed(docs, words, kind)
    members = made.select("doc_id", "cls", "n")
    classes = written(members.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls", "n").agg(F.min("doc_id").alias("rep")), "classes")

    # keys that only one class has can link nothing
    keyed = made.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "cls", "n")
    several = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("key")
    shared = written(keyed.join(several, "key").join(classes, ["cls", "n"]).select("key", "rep").distinct(), "shared")
    weights = shared.join(shared.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key").groupBy("rep").agg(F.sum("size").alias("weight"))
    weights = written(weights, "weights")
    shared = written(shared.join(weights, "rep"), "weighed")
    chosen = classes.join(weights, "rep", "left_semi")
    sketches = written(made.where("sketch IS NOT NULL").join(chosen, ["cls", "n"]).select("rep", "sketch").dropDuplicates(["rep"]), "sketches")
    sets = _sets_of(docs, weights.select("rep"), words, kind)
    check = lambda pairs: confirmed(pairs, sketches, sets, percent, kind)

    # each class with the most central one of its keys
    central = F.max(F.struct("weight", "rep")).alias("lead")
    heads = shared.groupBy("key").agg(central).select("key", F.col("lead.weight").alias("lead_weight"), F.col("lead.rep").alias("lead"))
    first = shared.join(heads, "key").groupBy("rep").agg(F.max(F.struct("lead_weight", "lead"))["lead"].alias("lead"))
    found = written(components(check(_pairs(first, "rep", "lead"))), "found")

    # classes outside the largest component of a key with its most central member
    placed = _placed(shared, found)
    heads = placed.where("top = main").groupBy("key").agg(central).select("key", F.col("lead.rep").alias("lead"))
    near = placed.where("top <> main").join(heads, "key")
    found = written(components(check(_pairs(near, "rep", "lead")), known=found), "found")

    # members of a key that are in different components still, one of them not similar to the head
    placed = _placed(shared, found)
    heads = placed.where("top = main").groupBy("key").agg(central).select("key", F.col("lead.rep").alias("lead"))
    around = placed.join(heads, "key").where("rep <> lead").select("lead", "rep", "top", "main").distinct()
    around = written(around, "around")
    rest = shared_edits(around, sets, percent, kind).unionByName(around.where("top <> main").select("rep", F.col("lead").alias("other")))
    found = components(check(_pairs(rest, "rep", "other")), known=found)

    shown = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "n", F.coalesce("root", "rep").alias("component_id"))
    # rows without a set have no class to meet; they are left out of the join
    linked = members.where("cls IS NOT NULL").join(shown, ["cls", "n"], "left")
    rows = linked.select("doc_id", "n", "component_id").unionByName(
        members.where("cls IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
