"""Phrase collocations (12): phrase counts by a multikey three-way quicksort of suffixes.

* Words are counted first, by language.
* Every place in a piece is a suffix of at most MAX_WORDS words. Suffixes are routed by their leading word, and within
  a common word by the words behind it, so that no route outgrows the others; equal suffixes of a block of text travel
  as one with a weight. The number of routes of a word follows the size of the corpus. A bit map of fixed size ends
  suffixes before words that occur too seldom; what it lets through is only counted in vain.
* A task holds whole routes. It splits the pointers to its suffixes into those with a smaller, an equal and a larger
  word than a pivot, goes on behind the equal ones, and gives up a part as soon as it weighs less than the least count.
  What an equal part weighs is the count of the phrase that leads to it.
* Words above 1/HOT_SHARE of all are at most HOT_SHARE. Their routes are cut by all words behind, so only phrases of
  full length are whole in one; counts of shorter ones are added up before the least count is applied.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha1
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweir.llm.common import FILTER_BITS, GROUP_BYTES, arrow_schema, bit_map, bit_test, release, text_bytes, written

MAX_WORDS = 3
LEAST = 10
HOLD = 50  # percent of a phrase's count at which a longer one stands for it
FIRST = 2_000
HOT_SHARE = 1_000
ROUTE_WORDS = 1 << 20  # suffixes in a route, about
ROW_SUFFIXES = 1 << 12  # suffixes in a row, at most
COUNTED = 200_000  # words that a task counts before it sends them
HELD = 1 << 18  # suffixes that a task sorts at once, whole routes in any case
SPLIT = re.compile(rb"[.,;:!?\n-\r]+")  # pieces may be empty, so runs of marks split as one
END = (b"",)  # behind a piece
TABS = bytes.maketrans(b"\t", b" ")


def pieces(text: bytes) -> Iterator[list[list[bytes]]]:
    """Words of the pieces of a lower-cased text, in lists of about GROUP_BYTES; no piece is cut."""
    at = 0
    while at < len(text):
        mark = SPLIT.search(text, at + GROUP_BYTES) if len(text) > at + GROUP_BYTES else None
        end = mark.end() if mark else len(text)
        found = (p.split(b" ") for p in SPLIT.split(text[at:end].lower().translate(TABS)))
        yield [words for words in ([w for w in p if w] for p in found) if words]
        at = end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list[bytes]]]]:
    """(language, pieces) of blocks of text of one language; several short texts share a block."""
    held: dict[str, list[list[bytes]]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
            for found in pieces(text or b""):
                held.setdefault(lang, []).extend(found)
                size[lang] = size.get(lang, 0) + min(len(text), GROUP_BYTES)
                if size[lang] >= GROUP_BYTES:
                    yield lang, held.pop(lang)
                    del size[lang]
            if len(held) > 1 and sum(size.values()) >= 2 * GROUP_BYTES:  # many languages
                yield from held.items()
                held, size = {}, {}
    yield from held.items()


def word_counts(docs: DataFrame) -> DataFrame:
    """Written lang, word (binary) and n, its occurrences; a task adds up to COUNTED words before it sends them."""
    schema = "lang string, word binary, n bigint"
    fields = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), fields[0].type), pa.array(n.keys(), fields[1].type), pa.array(n.values(), pa.int64())], schema=fields)
            counts.clear()

        for lang, found in _blocks(batches):
            counts.setdefault(lang, Counter()).update(chain.from_iterable(found))
            if sum(map(len, counts.values())) > COUNTED:
                yield from sent()
        yield from sent()
        release()

    return written(docs.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def _cell(lang: Column, word: Column) -> Column:
    """Place of a word in the map of frequent ones, the same as `_places` gives it."""
    return F.shiftright(F.conv(F.substring(F.sha1(F.concat(lang.cast("binary"), F.lit(b"\0"), word)), 1, 8), 16, 10).cast("bigint"), 32 - FILTER_BITS).cast("int")


def _places(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode() + b"\0"
    return np.array([int.from_bytes(sha1(head + w).digest()[:4]) for w in words], np.int64) >> (32 - FILTER_BITS)


def suffixes(docs: DataFrame, frequent: bytes, hot: dict[tuple[str, bytes], int], parts: int, max_words: int) -> DataFrame:
    """lang, word, part and the packed suffixes behind the word: `followers`, max_words - 1 lines each, empty ones
    behind the end, and `weights`, 32-bit integers. `hot` words have that many parts, others `parts`.

    A suffix ends with its piece and before a word that is surely not in the bit map of `frequent` ones.
    """
    schema = "lang string, word binary, part int, followers binary, weights binary"
    fields = arrow_schema(docs.sparkSession, schema)
    shared = docs.sparkSession.sparkContext.broadcast((hot, frequent))
    width = max_words - 1

    def places(lang: str, found: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
        """The words of the pieces and, for each place that has a follower, the numbers of max_words words; 0 is none."""
        numbers: dict[bytes, int] = {b"": 0}
        flat = np.array([numbers.setdefault(w, len(numbers)) for words in found for w in chain(words, END)] + [0] * max_words, np.int64)
        names = list(numbers)
        usual = bit_test(np.frombuffer(shared.value[1], np.uint8), _places(lang, names))
        usual[0] = False
        flat *= usual[flat]
        at = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0))
        rows = np.stack([flat[at + k] for k in range(max_words)], axis=1)
        for k in range(2, max_words):
            rows[:, k] *= rows[:, k - 1] > 0  # nothing behind the end
        return names, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for lang, found in _blocks(batches):
            names, rows = places(lang, found)
            if not len(rows):
                continue
            rows, weights = distinct(rows, len(names))
            hot = shared.value[0]
            part = np.zeros(len(rows), np.int64)
            if hot or parts > 1:  # ordinary words by the second word, hot ones by all words behind
                hashes = np.array([xxh3_64_intdigest(w) for w in names], np.uint64)
                routes = np.array([hot.get((lang, w), parts) for w in names], np.uint64)
                common = np.array([(lang, w) in hot for w in names])[rows[:, 0]]
                behind = hashes[rows[:, 1]]
                for k in range(2, max_words):
                    behind = np.where(common, behind * np.uint64(0x9E3779B97F4A7C15) ^ hashes[rows[:, k]], behind)
                part = ((behind ^ (behind >> np.uint64(29))) % routes[rows[:, 0]]).astype(np.int64)
                order = np.lexsort((part, rows[:, 0]))  # stable: words behind stay in order
                rows, weights, part = rows[order], weights[order], part[order]
            ends = np.flatnonzero(np.concatenate(((rows[1:, 0] != rows[:-1, 0]) | (part[1:] != part[:-1]), [True]))) + 1
            behind = [names[i] for i in rows[:, 1:].ravel().tolist()]
            leading, part = rows[:, 0].tolist(), part.tolist()
            weights = weights.astype("<u4")
            made: tuple[list, ...] = ([], [], [], [])
            start = 0
            for end in ends.tolist():
                for k in range(start, end, ROW_SUFFIXES):
                    upto = min(end, k + ROW_SUFFIXES)
                    made[0].append(names[leading[k]])
                    made[1].append(part[k])
                    made[2].append(b"\n".join(behind[k * width : upto * width]))
                    made[3].append(weights[k:upto].tobytes())
                start = end
            arrays = [pa.array(v, f.type) for v, f in zip(([lang] * len(made[0]), *made), fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)
        release()

    return docs.mapInArrow(run, schema)


def distinct(rows: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of numbers below `names`, and how often each occurs."""
    width = rows.shape[1]
    if names**width < 1 << 62:
        scale = names ** np.arange(width - 1, -1, -1, dtype=np.int64)
        keys, weights = np.unique(rows @ scale, return_counts=True)
        return keys[:, None] // scale % names, weights
    return np.unique(rows, axis=0, return_counts=True)


def equal_parts(columns: list[np.ndarray], weights: np.ndarray, sizes: np.ndarray, least: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers, weights) of the prefixes in each part of the pointers that weigh enough for their depth.

    `columns` hold the symbols of each depth, 0 is the end; parts are neighbours of the given sizes. Multikey three-way
    quicksort, in which all open parts of a depth are split at once, each at its own pivot. Parts that weigh less than
    `least` of their depth are given up.
    """
    pointers = np.arange(len(weights))
    for depth, column in enumerate(columns):
        equals: list[tuple[np.ndarray, np.ndarray]] = []
        while len(pointers):
            starts = np.cumsum(sizes) - sizes
            enough = np.add.reduceat(weights[pointers], starts) >= least[depth]
            if not enough.all():
                pointers, sizes = pointers[np.repeat(enough, sizes)], sizes[enough]
                starts = np.cumsum(sizes) - sizes
                if not len(sizes):
                    break
            symbols = column[pointers]
            pivots = symbols[starts + (sizes >> 1)]
            part = np.repeat(np.arange(len(sizes)), sizes)
            pivot = pivots[part]
            less, more = symbols < pivot, symbols > pivot
            same = ~(less | more)
            equals.append((pointers[same & (pivot > 0)], np.bincount(part[same], minlength=len(sizes))[pivots > 0]))
            n_less, n_more = (np.bincount(part[side], minlength=len(sizes)) for side in (less, more))
            # the smaller ones of a part, then its larger ones
            rest = less | more
            symbols_first = np.where(less, 2 * part, 2 * part + 1)[rest]
            pointers = pointers[rest][_stable(symbols_first, n_less, n_more)]
            sizes = np.stack((n_less, n_more), axis=1).ravel()
            sizes = sizes[sizes > 0]
        if not equals:
            return
        pointers, sizes = (np.concatenate(found) for found in zip(*equals, strict=True))
        if not len(sizes):
            return
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(weights[pointers], starts)
        enough = total >= least[depth]
        yield depth, pointers[starts[enough]], total[enough]
        pointers, sizes = pointers[np.repeat(enough, sizes)], sizes[enough]


def _stable(sides: np.ndarray, n_less: np.ndarray, n_more: np.ndarray) -> np.ndarray:
    """Order that puts elements by their side (2 p smaller, 2 p + 1 larger ones of part p), else as they are."""
    starts = np.cumsum(np.stack((n_less, n_more), axis=1).ravel())
    larger = (sides & 1).astype(bool)
    out = np.empty(len(sides), np.int64)
    counts = np.stack((n_less, n_more), axis=1).ravel()
    starts -= counts
    for side in (False, True):
        mine = np.flatnonzero(larger == side)
        owner = sides[mine]
        first = np.cumsum(counts[side::2]) - counts[side::2]  # elements of this side before those of the part
        out[starts[owner] + np.arange(len(mine)) - first[owner >> 1]] = mine
    return out


def phrase_counts(routed: DataFrame, hot: dict[tuple[str, bytes], int], least: int, max_words: int) -> DataFrame:
    """lang, phrase (words joined by spaces, binary), words and a, its occurrences, for phrases of 2 words and more.

    `routed` is partitioned by lang, word and part and sorted by them; rows of a hot word are parts of a count.
    """
    schema = "lang string, phrase binary, words int, a bigint"
    fields = arrow_schema(routed.sparkSession, schema)
    shared = routed.sparkSession.sparkContext.broadcast(hot)
    width = max_words - 1

    def count(held: list[tuple[tuple, list[bytes], list[bytes]]]) -> Iterator[pa.RecordBatch]:
        words = b"\n".join(b"\n".join(f) for _, f, _ in held).split(b"\n")
        weights = np.frombuffer(b"".join(b"".join(w) for _, _, w in held), "<u4").astype(np.int64)
        numbers: dict[bytes, int] = {b"": 0}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32).reshape(-1, width)
        sizes = np.array([sum(map(len, w)) // 4 for _, _, w in held])
        common = np.array([key[:2] in shared.value for key, _, _ in held])
        route = np.repeat(np.arange(len(held)), sizes)
        made: tuple[list, ...] = ([], [], [], [])
        for is_hot in (False, True):
            mine = common[route] == is_hot
            places = np.flatnonzero(mine)
            columns = [ids[mine, k] for k in range(width)]
            for depth, found, totals in equal_parts(columns, weights[mine], sizes[common == is_hot], [1 if is_hot else least] * (width - 1) + [least]):
                for at, total in zip(places[found].tolist(), totals.tolist(), strict=True):
                    key = held[route[at]][0]
                    made[0].append(key[0])
                    made[1].append(b" ".join((key[1], *words[at * width : at * width + depth + 1])))
                    made[2].append(depth + 2)
                    made[3].append(total)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, list[bytes], list[bytes]]] = []
        size = mine = light = 0  # suffixes in whole routes, those of the last one, and what it weighs
        for batch in batches:
            for *key, followers, weights in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not held or held[-1][0] != tuple(key):
                    if held and light < least and held[-1][0][:2] not in shared.value:
                        held.pop()  # a route that weighs too little
                    else:
                        size += mine
                    if size >= HELD:
                        yield from count(held)
                        held, size = [], 0
                    held.append((tuple(key), [], []))
                    mine = light = 0
                held[-1][1].append(followers)
                held[-1][2].append(weights)
                mine += len(weights) // 4
                light += int(np.frombuffer(weights, "<u4").sum()) if light < least else 0
        if held:
            yield from count(held)
        release()

    found = routed.mapInArrow(run, schema)
    return found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _words(start: str, length: str) -> Column:
    """Some words of `phrase`, joined by spaces."""
    return F.expr(f"array_join(slice(split(phrase, ' '), {start}, {length}), ' ')")


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    hold: int = HOLD,
    first: int = FIRST,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language.

    Texts are split into pieces at `. , ; : ! ?` and line ends and these into words at blanks and tabs, A-Z in lower
    case. Phrases of 2 to `max_words` words with a >= `least` occurrences are candidates, scored by their worst cut:
    floor(1000000 a a / (l r)), l and r being the counts of the two parts; the first of equal cuts counts. A
    candidate inside a longer one with 100 f >= `hold` a is dropped. A null language is `und`, a null text empty;
    repeated rows count as often as they occur. No text gives no rows. Other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).alias("text"))
    words = word_counts(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    share = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_SHARE
    parts = 1 + share // ROUTE_WORDS
    above = words.where((F.col("n") > share) & (F.col("n") > ROUTE_WORDS)).collect()  # HOT_SHARE rows at most
    hot = {(r.lang, bytes(r.word)): 1 + r.n // ROUTE_WORDS for r in above}
    frequent = bit_map(words.where(F.col("n") >= least).select(_cell(F.col("lang"), F.col("word")).alias("c")), "c")
    routed = suffixes(docs, frequent, hot, parts, max_words).repartition("lang", "word", "part").sortWithinPartitions("lang", "word", "part")
    found = phrase_counts(routed, hot, least, max_words).withColumn("phrase", F.col("phrase").cast("string"))
    found = written(found, "phrases")

    # counts of all parts that a phrase can be cut into
    counts = found.select("lang", "phrase", "a").unionByName(words.select("lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("a")).where(F.col("a") >= least))
    cuts = found.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", _words("1", "k").alias("left"), _words("k + 1", "words - k").alias("right")
    )
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # a longer candidate holds those one word shorter; what holds a shorter one still does so with no smaller count
    inner = F.explode(F.array(_words("1", "words - 1"), _words("2", "words - 1"))).alias("phrase")
    longer = found.where("words > 2").select("lang", "a", inner)
    longest = longer.groupBy("lang", "phrase").agg(F.max("a").alias("f"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("f") < hold * F.col("a"), F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    columns = ["lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"]
    return ranked.join(totals, "lang").select(*columns)
