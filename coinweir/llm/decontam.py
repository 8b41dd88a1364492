"""Benchmark decontamination (8): a prefix-filtered set join of item windows with documents.

Every window of an item is a set of shingles. All of them must occur in a document that holds the window, so one
is enough to look for: the rarest, counted over all documents. Only places where a document has a wanted shingle
are joined; length and position bounds drop windows that would begin before or end behind the document; what is
left is compared word by word over a window of the item's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweir.llm.common import FILTER_BITS, WORD_HASHES, bit_map, bit_test, in_batches, shingle_hashes, text_bytes, written

WINDOW = 10
SHINGLE = 3
_CELLS = np.uint64((1 << FILTER_BITS) - 1)
# letters and digits stay, A-Z in lower case, other ASCII separates words, what is not ASCII stays
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def item_windows(items: DataFrame, window: int, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """item_id, words (array), size, width (words of a shingle) and keys (a hash for each shingle) of every
    window; an item of fewer words is one window, one without words none."""

    def step(batch):
        made = {k: [] for k in ("item_id", "words", "width", "keys")}
        for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
            words = words_of(text)
            size = min(window, len(words))
            width = min(shingle, size)
            keys = shingle_hashes(WORD_HASHES(words), width).view(np.int64).tolist() if words else []
            for a in range(len(words) - size + 1 if words else 0):
                made["item_id"].append(item)
                made["words"].append([w.decode("utf-8", "replace") for w in words[a : a + size]])
                made["width"].append(width)
                made["keys"].append(keys[a : a + size - width + 1])
        yield made

    return in_batches(
        items.select(F.col(id_column).cast("string").alias("item_id"), F.col(text_column).alias("text")),
        step,
        "item_id string, words array<string>, width int, keys array<bigint>",
    )


def _wanted(docs: DataFrame, bits: bytes, widths: list[int], emit, schema: str, sizes: bool = False) -> DataFrame:
    """Run `emit` on every document's words and the places whose shingle may be wanted.

    With `sizes` there is also a row of width 0 for each document, with its number of words as `at`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2 MB, whatever the number of shingles

    def step(batch):
        table = np.frombuffer(shared.value, np.uint8)
        made: dict[str, list] = {}
        counts = np.zeros(batch.num_rows, np.int32)
        for row, text in enumerate(text_bytes(batch)):
            words = words_of(text)
            counts[row] = len(words)
            if words:
                h = WORD_HASHES(words)
                for width in widths:
                    keys = shingle_hashes(h, width)
                    at = np.flatnonzero(bit_test(table, (keys & _CELLS).astype(np.int64)))
                    if len(at):
                        emit(made, batch, row, words, width, keys[at].view(np.int64), at)
        if sizes:
            none = np.zeros(batch.num_rows, np.int32)
            yield {
                "doc_id": batch.column(0),
                "digest": batch.column(2),
                "width": none,
                "key": none,
                "at": counts,
                "first": none,
                "around": [[]] * batch.num_rows,
            }
        if made:
            yield {k: np.concatenate(v) if isinstance(v[0], np.ndarray) else v for k, v in made.items()}

    return in_batches(docs, step, schema)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a window's occurrence), spans (array of start, size) and items (sorted
    ids as strings of the items with an occurring window) of every row.

    Null, empty and wordless texts have 0 words and no hit; repeated rows of one id and text give equal rows;
    rows of one id with different texts are kept apart by their text; a null id is kept; without items nothing is
    hit. Other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    windows = written(item_windows(items, window, shingle, item_column, item_text), "windows")
    keys = windows.select("width", F.explode("keys").alias("key")).distinct()
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # `shingle` values at most
    place = F.expr(f"cast(key & {int(_CELLS)} as int)")

    # how often each of the items' shingles occurs in the documents
    def tally(made, batch, row, words, width, found, at):
        for name, values in (("width", np.full(len(found), width)), ("key", found)):
            made.setdefault(name, []).append(values)

    counted = _wanted(texts, bit_map(keys.select(place.alias("c")), "c"), widths, tally, "width int, key bigint")
    rarity = keys.join(counted.groupBy("width", "key").count(), ["width", "key"], "left").select("width", "key", F.coalesce("count", F.lit(0)).alias("n"))

    # the rarest shingle of each distinct window; ties go to the smaller hash
    shapes = windows.groupBy("words", "width", "keys").agg(F.collect_set("item_id").alias("item_ids"))
    shapes = shapes.withColumn("window", F.xxhash64(F.concat_ws(" ", "words")))
    prefix = (
        shapes.select("window", "width", F.posexplode("keys").alias("offset", "key"))
        .join(rarity, ["width", "key"])
        .groupBy("window", "width")
        .agg(F.min(F.struct("n", "key", "offset")).alias("p"))
        .where("p.n > 0")  # a shingle that no document has rules its window out
    )
    looked = written(
        prefix.select("window", "width", "p.key", "p.offset").join(shapes.select("window", "words"), "window"), "prefix"
    )

    def context(made, batch, row, words, width, found, at):
        text = [w.decode("utf-8", "replace") for w in words]
        reach = window - 1
        for name, values in (
            ("width", np.full(len(at), width)),
            ("key", found),
            ("at", at),
            ("first", np.maximum(at - reach, 0)),
        ):
            made.setdefault(name, []).append(values)
        made.setdefault("around", []).extend(text[max(a - reach, 0) : a + reach + width] for a in at.tolist())
        made.setdefault("doc_id", []).extend([batch.column(0)[row].as_py()] * len(at))
        made.setdefault("digest", []).extend([batch.column(2)[row].as_py()] * len(at))

    marked = texts.withColumn("digest", F.xxhash64("text"))
    places = _wanted(
        marked,
        bit_map(looked.select(place.alias("c")), "c"),
        widths,
        context,
        f"doc_id {kind}, digest bigint, width int, key bigint, at int, first int, around array<string>",
        sizes=True,
    )
    places = written(places, "places")
    start = F.col("at") - F.col("offset")
    hits = (
        places.where("width > 0")
        .join(looked, ["width", "key"])
        .where(start >= F.col("first"))  # position bound
        .where(start - F.col("first") + F.size("words") <= F.size("around"))  # length bound
        .where(F.slice("around", start - F.col("first") + 1, F.size("words")) == F.col("words"))
        .select("doc_id", "digest", start.alias("start"), F.size("words").alias("size"), "window")
        .distinct()
    )
    hits = written(hits, "hits")
    named = (
        hits.select("doc_id", "digest", "window")
        .distinct()
        .join(shapes.select("window", F.explode("item_ids").alias("item")), "window")
        .groupBy("doc_id", "digest")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    spans = hits.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(s["upto"], x["start"]))).alias("n"),
            F.greatest(s["upto"], x["start"] + x["size"]).alias("upto"),
        ),
        lambda s: s["n"],
    )
    found = spans.join(named.withColumnsRenamed({"doc_id": "d", "digest": "g"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest"), "spans", "items", covered.alias("n_hit"))

    sizes = places.where("width = 0").select("doc_id", "digest", F.col("at").cast("bigint").alias("n_words"))
    return sizes.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )

