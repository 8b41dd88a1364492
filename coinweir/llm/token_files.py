"""Token ids in ORC files (3).

One row holds a document's ids. The ORC writer stores integers run-length encoded, keeps minima and maxima of
every stripe and row group in its indexes and a Bloom filter of the document ids. Files follow each other in
document order, so a reader takes stripes in parallel and skips those that cannot hold a wanted id.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coinweir.llm.common import CHUNK, LETTERS, SPACE, groups, in_batches, text_bytes

CACHE_LIMIT = 900_000  # chunks whose ids a worker remembers
JOINED = 200  # chunks that the library gets as one text
STRIPE_BYTES = 16 << 20
ROWS_PER_INDEX = 5_000
# a mark that does not stand behind a letter or digit, white space but for single spaces and line feeds, or a zero
_UNEVEN_MARK = re.compile(f"[,.!?;:](?<![0-9{LETTERS}].)")
_UNEVEN_SPACE = re.compile("[" + SPACE.replace(r"\t-\r ", r"\t\x0b-\r") + "\0]")


class Numbers(dict):
    """A number for each chunk, in the order in which they are met; `new` holds those whose ids are not known yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        number = self[chunk] = len(self)
        return number


class ChunkEncoder:
    """The tokenizers library, asked once for each distinct chunk.

    The byte-level pattern never joins text with white space behind it, so the ids of a text are those of its
    chunks (white space and what follows it), one after the other. A text with the string of a special token
    goes to the library whole, and so does every text if the file is of another kind.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = cuts_at_space(json.loads(self.tokenizer.to_str()))
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token
        for token, number in vocab.items():
            self.width[number] = len(token)  # a byte-level token has one letter for each byte
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.ids = np.zeros(1 << 16, "<u4")  # of all numbered chunks, one behind the other
        self.starts = np.zeros(1 << 14, np.int64)  # place of each one's first id, and at `learned` the end of the last
        self.learned = 0

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Many go to the library in one text, whose ids are cut where the chunks end.

        Only chunks that begin with a space and end in text are put together: there every match ends where its
        chunk ends. Chunks with marks of special tokens go in alone, as joined they could make one.
        """
        joins = [c[0] == " " and not (c.isspace() or "<" in c or ">" in c or "|" in c) for c in chunks]
        alone = iter(self.library([c for c, j in zip(chunks, joins, strict=True) if not j]))
        rest = [c for c, j in zip(chunks, joins, strict=True) if j]
        parts = [rest[k : k + JOINED] for k in range(0, len(rest), JOINED)]
        cut: list[bytes] = []
        for part, raw in zip(parts, self.library(["".join(p) for p in parts]), strict=True):
            ends = np.searchsorted(np.cumsum(self.width[np.frombuffer(raw, "<u4")]), np.cumsum([len(c.encode()) for c in part])) + 1
            ends = (ends * 4).tolist()
            cut += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        joined = iter(cut)
        return [next(joined) if j else next(alone) for j in joins]

    def learn(self) -> None:
        """Take up the ids of the new chunks."""
        found = self.ids_of(self.numbers.new)
        self.numbers.new.clear()
        flat = np.frombuffer(b"".join(found), "<u4")
        ends = self.starts[self.learned] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        self.ids = _room(self.ids, int(self.starts[self.learned]), len(flat))
        self.ids[self.starts[self.learned] : self.starts[self.learned] + len(flat)] = flat
        self.starts = _room(self.starts, self.learned + 1, len(ends))
        self.starts[self.learned + 1 : self.learned + 1 + len(ends)] = ends
        self.learned += len(ends)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [not self.cuts or any(s in t for s in self.specials) for t in texts]
        if len(self.numbers) > CACHE_LIMIT:
            self.forget()
        number, numbered = self.numbers.__getitem__, []
        for text, w in zip(texts, whole, strict=True):
            chunks = [] if w else chunks_of(text)
            numbered.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        if self.numbers.new:
            self.learn()
        return [self.library([t])[0] if w else self.joined(n) for t, w, n in zip(texts, whole, numbered, strict=True)]

    def joined(self, numbers: np.ndarray) -> bytes:
        """Ids of these chunks, one behind the other."""
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(starts - before, sizes) + np.arange(sizes.sum())].tobytes()


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """`values` with place for `more` behind the `used` ones."""
    if used + more <= len(values):
        return values
    wider = np.zeros(max(used + more, len(values) * 3 // 2), values.dtype)
    wider[:used] = values[:used]
    return wider


def cuts_at_space(spec: dict) -> bool:
    """Whether a tokenizers file is of the kind whose texts may be encoded chunk by chunk: byte-level pairs with the
    usual pattern, nothing normalised or put in front, no marks in words, nothing left to chance."""
    model, pieces = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    byte_level = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space")
    return bool(model["type"] == "BPE" and plain and byte_level and spec["normalizer"] is None)


def chunks_of(text: str) -> list[str]:
    """Chunks of a text; joined they are the text. CHUNK cuts any text; an even one is cut in the same sense by
    str.split: ahead of each space and line feed, and of each mark, which there has a letter or digit before it."""
    doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    if doubled or _UNEVEN_MARK.search(text) or _UNEVEN_SPACE.search(text):
        return CHUNK.findall(text)
    for mark in " \n,.!?;:":
        text = text.replace(mark, "\0" + mark)
    chunks = text.split("\0")
    return chunks if chunks[0] else chunks[1:]


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encode every text, append `end_id` and write ORC files in ascending id order to `folder`.

    Columns: doc_id, part (number of the file's range), part_start (ids of the range before the document),
    n_tokens, ids. A null or empty text is `end_id` alone; a null id comes first; repeated rows stay, ordered
    among themselves by their text; other columns are not read. An empty table gives no row.
    """

    def step(batch, seen={}):  # noqa: B006  ids of this task so far
        part = TaskContext.get().partitionId()
        raw = [b or b"" for b in text_bytes(batch)]
        model, task = encoder(path), TaskContext.get().taskAttemptId()
        end = np.array([end_id], "<u4").tobytes()
        for a, b in groups([len(t) for t in raw]):
            ids = [i + end for i in model.encode([t.decode("utf-8", "replace") for t in raw[a:b]])]
            sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
            ends = np.cumsum(sizes)
            before = seen.get(task, 0)
            seen.clear()
            seen[task] = before + int(ends[-1])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            yield {
                "doc_id": batch.column(0).slice(a, b - a),
                "part": [part] * len(ids),
                "part_start": before + ends - sizes,
                "n_tokens": sizes,
                "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat)),
            }

    kind = docs.schema[id_column].dataType.simpleString()
    ordered = (
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        .repartitionByRange("doc_id", F.crc32("text"))
        .sortWithinPartitions("doc_id", F.crc32("text"), "text")
    )
    (
        in_batches(ordered, step, f"doc_id {kind}, part int, part_start bigint, n_tokens bigint, ids array<int>")
        .write.option("compression", "lz4")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids. Filters on doc_id reach the files' indexes."""
    rows = spark.read.orc(folder)
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row for each range, so no more than there were tasks
        spark.read.orc(folder)
        .groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "ids")


def with_checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def step(batch):
        ids = batch.column(2)
        ends = ids.offsets.to_numpy()
        raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        yield {
            "doc_id": batch.column(0),
            "start": batch.column(1),
            "n_tokens": np.diff(ends),
            "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
        }

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows.select("doc_id", "start", "ids"), step, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
