"""Language-model scores (6): stupid backoff, with n-gram counts of the whole corpus.

Documents are packed into blocks of words. A block sends each of its distinct n-grams once, with its count, to
the hash bucket that owns the n-gram; buckets hold the corpus-wide counts. The counts go back to the blocks
that asked, where they are joined with the block's exploded n-grams and summed for each document. A frequent
n-gram costs one entry for each block, whatever its count; buckets grow in number, not in size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweir.llm.common import WORD_HASHES, arrow_schema, mix, text_bytes, written

ORDER = 3
BACKOFF = 0.4
BLOCK_WORDS = 1_500_000  # a longer document is a block alone
BUCKET_ENTRIES = 1_500_000  # distinct n-grams that a bucket is meant to own
MIN_COUNT = 2  # rarer n-grams of two words and more are not in the model
KEY_BYTES = 5  # of a hash inside its bucket
_LOW = np.uint64((1 << 8 * KEY_BYTES) - 1)
_ONE = np.uint64(1)


def pack_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """block, n_words and packed arrays: ids and word counts of documents, vocabulary hashes, word numbers."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"block bigint, n_words bigint, doc_ids array<{kind}>, lengths binary, words binary, places binary"
    fields = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, parts, total = [], [], 0

        def block():
            nonlocal ids, parts, total, made
            words, places, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            # frequent words get small numbers; words about as frequent are sorted by their hashes
            by = np.argsort(-np.frexp(counts)[1], kind="stable")
            number = np.empty(len(by), np.int64)
            number[by] = np.arange(len(by))
            columns = [[(part << 32) + made], [total], [ids], [np.array(list(map(len, parts)), "<u4").tobytes()], [_packed(words[by], 8, True)], [_packed(number[places] if total else number, 4)]]
            made, ids, parts, total = made + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
                h = WORD_HASHES((text or b"").lower().split())
                if total and total + len(h) > BLOCK_WORDS:
                    yield block()
                ids.append(key)
                parts.append(h)
                total += len(h)
        if ids:
            yield block()

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def _ngrams(row, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each word; 0 where the document has no such one."""
    places = _whole(row["places"], 4).astype(np.int64)
    h = _whole(row["words"], 8, True)[places]
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    at = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # place inside the document
    out, chain = [], None
    for n in range(1, order + 1):
        if chain is None:
            chain = mix(h + _ONE)
        else:  # hash of the shorter n-gram one word earlier, then this word
            chain = mix(np.concatenate((np.zeros(1, np.uint64), chain[:-1])) * np.uint64(0x9E3779B97F4A7C15) + h) if len(h) else chain
        out.append(np.where(at >= n - 1, chain | _ONE, np.uint64(0)))
    return out


def _asked(row, order: int, buckets: int, numbers: bool):
    """Of each order: the distinct hashes sorted by bucket and low bits, their counts and the buckets' ends; with
    `numbers` also the number of each word's n-gram among them (-1 for none)."""
    for h in _ngrams(row, order):
        if numbers:
            keys, back, counts = np.unique(h, return_inverse=True, return_counts=True)
        else:
            keys, counts = np.unique(h, return_counts=True)
        owner = (keys >> np.uint64(40)).astype(np.int64) % buckets
        owner[keys == 0] = -1
        by = np.lexsort((keys & _LOW, owner))
        none = int((owner == -1).sum())
        rank = None
        if numbers:
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by)) - none
            rank = rank[back] if len(back) else back
        by = by[none:]
        yield keys[by], counts[by], np.searchsorted(owner[by], np.arange(buckets + 1)), rank


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    backoff: float = BACKOFF,
    min_count: int = MIN_COUNT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_words, log10_score (sum over the words) and score (its mean) of every row.

    Words are what white space separates, A-Z in lower case. S(w | context) is count(context w) / count(context)
    if the corpus has the n-gram at least `min_count` times, else `backoff` times S(w | shorter context); a single
    word has count(w) / words of the corpus. An own occurrence counts, so there is no zero. A null or empty text
    has 0 words, sum 0 and no mean; repeated rows count and are scored one by one; a null id stays null; other
    columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    blocks = written(pack_blocks(docs, id_column, text_column), "blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-total * order // BUCKET_ENTRIES))

    def ask(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                for n, (keys, counts, ends, _) in enumerate(_asked(row, order, buckets, False), 1):
                    low = keys & _LOW
                    pieces = [(b, n, row["block"], _packed(low[x:y], KEY_BYTES, True), _packed(counts[x:y], 4)) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x]
                    yield pd.DataFrame(pieces, columns=["bucket", "n", "block", "keys", "counts"])

    def answer(frame):
        keys = [_whole(k, KEY_BYTES, True) for k in frame["keys"]]
        counts = [_whole(c, 4) for c in frame["counts"]]
        out = [b""] * len(keys)
        for n in frame["n"].unique():
            mine = np.flatnonzero(frame["n"].to_numpy() == n)
            flat = np.concatenate([keys[i] for i in mine])
            _, back = np.unique(flat, return_inverse=True)
            sums = np.bincount(back, np.concatenate([counts[i] for i in mine]))[back].astype("<u8")
            ends = np.cumsum([len(keys[i]) for i in mine])
            for i, s in zip(mine, np.split(sums, ends[:-1]), strict=True):
                out[i] = _packed(s, 8)
        return pd.DataFrame({"block": frame["block"], "n": frame["n"], "bucket": frame["bucket"], "sums": out})

    def score(_, block, replies):
        rows = []
        answers = {(n, b): s for n, b, s in zip(replies["n"], replies["bucket"], replies["sums"], strict=True)}
        for row in block.to_dict("records"):
            lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
            ends = np.cumsum(lengths)
            logs = np.zeros(int(lengths.sum()))
            shorter = None
            for n, (keys, _, _, back) in enumerate(_asked(row, order, buckets, True), 1):
                sums = [_whole(answers[(n, b)], 8) for b in range(buckets) if (n, b) in answers]
                sums = np.append(np.concatenate(sums) if sums else np.zeros(0), 1).astype(float)
                count = np.where(back >= 0, sums[back], 0.0)
                if n == 1:
                    logs = np.log10(np.maximum(count, 1) / max(total, 1))
                else:
                    context = np.concatenate(([1.0], shorter[:-1]))
                    seen = count >= min_count
                    # without enough words before it there is no longer n-gram to back off from
                    logs = np.where(seen, np.log10(np.maximum(count, 1) / np.maximum(context, 1)), np.where(back >= 0, logs + np.log10(backoff), logs))
                shorter = count
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            rows.append(pd.DataFrame({"doc_id": list(row["doc_ids"]), "n_words": lengths, "log10_score": sums[ends] - sums[ends - lengths]}))
        return pd.concat(rows) if rows else pd.DataFrame({"doc_id": [], "n_words": [], "log10_score": []})

    requests = blocks.mapInPandas(ask, "bucket bigint, n int, block bigint, keys binary, counts binary")
    replies = requests.groupBy("bucket").applyInPandas(answer, "block bigint, n int, bucket bigint, sums binary")
    scored = (
        blocks.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInPandas(score, f"doc_id {kind}, n_words bigint, log10_score double")
    )
    return scored.withColumn("score", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))


def _packed(values: np.ndarray, width: int, rising: bool = False) -> bytes:
    """Whole numbers as compressed planes of their bytes, so that empty high bytes cost nothing; rising ones by
    their differences."""
    v = values.astype("<u8")
    if rising and len(v):
        v = np.diff(v, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _whole(raw: bytes, width: int, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    v = full.reshape(-1).view("<u8")
    return np.cumsum(v, dtype=np.uint64) if rising else v
