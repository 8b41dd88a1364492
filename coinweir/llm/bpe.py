"""Byte-level BPE encoding and decoding (2): corpus-level merge replay.

The distinct pre-tokens of a block of documents lie in one byte string. An inverted index leads from each
mergeable pair (named by the rank of what it makes) to the positions where it stands. Ranks are applied in
rising order; a merge looks only at its two neighbours and enters the pairs that they make into the index.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweir.llm.common import CHUNK, groups, in_batches, remembered, text_bytes, unknown

CACHE_LIMIT = 250_000  # chunks whose ids a worker remembers
BLOCK_BYTES = 1 << 20  # text whose new chunks are replayed together


def pair_ranks(ranks: dict[bytes, int]) -> np.ndarray:
    """Rank of each pair of bytes, -1 for none, by 256 * first + second."""
    found = np.full(1 << 16, -1, np.int32)
    for token, rank in ranks.items():
        if len(token) == 2:
            found[token[0] << 8 | token[1]] = rank
    return found


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: np.ndarray | None = None) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers. `pairs` are the `pair_ranks` of `ranks`."""
    flat = b"".join(words)
    if not flat:
        return [b""] * len(words)
    get = ranks.get
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    closes = np.cumsum(sizes, dtype=np.int32)
    here, stops = np.arange(len(flat), dtype=np.int32), np.repeat(closes, sizes)
    starts = np.repeat(closes - sizes, sizes)
    whole = np.repeat(np.fromiter((w in ranks for w in words), bool, len(words)), sizes)  # a word that is a token needs no merges
    end = np.where(whole, np.where(here == starts, stops, 0), here + 1).tolist()  # where the symbol that starts here ends; 0: no symbol starts here
    before = np.where(here == starts, -1, here - 1).tolist()  # start of the symbol to the left; -1 at a word's start
    stop = stops.tolist()  # end of the word
    raw = np.frombuffer(flat, np.uint8).astype(np.int32)
    first = (pair_ranks(ranks) if pairs is None else pairs)[raw[:-1] << 8 | raw[1:]]
    places = np.flatnonzero((first >= 0) & ~whole[:-1] & (here[1:] < stops[:-1]))
    places = places[np.argsort(first[places], kind="stable")]
    found, cuts = np.unique(first[places], return_index=True)
    index: dict[int, list[int]] = {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, cuts[1:]), strict=False)}
    del here, stops, starts, whole, raw, first, places
    length = {}
    heap = list(index)
    heapify(heap)
    while heap:
        rank = heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        wide = length.get(rank)
        wait = -1  # positions before this one must wait for a lower rank that came up in their word
        for i in places:
            if i < wait:
                index.setdefault(rank, []).append(i)
                continue
            mid = end[i]
            if not mid or mid >= stop[i]:
                continue
            far = end[mid]
            if wide is None:
                if get(flat[i:far]) != rank:
                    continue
                wide = length[rank] = far - i
            if far - i != wide:  # another pair stands here by now
                continue
            end[i], end[mid] = far, 0
            low = rank
            if far < stop[i]:
                before[far] = i
                new = get(flat[i : end[far]])
                if new is not None:
                    if new < low:
                        low = new
                    at = index.get(new)
                    if at is None:
                        index[new] = [i]
                        heappush(heap, new)
                    else:
                        at.append(i)
            left = before[i]
            if left >= 0:
                new = get(flat[left:far])
                if new is not None:
                    if new < low:
                        low = new
                    at = index.get(new)
                    if at is None:
                        index[new] = [left]
                        heappush(heap, new)
                    else:
                        at.append(left)
            if low < rank:
                wait = stop[i]
        if rank in index:
            heappush(heap, rank)
    ends = np.array(end, np.int32)
    live = np.flatnonzero(ends)
    ids = np.array([ranks[flat[a:b]] for a, b in zip(live.tolist(), ends[live].tolist(), strict=True)], "<u4").tobytes()
    upto = (4 * np.searchsorted(live, closes)).tolist()
    return [ids[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]


class Vocabulary:
    """Ranks of a tiktoken file, the pattern that splits texts, and the ids of chunks met lately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.pairs = pair_ranks(self.ranks)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        plain = {c for c in chunks if c.isalpha() or (c[0] == " " and c[1:].isalpha())}  # one match of the pattern each
        cut = {c: self.pattern.findall(c) for c in chunks if c not in plain}
        words = [*plain, *{w for ws in cut.values() for w in ws}.difference(plain)]
        ids = dict(zip(words, replay([w.encode() for w in words], self.ranks, self.pairs), strict=True))
        self.known.update((c, b"".join(map(ids.__getitem__, ws))) for c, ws in cut.items())
        self.known.update(zip(words[: len(plain)], map(ids.__getitem__, words[: len(plain)]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [CHUNK.findall(t) for t in texts]
        if len(remembered(self.known)) > CACHE_LIMIT:
            self.known.clear()
        self.learn(unknown(cut, self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary) of every row.

    A null or empty text has no ids; repeated rows are encoded one by one; a null id stays null; other columns
    are not read. `unpack_ids` turns the ids into an array.
    """

    def step(batch):
        raw = [b or b"" for b in text_bytes(batch)]
        model = vocabulary(path, pattern)
        for a, b in groups([len(t) for t in raw], BLOCK_BYTES):
            ids = model.encode([t.decode("utf-8", "replace") for t in raw[a:b]])
            yield {"doc_id": batch.column(0).slice(a, b - a), "ids": ids, "decoded": [model.decode(i) for i in ids]}

    kind = docs.schema[id_column].dataType.simpleString()
    return in_batches(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")),
        step,
        f"doc_id {kind}, ids binary, decoded binary",
    )


def unpack_ids(df: DataFrame, name: str = "ids") -> DataFrame:
    """The packed ids of `encode_decode` as an array of integers."""
    digit = lambda i, k: F.conv(F.hex(F.substring(name, i * 4 + k, 1)), 16, 10).cast("int")
    return df.withColumn(
        name,
        F.when(F.length(name) == 0, F.array().cast("array<int>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), (F.length(name) / 4).cast("int") - 1),
                lambda i: digit(i, 1) + digit(i, 2) * 256 + digit(i, 3) * 65536,
            )
        ),
    )
