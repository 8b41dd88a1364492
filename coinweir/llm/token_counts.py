"""Token counts (9): rank-synchronous merging of ragged numpy arrays.

Pre-tokens of a batch lie one behind the other in one array. In every round each of them applies its
lowest-ranked pair (the leftmost of equals), all at once; those without a pair to merge are done and leave the
arrays. What counts is the number of symbols that survive.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweir.llm.common import SPACE, groups, in_batches, text_bytes, unknown

CACHE_LIMIT = 500_000  # words whose counts a worker remembers
LIMIT = 2048
_NONE = np.int64(1) << 62
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")  # white space to str.split, but not to the tokenizer
_SPACES = regex.compile(f"[^{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the
    others for letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class RaggedMerger:
    """Merge table of a tokenizers file (BPE with an end-of-word mark) as sorted numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        mark, letters = model["end_of_word_suffix"] or "", byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + mark] for c in letters], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, int] = {}

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols left of each word; an empty word has none."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        full = np.flatnonzero(counts)
        if not len(full):
            return counts
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym, ends = self.inner[flat], np.cumsum(counts[full]) - 1
        sym[ends] = self.final[flat[ends]]
        owner = np.repeat(full, counts[full])
        while len(sym) > 1:
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            ranked = np.full(len(sym), _NONE)
            where = np.flatnonzero(fits)
            ranked[where] = (self.ranks[at[where]] << 40) + where
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(ranked, starts)
            live = best < _NONE
            if not live.any():
                break
            left = best[live] & ((1 << 40) - 1)
            sym[left] = self.made[at[left]]
            counts[owner[left]] -= 1
            keep = np.repeat(live, np.diff(np.append(starts, len(sym))))
            keep[left + 1] = False
            sym, owner = sym[keep], owner[keep]
        return counts

    def learn(self, chunks: list[str]) -> None:
        """Count the tokens of chunks without white space and remember them."""
        pieces, shares = [], []
        for chunk in chunks:
            if not chunk.isascii():
                chunk = unicodedata.normalize("NFC", chunk)
            # letter by letter: str.lower() alone looks at a word's end for the Greek sigma
            chunk = chunk.lower() if "Σ" not in chunk else "".join(map(str.lower, chunk))
            found = [chunk] if chunk.isalpha() else self.piece.findall(chunk)
            pieces += found
            shares.append(len(found))
        counts = np.concatenate(([0], np.cumsum(self.symbols([p.encode() for p in pieces]))))
        ends = np.cumsum(np.array(shares, np.int64)) if shares else np.zeros(0, np.int64)
        totals = counts[ends] - counts[ends - np.array(shares, np.int64)]
        self.known.update(zip(chunks, totals.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; strings of special tokens count as one each, as the library finds them."""
        cut, extra = [], []
        for text in texts:
            n = 0
            if "<|" in text:
                text, n = self.special.subn(" ", text)
            extra.append(n)
            cut.append(text.split() if not _ODD_SPACE.search(text) else _SPACES.findall(text))
        if len(self.known) > CACHE_LIMIT:
            self.known.clear()
        self.learn(unknown(cut, self.known))
        get = self.known.__getitem__
        return [n + sum(map(get, words)) for n, words in zip(extra, cut, strict=True)]


@lru_cache(2)
def merger(path: str) -> RaggedMerger:
    return RaggedMerger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted one by one; a null id stays null;
    other columns are not read.
    """

    def step(batch):
        raw = [b or b"" for b in text_bytes(batch)]
        model, counts = merger(path), []
        for a, b in groups([len(t) for t in raw]):
            counts += model.count([t.decode("utf-8", "replace") for t in raw[a:b]])
        yield {"doc_id": batch.column(0), "n_bytes": [len(t) for t in raw], "n_tokens": counts}

    kind = docs.schema[id_column].dataType.simpleString()
    counted = in_batches(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")),
        step,
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint",
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
