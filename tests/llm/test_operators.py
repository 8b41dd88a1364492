"""Each operator against a plain version of its contract, on texts with every awkward case."""

import base64
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from coinweir.llm import bpe, components, decontam, jaccard, langid, lm_scores, quality, token_counts, token_files, topk, urls
from coinweir.session import fresh_path

SCHEMA = "doc_id long, text string, score double, n_tokens string, rep long"  # the last ones clash with names in use
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed with jovial sphinx near quartz vows".split()


def _texts():
    rng = random.Random(7)
    marks = [*"aAbB  \n\t,.!?;:'’\"<|>12²½ßéΣσς一नम\x1c\x85🙂#_-", "<|endoftext|>", "<|startoftext|>", "'s", " the", "\n\n", "  "]
    long = " ".join(rng.choice(BASE) + str(rng.randrange(50)) for _ in range(4000))
    near = [BASE * 6, BASE * 6 + ["end"], [*BASE * 5, "other", *BASE[1:]]]
    return [None, "", " ", "\n", "a", "One TWO", "!!", long, long, long + " tail", *(" ".join(w) for w in near), *("".join(rng.choices(marks, k=rng.randrange(80))) for _ in range(60))]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, 0.5, "x", 1) for i, t in enumerate(_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_as_tiktoken(docs, rows, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, P.PATTERN).collect()}
    for key, text, *_ in rows:
        assert np.frombuffer(bytes(got[key].ids), "<u4").tolist() == library.encode_ordinary(text or "")
        assert bytes(got[key].decoded) == (text or "").encode()
    one = bpe.unpack_ids(bpe.encode_decode(docs.where("doc_id IN (0, 5)"), path, P.PATTERN)).orderBy("doc_id").collect()
    assert [list(r.ids) for r in one] == [[], library.encode_ordinary("One TWO")]
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0


def test_replay_prefers_the_lowest_rank_that_comes_up():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 260, b"abcd": 259, b"cd": 301}
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(random.Random(i).choices("abcd", k=12)) for i in range(300)]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.replay([w.encode() for w in words], ranks)]
    assert got == [library.encode_ordinary(w) for w in words]


def test_replay_looks_pairs_of_bytes_up_at_once():
    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    ranks = Counted({bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301, b"xy": 302})
    words = ["", "ab", "cbacba" * 20, "abc", "", "zzzz", "xyz", "c", ""]
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=dict(ranks), special_tokens={})
    got = bpe.replay([w.encode() for w in words], ranks)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(w) for w in words]
    assert ranks.asked < 80  # 19 places of ab in the long word and one of xy are followed; 137 bytes are not looked up one by one
    assert bpe.replay([], ranks) == [] and bpe.replay([b"", b""], ranks) == [b"", b""]


def test_token_counts_as_tokenizers(docs, rows, empty):
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, limit=100).collect()}
    for key, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[key].n_tokens, got[key].n_bytes, got[key].over_limit) == (n, len((text or "").encode()), n > 100)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_files(spark, docs, rows, empty):
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    folder = fresh_path(spark, "tokens")
    token_files.write_token_files(docs, folder, path, 2)
    stored = token_files.read_token_files(spark, folder)
    start = 0
    for (key, text, *_), r in zip(rows, token_files.with_checksums(stored).orderBy("doc_id").collect(), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (key, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    plan = stored.where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan
    other = fresh_path(spark, "tokens")
    token_files.write_token_files(empty, other, path, 2)
    assert token_files.with_checksums(token_files.read_token_files(spark, other)).count() == 0


def test_chunks_of_texts_as_the_library():
    path = P.path("byte_bpe_50k.json")
    model, other = token_files.ChunkEncoder(path), token_files.ChunkEncoder(path)
    rng = random.Random(5)
    marks = ["a", "the", " ", ".", ",", "\n", "é5", "x.", "&", " b", "'s ", "\0", "\u0301", "\x85", "  ", "<|endoftext|>"]
    texts = ["".join(rng.choices(marks[: rng.randrange(4, len(marks))], k=rng.randrange(40))) for _ in range(3000)]
    assert all("".join(token_files.chunks_of(t)) == t for t in texts)
    wanted = model.library(texts)
    assert [i for k in range(0, 3000, 500) for i in model.encode(texts[k : k + 500])] == wanted
    other.cuts = False  # a file of another kind: whole texts
    assert other.encode(texts) == wanted
    spec = {"model": {"type": "BPE"}, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    assert token_files.cuts_at_space(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"type": "BPE", "dropout": 0.1}}):
        assert not token_files.cuts_at_space(spec | change)


def _shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def _smallest(links, nodes):
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, empty, n, percent):
    rng = random.Random(3)
    texts = _texts()
    for _ in range(8):  # families of near copies, some of which link only through others
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 150))]
        for _ in range(12):
            words = list(words)
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [_shingles(t, n) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = _smallest(links, range(len(sets)))
    df = spark.createDataFrame([(i, t, 0.0, "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert jaccard.jaccard_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c", 0.0, "", 0), (4, "a b c", 0.0, "", 0), (4, "a b c", 0.0, "", 0)], SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard.jaccard_components(odd).collect()) == [(-1, None), (4, 4), (4, 4)]


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_components_of_more_links(spark, monkeypatch):
    made = lambda links: spark.createDataFrame(links, "a long, b long")
    links = [(i, i + 1) for i in range(100, 140)] + [(200, 201), (201, 202), (300, 301), (None, 300)]
    more = [(140, 202), (90, 301), (5, 6), (6, 6), (400, None), (101, 120)]
    known = components.written(components.components(made(links)), "known")
    rows = []
    kept = components.written
    monkeypatch.setattr(components, "written", lambda df, label: rows.append((label, kept(df, label))) or rows[-1][1])
    got = components.components(made(more), known=known).collect()
    assert max(df.count() for label, df in rows if label == "links") <= 3  # links inside known components are not gone through again
    assert sorted((r.node, r.root) for r in got) == sorted((r.node, r.root) for r in components.components(made(links + more)).collect())
    inside = components.components(made([(101, 140), (201, 200)]), known=known)
    assert sorted((r.node, r.root) for r in inside.collect()) == sorted((r.node, r.root) for r in known.collect())
    first = components.components(made(more), known=components.components(made([])))
    assert {r.node: r.root for r in first.collect()} == {140: 140, 202: 140, 90: 90, 301: 90, 5: 5, 6: 5, 101: 101, 120: 101}


def test_components_of_few_links_take_one_round(spark, monkeypatch):
    links = [(f"é{i:03}", f"é{i + 1:03}") for i in range(300)] + [("x", "y"), ("y", "x"), ("z", "y"), ("w", "w")]
    want = {f"é{i:03}": "é000" for i in range(301)} | dict.fromkeys("xyz", "x")
    labels, kept = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: labels.append(label) or kept(df, label))
    df = spark.createDataFrame(links, "a string, b string").repartition(7)
    assert {r.node: r.root for r in components.components(df).collect()} == want
    assert len(labels) <= 2  # each written table is jobs, plans and broadcasts of the driver
    labels.clear()
    monkeypatch.setattr(components, "AT_ONCE", 40)  # rounds first, then what is left at once
    assert {r.node: r.root for r in components.components(df).collect()} == want
    assert labels.count("points") > 1


def test_backoff_scores(docs, rows, empty):
    words = {k: (t or "").encode().lower().split() for k, t, *_ in rows}
    counts = Counter(g for w in words.values() for n in (1, 2, 3) for g in zip(*(w[i:] for i in range(n)), strict=False))
    total = sum(map(len, words.values()))
    got = {r.doc_id: r for r in lm_scores.score_documents(docs).collect()}
    for key, w in words.items():
        want = 0.0
        for i in range(len(w)):
            x = math.log10(counts[(w[i],)] / total)
            for n in (2, 3):
                if i >= n - 1:
                    gram = tuple(w[i - n + 1 : i + 1])
                    x = math.log10(counts[gram] / counts[gram[:-1]]) if counts[gram] >= 2 else x + math.log10(0.4)
            want += x
        assert got[key].n_words == len(w)
        assert got[key].log10_score == pytest.approx(want, abs=1e-6)
        assert (got[key].score is None) == (not w)
    assert lm_scores.score_documents(empty).count() == 0


def test_benchmark_windows(spark, empty):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(300)]
    items = [(str(i), " ".join(rng.choices(pool, k=k))) for i, k in enumerate([0, 1, 2, 5, 9, 10, 11, 14, 30, 30])]
    items += [("copy", items[-1][1]), ("none", None), ("Upper", items[5][1].upper().replace(" ", " -- "))]
    texts = [None, "", "!!!", items[8][1], " ".join(rng.choices(pool, k=3000))]
    for _ in range(20):
        words = rng.choices(pool, k=rng.randrange(5, 400))
        for _, text in rng.sample(items[1:10], 2):
            at, cut = rng.randrange(len(words)), text.split()
            first = rng.randrange(len(cut))
            words[at:at] = cut[first : first + rng.randrange(1, 20)]
        texts.append(", ".join(words))
    windows = {}
    for key, text in items:
        words = decontam.words_of((text or "").encode())
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(key)
    df = spark.createDataFrame([(i, t, 0.0, "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(df, bench).collect()}
    some = 0
    for key, text in enumerate(texts):
        words, hit, names = decontam.words_of((text or "").encode()), set(), set()
        for w, ids in windows.items():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    names |= ids
        assert (got[key].n_words, got[key].n_hit, list(got[key].items)) == (len(words), len(hit), sorted(names))
        some += bool(hit)
    assert some > 10
    assert decontam.decontaminate(empty, bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(df, bench.limit(0)).collect()} == {0}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(rng.normal(size=8) * rng.choice([0.2, 1, 3])).astype(float).tolist() for _ in range(400)]
    vectors[20:60] = [vectors[20]] * 40  # ties
    bad = [None, [1.0, None], [float("nan")] * 8, [float("inf")] * 8, [], [0.0] * 8, [1.0, 2.0]]
    rows = [(i, v, 1) for i, v in enumerate([*vectors, *bad])] + [(None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    ok = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for q in [i for i in ok if i % 20 == 0]:
        found = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))[:7]
        want |= {(q, r): (c, -s) for r, (s, c) in enumerate(found, 1)}
    for size in (64, 8192):
        found = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, bucket_rows=size).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found} == want
        assert len(found) == len(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


def test_top_k_of_negative_scores(spark):
    """The first threshold of a query may be negative: the longest vectors are the worst for it."""
    rng = np.random.default_rng(3)
    vectors = [*(-10 * rng.random((40, 4)) - 1).tolist(), *(rng.random((160, 4)) - 0.1).tolist()]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    x = np.floor(64 * np.array(vectors)).astype(int)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") >= 40, 5, bucket_rows=32).collect()}
    want = {}
    for q in range(40, 200):
        found = sorted((-int(x[q] @ x[c]), c) for c in range(200) if c != q)[:5]
        want |= {(q, r): (c, -s) for r, (s, c) in enumerate(found, 1)}
    assert got == want


def test_top_k_of_large_components(spark):
    """Scores of any size: exact in 64 bits, the nearest long beyond."""
    rng, limit = random.Random(6), (1 << 63) - 1
    vectors = [[rng.choice([0.5, -3.0, 1e3, 4e7, -1e8, 2.0**40]) * rng.random() for _ in range(3)] for _ in range(120)]
    vectors[:4] = [[1.7e308, 1.0, 0.0], [-1.7e308, 2.0, 1.0], [2.0**40, 0.0, 0.0], [0.0, 0.0, 3.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    largest = int(np.finfo(np.float64).max)
    ok = [[min(max(math.floor(64 * Fraction(x)), -largest), largest) if abs(x) > 1e300 else math.floor(64 * x) for x in v] for v in vectors]
    for size in (16, 8192):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 9, bucket_rows=size).collect()}
        for q in range(0, 120, 20):
            scores = [(-min(max(sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), -limit), limit), c) for c in range(120) if c != q]
            for r, (s, c) in enumerate(sorted(scores)[:9], 1):
                assert got[q, r] == (c, -s)


def test_languages(spark, docs, empty):
    rng = random.Random(1)
    own = {"aa": "bada goda ladi mora".split(), "bb": "zuxi quty xenu wiju".split()}
    rows = [(i, " ".join(rng.choices(own[k], k=30)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    model = langid.fit(spark.createDataFrame([*rows, (900, None, "aa"), (901, "12", "bb"), (902, "abc", None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected and 0 <= got[i].score <= 1 for i, _, k in rows)
    for r in langid.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    # languages in blocks of one give the same
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, single = langid.fit(labelled), langid.fit(labelled, at_once=1)
    assert (len(whole.blocks), len(single.blocks)) == (1, 2)
    assert langid.identify(docs, single).orderBy("doc_id").collect() == langid.identify(docs, whole).orderBy("doc_id").collect()
    mixed = docs.unionByName(labelled.select(F.col("doc_id") + 1000, "text", F.lit(0.5), F.lit("x"), F.lit(1)).toDF(*docs.columns))
    assert sorted(map(str, langid.without_rejected(mixed, single).collect())) == sorted(map(str, langid.without_rejected(mixed, whole).collect()))
    assert langid.without_rejected(mixed, single).count() >= 120
    assert langid.identify(empty, single).count() == langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty.withColumn("lang", F.lit("aa")))).collect()} == {"und"}


def test_language_limits(spark):
    """Gibberish, one word over and over and a language never learned are rejected at any length, clean texts stay."""
    rng = random.Random(4)
    raw = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    model = langid.fit(raw.where("lang <> 'de'"))
    gibberish = []
    for size in (100, 300, 1000, 4000, 16000):
        for _ in range(20):
            text = ""
            while len(text) < size:
                text += "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 11))) + " "
            gibberish.append(text)
        gibberish.append("Oure " * (size // 5))
    odd = spark.createDataFrame(list(enumerate(gibberish)), "doc_id long, text string")
    assert [r.doc_id for r in langid.identify(odd, model).where("NOT rejected").collect()] == []
    found = langid.identify(raw, model).join(raw.select("doc_id", "lang", "text"), "doc_id").collect()
    unknown = [r for r in found if r.lang == "de" and len(r.text) >= 100]
    assert len(unknown) > 100
    assert all(r.rejected for r in unknown)

    def clean(text):  # prose: most letters small, words neither repeated all over nor few
        words = text.split()
        small = sum(map(str.islower, text))
        return len(words) >= 20 and len(set(words)) >= 0.2 * len(words) and small >= 0.7 * len(text)

    known = [r for r in found if r.lang != "de" and clean(r.text)]
    assert len(known) > 500
    assert [r.doc_id for r in known if r.rejected] == []


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    good = [f"{w} of the " for w in BASE]
    make = lambda y: " ".join(rng.choices(good, k=40)) if y else "".join(rng.choices("%$#@!*XYZ", k=300))
    rows = [(i, make(i % 2), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.drop("quality"), df.select("doc_id", "quality"))
    fresh = spark.createDataFrame([(i, make(i % 2)) for i in range(50)], "doc_id long, text string")
    assert all(r.predicted == r.doc_id % 2 and 0 <= r.score <= 1 for r in quality.score(fresh, model).collect())
    assert quality.score(docs, model).count() == docs.count()
    assert quality.score(empty, model).count() == 0
    assert quality.fit(df.drop("quality"), df.where("quality = 1").select("doc_id", "quality")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_quality_behind_a_common_head(spark):
    """What tells good from bad is behind 7,000 bytes that all texts begin with."""
    rng = random.Random(2)
    head = " ".join(rng.choice(BASE) + str(rng.randrange(10**4)) for _ in range(900))[:7000]
    tails = [[f"{w} click now " for w in BASE], [f"{w} of the " for w in BASE]]
    make = lambda y: head + " ".join(rng.choices(tails[y], k=200))
    rows = [(i, make(i % 2), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.drop("quality"), df.select("doc_id", "quality"))
    assert b"of the" in model.good and b"of the" not in model.bad
    assert b"click" in model.bad and b"click" not in model.good
    fresh = spark.createDataFrame([(i, make(i % 2)) for i in range(50)], "doc_id long, text string")
    assert all(r.predicted == r.doc_id % 2 for r in quality.score(fresh, model).collect())


def test_urls(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    cases = {
        "http://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://borg/": ("borg", "/", None, None),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com": ("x.com", "", None, None),
        "http://x.com?/fr/": ("x.com", "", None, None),
        "x.com/fr/": ("", "", None, None),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://a://b.org/": ("a:", "//b.org/", None, None),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)]
    rows += [(100 + i, f"http://{'good' if i % 2 else 'ugly'}{i}.x.com/{'fr' if i % 2 else 'de'}/a", "x") for i in range(60)]
    rows += [(300, "http://good77.y.net/fr/a", "x"), (301, "http://ugly78.y.net/de/a", "x"), (None, "http://x.com/de/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.filter_urls(pages, rules).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert (got[300].verdict, got[301].verdict, got[None].verdict) == ("allow", "block", "block")
    assert len(got) == len(rows)
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages.where("page_id >= 300"), rules).collect()} == {"allow"}




def test_workers_forget_caches_that_a_task_does_not_use():
    from coinweir.llm import common

    one, two = {1: 1}, {2: 2}
    common.remembered(one)
    common.remembered(two)
    common.release()
    assert one and two
    common.remembered(two)
    common.release()
    assert not one and two


def test_a_cache_that_begins_to_fill_empties_those_of_other_operators():
    from coinweir.llm import common

    common.release()
    common.release()
    one, two = {}, {}
    common.remembered(one)[1] = 1
    common.release()
    common.remembered(two)[2] = 2
    assert not one and two
    common.remembered(one)[1] = 1
    assert one and two  # a task that uses both keeps both
    common.release()
    common.remembered(one)
    assert one and two
    common.WORD_HASHES([b"a", b"b"])
    common.release()
    common.remembered(two)
    common.release()
    assert not common.WORD_HASHES.known
