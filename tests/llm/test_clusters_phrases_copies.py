"""Clusters (11), phrases (12) and MinHash groups (13) against plain versions of their contracts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from coinweir.llm import clustering, collocations, superminhash
from coinweir.llm import queries as Q

CLASH = "doc_id long, text string, lang string, key string, rep long, cls string, component_id string, a string, phrase long"


# ---- clusters ----------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [256 * int(x) if abs(x) >= 2**53 else int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    square = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w, strict=True))
    assign = lambda: [min((square(v, w), j) for j, w in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    shown = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return Counter((i, j, shown(d), shown(inertia[j]), shown(sum(inertia.values())), sha[j]) for (i, _), (d, j) in zip(kept, found, strict=True))


def check_clusters(spark, rows, k, dim, rounds=5):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, packed string").repartition(3)
    got = clustering.cluster(df, k=k, rounds=rounds, dim=dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows, k, rounds, dim)


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * 0.3 + rng.integers(0, 4, 6)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(150)] + [(0, rows[0][1])] * 3  # a third of all rows are one vector
    rows += [(600 + i, [float(i % 2)] * 6) for i in range(20)]  # ties
    rows += [(700, None), (701, []), (702, [1.0] * 5), (703, [1.0, None] * 3), (704, [float("nan")] * 6), (705, [float("inf")] * 6), (None, [0.5] * 6), (None, [-0.001] * 6)]
    for k in (1, 2, 9, 40):
        check_clusters(spark, rows, k, 6)


def test_clusters_of_few_and_of_large_vectors(spark):
    check_clusters(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], 5, 2)
    big = [(i, [x, -x]) for i, x in enumerate([0.0, 1.5, 3.0e4, 1.4e5, 2.0e5, 1e9, 1.5e300, -1.7e308, 1.7e308, 2.0**60 + 2.0**20, 131072.0, -131072.0])]
    for k in (2, 4, 12):
        check_clusters(spark, big, k, 2)
    check_clusters(spark, [(i, [float(i)]) for i in range(200)] + [(900, [1e30])], 30, 1)  # a large centroid far from all others
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert clustering.cluster(none).count() == 0
    assert clustering.cluster(none.limit(0)).count() == 0


def test_orchard_measures_few_centroids():
    rng = np.random.default_rng(3)
    c = rng.integers(-1000, 1000, (40, 8)) * 100
    lists = clustering.Lists(list(range(40)), c)
    measured = []
    plain = clustering._squares
    clustering._squares = lambda x: measured.append(len(x)) or plain(x)
    try:
        x = c[rng.integers(0, 40, 500)] + rng.integers(-50, 50, (500, 8))
        number, best = lists.nearest(x)
    finally:
        clustering._squares = plain
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all()
    assert (best == every.min(axis=1)).all()
    assert sum(measured) < 0.6 * 500 * 40


# ---- phrases -----------------------------------------------------------------------------------------------


def plain_phrases(rows, max_words, least, hold, first):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, w), a in candidates.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(m == lang and len(v) > len(w) and 100 * b >= hold * a and inside(v) for (m, v), b in candidates.items()):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, b" ".join(w), left, right))
    out.sort()
    seen, rows = Counter(), set()
    for lang, score, a, phrase, left, right in out:
        seen[lang] += 1
        if seen[lang] <= first:
            rows.add((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return rows


def _phrase_rows():
    rng = random.Random(5)
    words = ["of", "the", "The", "new", "york", "york.", "city,", "in", "a", "é", "Éa", "x\x0by", "b c", "\tt", "", "...", "u;v", "1\n2"]
    weights = [9, 9, 4, 5, 5, 1, 1, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(60))), rng.choice(["en", "en", "fr", None, "und"])) for i in range(200)]
    rows += [(300 + i, "one very common passage of many words", "en") for i in range(100)]  # a third of all rows
    rows += [(500, None, "en"), (501, "", "en"), (502, " \t ", None), (503, "aa aa " * 40, "de"), (503, "aa aa " * 40, "de"), (None, "aa bb " * 12, "de"), (504, None, "xx")]
    return rows


@pytest.mark.parametrize(("max_words", "route", "held"), [(3, 1 << 20, 1 << 18), (3, 3, 8), (2, 5, 8), (5, 3, 50)])
def test_phrases(spark, monkeypatch, max_words, route, held):
    """With small routes, common words and pairs are spread over many; the result stays."""
    monkeypatch.setattr(collocations, "ROUTE_WORDS", route)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "ROW_SUFFIXES", 4)
    monkeypatch.setattr(collocations, "HOT_SHARE", 1_000 if route > 100 else 30)
    rows = _phrase_rows()
    df = spark.createDataFrame([(i, t, la, "k", 1, "c", "d", "a", 2) for i, t, la in rows], CLASH).repartition(4)
    got = {tuple(r) for r in collocations.collocations(df, max_words=max_words, least=10, hold=50, first=25).collect()}
    assert got == plain_phrases(rows, max_words, 10, 50, 25)
    assert len(got) > 40
    assert collocations.collocations(df.limit(0)).count() == 0


def test_phrases_of_a_long_text(spark, monkeypatch):
    """A text above the block size is taken in parts, and no piece is cut."""
    monkeypatch.setattr(collocations, "GROUP_BYTES", 1000)
    text = " ".join(f"w{i % 7} v{i % 5}" + ("." if i % 31 == 0 else "") for i in range(5000))
    rows = [(1, text, "en"), (2, text.replace(".", " "), "en")]
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == plain_phrases(rows, 3, 10, 50, 2000)


def test_sort_finds_equal_parts():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 9, 3000) for _ in range(3)]
    weights = rng.integers(1, 4, 3000)
    got = {}
    for d, found, totals in collocations.equal_parts(columns, weights, np.array([1000, 1, 1999]), [10, 10, 10]):
        for at, w in zip(found.tolist(), totals.tolist(), strict=True):
            key = (np.searchsorted([1000, 1001], at, "right"), *(int(columns[j][at]) for j in range(d + 1)))
            assert key not in got
            got[key] = w
    want = Counter()
    for i, (row, w) in enumerate(zip(zip(*columns, strict=True), weights.tolist(), strict=True)):
        for d in range(1, 4):
            if 0 not in row[:d]:
                want[(np.searchsorted([1000, 1001], i, "right"), *map(int, row[:d]))] += w
    assert got == {k: w for k, w in want.items() if w >= 10}


# ---- MinHash groups ----------------------------------------------------------------------------------------


def plain_signature(tokens):
    """The algorithm one shingle after the other, without stopping early."""
    signs = [2**64 - 1] * superminhash.SLOTS
    for t in tokens:
        order = list(range(superminhash.SLOTS))
        for j in range(superminhash.SLOTS):
            rank, place = superminhash._draws(np.array([t], np.uint64), j)
            k = int(place[0])
            order[j], order[k] = order[k], order[j]
            signs[order[j]] = min(signs[order[j]], int(rank[0]))
    return signs


def test_signatures(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 2, 7, 40, 200)]
    assert superminhash.signatures(sets)[1:].tolist() == [plain_signature(s) for s in sets[1:]]
    whole = superminhash.signatures(sets)
    monkeypatch.setattr(superminhash, "ELEMENTS", 16)
    assert (superminhash.signatures(sets) == whole).all()
    assert sorted(s >> 32 for s in plain_signature(sets[1])) == list(range(superminhash.SLOTS))  # ranks are a permutation


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(60):
        common = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.concatenate((common, rng.integers(0, 2**63, 10).astype(np.uint64))) for _ in range(2))
        x, y = superminhash.signatures([a, b])
        errors.append((x == y).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < np.sqrt(0.8 * 0.2 / superminhash.SLOTS)  # lower than with independent hashes


def plain_groups(rows, n, percent):
    sets = {}
    for key, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(key, set()).add(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    top = {k: k for k in sets if k is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(top)
    for a in keys:
        for b in keys:
            if a < b and any(s and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: find(k) for k in top}


def _copies():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(120)]
    base = [word() for _ in range(120)]
    for i in range(150):  # a third of all rows are near copies of one text
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((200 + i, " ".join(copy)))
    rows += [(400 + i, "Exactly The Same Words here") for i in range(60)]
    lines = [" ".join(word() for _ in range(8)) for _ in range(14)]
    rows += [(500 + i, "\n".join(rng.sample(lines, 9))) for i in range(60)]  # alike, from common lines
    chain = [word() for _ in range(100)]
    for i in range(12):  # each alike to the next only
        chain[i * 8 : i * 8 + 2] = [word(), word()]
        rows.append((600 + i, " ".join(chain)))
    long = " ".join(word() for _ in range(30_000)) + " "
    rows += [(700, long * 5), (701, long * 5 + "end"), (702, long.upper() * 5)]
    rows += [(800, None), (801, ""), (802, " \n\t"), (803, "one"), (804, "ONE"), (805, "one two three"), (806, "one two four"), (807, "a b c d e"), (0, rows[0][1]), (1, rows[2][1])]
    return rows + [(None, " ".join(base)), (None, None)]


def test_minhash_groups(spark):
    rows = _copies()
    df = spark.createDataFrame([(i, t, "en", "k", 1, "c", "d", "a", 2) for i, t in rows], CLASH).repartition(5)
    for n, percent in ((4, 80), (2, 90)):
        want = plain_groups(rows, n, percent)
        got = superminhash.near_duplicates(df, n, percent).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
        sizes = {(r.doc_id, r.n_shingles) for r in got}
        assert {(800, 0), (801, 0), (802, 0), (803, 1), (None, 0)} <= sizes
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert superminhash.near_duplicates(df.limit(0)).count() == 0
    assert superminhash.near_duplicates(df.where("doc_id IN (800, 801)")).count() == 2


def test_pairs_stay_in_proportion(spark, monkeypatch):
    """Texts put together from common lines, unlinked: candidates do not grow with the square of their number."""
    rng = random.Random(9)
    lines = [" ".join(f"w{rng.randrange(9999)}" for _ in range(9)) for _ in range(40)]
    seen = []
    plain = superminhash._pairs
    monkeypatch.setattr(superminhash, "_pairs", lambda *a: seen.append(plain(*a)) or seen[-1])
    sizes = []
    for n in (200, 400):
        rows = [(i, "\n".join(rng.sample(lines, 10))) for i in range(n)]
        seen.clear()
        superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
        sizes.append(sum(p.count() for p in seen))
    assert sizes[1] <= 4 * sizes[0] + 50
    assert sizes[1] < 400


# ---- registered queries ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op4_exact_topk", "op5_ngram_jaccard", "op8_benchmark_windows", "op11_orchard_clusters", "op12_phrase_collocations", "op13_superminhash"])
def test_queries_with_sql(spark, name):
    from tests.compare import differences, duck

    folder = "/root/testdata/sf0.001"
    assert [p for p in differences(Q.QUERIES[name](spark, folder), duck(folder), Q.CHECKS[name]) if not p.startswith("note")] == []
