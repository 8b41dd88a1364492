"""The pipeline's stages against their operators' decisions, and what is registered."""

import hashlib
from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from coinweir.llm import bpe, decontam, jaccard, langid, quality

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}


def test_stages(spark):
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert kept.columns == raw.columns
        assert kept.exceptAll(docs).count() == 0
        if name == "near_duplicates":
            want = {r.component_id for r in jaccard.jaccard_components(docs).collect()}
            assert {r.doc_id for r in kept.select("doc_id").collect()} == want
        if name == "decontamination":
            bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            assert decontam.decontaminate(kept, bench).where("n_hit > 0").count() == 0
        docs = kept
    got = {r.doc_id: hashlib.sha256(bytes(r.ids)).digest() for r in corpus_pipeline.encoding_stage(spark, docs, FOLDER).collect()}
    want = bpe.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).select("doc_id", F.sha2("ids", 256).alias("h"))
    assert {k: v.hex() for k, v in got.items()} == {r.doc_id: r.h for r in want.collect()}
    assert 0 < len(got) < raw.count()


def _plain_duplicates(rows):
    """Kept (id, text) by comparing all pairs of rows."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return Counter(rows[i] for i in range(len(rows)) if find(i) == i)


def _rows(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_rows_without_or_with_repeated_ids(spark):
    """Decisions hold for each row: null ids, repeated rows, one id with two texts."""
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 10]
    base = [(r.doc_id, r.text) for r in raw.select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    words = [f"w{i}" for i in range(100)]
    near = [" ".join(words), " ".join([*words, "end"]), " ".join(["other"] + words)]
    extra = [(None, near[0]), (None, near[1]), (None, near[1]), (7001, near[2]), (None, "only here without an id"), (None, "only here without an id")]
    extra += [(7002, "one text of an id with two")] * 5 + [(7002, "quite another text, and a clean one"), (7003, None), (None, None), (None, "")]
    extra += [(7004, items[0]), (7004, "clean words beside a contaminated text"), (None, items[0]), (7005, "!!! 123"), (None, "!!! 123")]
    extra += [(None, t) for _, t in base[:20]]
    docs = spark.createDataFrame(base + extra, "doc_id long, text string").repartition(5)
    got = _rows(corpus_pipeline.duplicate_stage(spark, docs, FOLDER))
    assert got == _plain_duplicates(base + extra)

    windows = set()
    for text in [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]:
        w = decontam.words_of((text or "").encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def hit(text):
        w = decontam.words_of((text or "").encode())
        return any(tuple(w[i : i + n]) in windows for n in range(1, 11) for i in range(len(w) - n + 1))

    got = _rows(corpus_pipeline.decontamination_stage(spark, docs, FOLDER))
    assert got == Counter(r for r in base + extra if not hit(r[1]))
    assert (None, items[0]) not in got
    assert got[7004, "clean words beside a contaminated text"] == 1

    texts = list(enumerate(t for _, t in base + extra))
    numbered = spark.createDataFrame(texts, "doc_id long, text string")
    model = langid.fit(raw)
    good = {r.doc_id for r in langid.identify(numbered, model).where("NOT rejected").collect()}
    assert _rows(corpus_pipeline.language_stage(spark, docs, FOLDER)) == Counter((base + extra)[i] for i in good)
    model = quality.fit(raw, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in quality.score(numbered, model).where("predicted = 1").collect()}
    assert _rows(corpus_pipeline.quality_stage(spark, docs, FOLDER)) == Counter((base + extra)[i] for i in good)


def test_clashing_columns_and_empty_tables(spark):
    """Columns named like those that the stages use stay as they are; empty tables go through."""
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = "a long clean text about nothing in particular that is kept by every stage of this test"
    rows = [(i, text if i < 3 else f"{text} number {i} of many others like {i * i}", "k", 1, "z", "p", "c") for i in range(8)]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, _place int, component_id string, n_hit string, cls string")
    bench = decontam.decontaminate(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("n_hit > 0").count()
    assert bench == 0
    for stage in (corpus_pipeline.duplicate_stage, corpus_pipeline.decontamination_stage):
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        got = Counter(tuple(r) for r in kept.collect())
        assert set(got) <= {tuple(r) for r in rows}
        assert len(got) > 1
        if stage is corpus_pipeline.duplicate_stage:
            assert {(r[0], r[1]): n for r, n in got.items()} == dict(_plain_duplicates([(r[0], r[1]) for r in rows]))
    none = raw.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0


def test_batches_to_python_are_bounded_in_bytes(spark):
    """Also while the caller writes what a stage returns, and only as far as the session has no setting of its own."""
    import pyarrow as pa

    from coinweir.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    docs = spark.range(6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 3000).alias("text"))
    before = spark.conf.get(common.BYTES_SETTING, None)
    try:
        spark.conf.unset(common.BYTES_SETTING)
        made = corpus_pipeline.encoding_stage(spark, docs, FOLDER)
        assert made.count() == 6000
        found = docs.mapInArrow(sizes, "rows bigint, bytes bigint").collect()  # by the session's setting, as the stage runs
        assert sum(r.rows for r in found) == 6000
        assert max(r.bytes for r in found) <= 2 * common.BATCH_BYTES
        spark.conf.set(common.BYTES_SETTING, 100_000)
        corpus_pipeline.encoding_stage(spark, docs, FOLDER)
        assert max(r.bytes for r in docs.mapInArrow(sizes, "rows bigint, bytes bigint").collect()) <= 200_000
    finally:
        if before is None:
            spark.conf.unset(common.BYTES_SETTING)
        else:
            spark.conf.set(common.BYTES_SETTING, before)
