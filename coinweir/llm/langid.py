"""Language identification (7): nearest of several centroids per language by cosine, with a limit for each length.

Texts become TF-IDF vectors of hashed byte n-grams (letters only, lower case). The model is fitted on a bounded
sample of labelled rows, each language in a task of its own; every text is then scored as a whole in the tasks that
read it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from coinweir.llm.common import BATCH_ROWS, in_batches, map_batches, may_be_among_first, release, text_bytes, written

SAMPLE_ROWS = 1_500  # labelled rows of each language that the model is fitted on
AT_ONCE = 400  # languages whose centroids a task or the driver holds; more are gone through in blocks
_SUM_PARTS = 64
CENTROIDS = 3
DIMENSIONS = 1 << 12
ROUNDS = 12
BANDS = tuple(range(2, 17))  # limits are set for texts of 2**band bytes
REJECT_SHARE = 0.75  # a limit is this part of the median cosine of the language's windows of that size
REJECT_LOW = 0.1  # ... or as far again below this quantile of them as twice its distance from the median, if lower
CLUSTER_SHARE = 0.1  # a cluster of fewer of its language's rows is no centroid
SCORED = 64  # texts whose vectors a task holds at once
UNDETERMINED = "und"
_NOT_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_JOINED = pa.struct([("band", pa.list_(pa.int32())), ("cosine", pa.list_(pa.float64()))])
_PRIMES = np.array([2654435761, 2246822519, 3266489917], np.uint64)


def has_letter(text: bytes) -> bool:
    if any(65 <= b <= 90 or 97 <= b <= 122 for b in text[:64]):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def counts_of(text: bytes) -> np.ndarray:
    """Counts of the text's byte n-grams (1 to 4 bytes) in DIMENSIONS hashed places."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_NOT_LETTERS).lower().split()) + b" ", np.uint8).astype(np.uint64)
    out = np.zeros(DIMENSIONS)
    h = b + np.uint64(1)
    for n in range(1, 5):
        if n > 1:
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint64(257) + b[n - 1 :]
        place = ((h * _PRIMES[n % 3] + np.uint64(n)) >> np.uint64(7)) % np.uint64(DIMENSIONS)
        out += np.bincount(place.astype(np.int64), minlength=DIMENSIONS)
    return out


@dataclass
class CentroidModel:
    languages: list[str]  # language of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # rows of length 1
    limits: np.ndarray  # for each of BANDS, the least cosine of a text that belongs to the centroid's language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _vectors(counts, self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = np.round(self.vectors(counts) @ self.centroids.T, 12)  # the last bits depend on how many languages a block has
        best = cosines.argmax(axis=1)
        return best, cosines[np.arange(len(best)), best]

    def judge(self, raw: list[bytes | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, score and whether it is rejected of each text."""
        langs, scores, refused = [UNDETERMINED] * len(raw), np.zeros(len(raw)), [True] * len(raw)
        rows = [i for i, t in enumerate(raw) if t and has_letter(t)]
        for k in range(0, len(rows), SCORED):
            part = rows[k : k + SCORED]
            best, cosine = self.nearest(np.array([counts_of(raw[i]) for i in part]))
            least = self.least(best, np.array([len(raw[i]) for i in part]))
            for i, j, c, limit in zip(part, best, np.clip(cosine, 0, 1), least, strict=True):
                langs[i], scores[i], refused[i] = self.languages[j], c, bool(c < limit)
        return langs, scores, refused

    def least(self, best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Limits of texts of these bytes at their centroids, between two bands in proportion to the logarithm."""
        at = np.clip(np.log2(sizes) - BANDS[0], 0, len(BANDS) - 1)
        low = np.minimum(at.astype(int), len(BANDS) - 2)
        return self.limits[best, low] * (low + 1 - at) + self.limits[best, low + 1] * (at - low)


@dataclass
class LanguageModel:
    """Centroids of every learned language, in a written table that is read block by block."""

    fitted: DataFrame  # lang, sums
    idf: np.ndarray
    limits: dict[str, np.ndarray]
    blocks: list[tuple[str, str]]  # first and last language of each, in the order of their names

    def block(self, number: int) -> CentroidModel:
        languages, sums = _centroids(self.fitted, self.blocks[number])
        return CentroidModel(languages, self.idf, _unit(sums), np.array([self.limits[x] for x in languages]))


def _centroids(fitted: DataFrame, block: tuple[str, str]) -> tuple[list[str], np.ndarray]:
    """Language and sum of each cluster of a block, CENTROIDS x AT_ONCE at most."""
    found = fitted.where(F.col("lang").between(*block)).select("lang", "sums").toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["sums"]))
    return [r["lang"] for r in found], np.array([np.frombuffer(r["sums"], "<f4") for r in found], np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1, made in the place of `counts`."""
    np.log1p(counts, out=counts)
    counts *= idf
    counts /= np.maximum(np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None], 1e-12)
    return counts


def _clusters(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each cluster by spherical k-means, and the cluster of each row, -1 for none.

    The first centroids are drawn, far rows more often. The largest cluster and those of CLUSTER_SHARE of the rows
    stay: a few odd rows are no centre of a language.
    """
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    while len(chosen) < min(k, len(x)):
        far = np.maximum(1 - np.max(x @ np.array(chosen).T, axis=1), 0).astype(np.float64)
        if far.sum() < 1e-6:
            break
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(chosen)
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    near = (x @ c.T).argmax(axis=1)
    rows = np.bincount(near, minlength=len(c))
    kept = np.flatnonzero((rows >= CLUSTER_SHARE * len(x)) | (rows == rows.max()))
    place = np.full(len(c), -1)
    place[kept] = np.arange(len(kept))
    return np.array([x[near == j].sum(axis=0) for j in kept]), place[near]


def _held_out(vectors: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Cosines to the nearest centroid of `sums`, from which the vectors' own rows were taken; none if nothing is left."""
    left = sums[np.linalg.norm(sums, axis=1) > 1e-3]
    return (vectors @ _unit(left).T).max(axis=1) if len(left) else np.zeros(0)


def _windows(text: bytes) -> dict[int, bytes]:
    """For each band that the text is long enough for, a piece of that size at a place chosen by a hash."""
    from xxhash import xxh3_64_intdigest

    made = {}
    for band in BANDS:
        if len(text) >= 1 << band:
            start = xxh3_64_intdigest(text, band) % (len(text) - (1 << band) + 1)
            made[band] = text[start : start + (1 << band)]
    return {k: w for k, w in made.items() if has_letter(w)}


def _joined(x: np.ndarray, counts: list[bytes], sizes: np.ndarray, sums: np.ndarray, own: np.ndarray, idf: np.ndarray) -> dict[str, list]:
    """Cosines of texts shorter than a band, joined up to its size: long texts of a language that has few of them."""
    made = {"band": [], "cosine": []}
    for band in BANDS:
        total, size, held = np.zeros((1, DIMENSIONS), np.float32), 0, sums.copy()
        for row in np.flatnonzero(sizes < 1 << band):
            total[0] += np.frombuffer(counts[row], "<u2")
            size += sizes[row]
            if own[row] >= 0:
                held[own[row]] -= x[row]
            if size >= 1 << band:
                found = _held_out(_vectors(total, idf), held)
                made["band"].extend([band] * len(found))
                made["cosine"].extend(found.tolist())
                total, size, held = np.zeros((1, DIMENSIONS), np.float32), 0, sums.copy()
    return made


def _limits(languages: list[str], found: dict[tuple[str, int], tuple[float, float]]) -> np.ndarray:
    """Limits of each language at each band from (median, low quantile).

    A band without cosines takes the next shorter one's limit, else the next longer one's; a language without any
    takes the mean of the others.
    """
    out = np.full((len(languages), len(BANDS)), np.nan)
    for i, lang in enumerate(languages):
        for k, band in enumerate(BANDS):
            if (lang, band) in found:
                middle, low = found[lang, band]
                out[i, k] = max(0.0, min(REJECT_SHARE * middle, low - 2 * (middle - low)))
        known = np.flatnonzero(~np.isnan(out[i]))
        if len(known):
            out[i] = out[i, known[np.maximum(np.searchsorted(known, np.arange(len(BANDS)), "right") - 1, 0)]]
    lost = np.isnan(out).all(axis=1)
    out[lost] = 0.0 if lost.all() else out[~lost].mean(axis=0)
    return out


def fit(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    centroids: int = CENTROIDS,
    rows: int = SAMPLE_ROWS,
    at_once: int = AT_ONCE,
) -> LanguageModel | None:
    """Fit on at most `rows` rows of each language, chosen by a hash of the id.

    Rows with a null language or text, or without a letter, teach nothing; without any other rows there is no model.
    The driver gets names and limits of all languages, and centroids of `at_once` of them at a time.
    """
    kept = labelled.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    chosen = (
        kept.select("doc_id", "lang")
        .join(F.broadcast(kept.groupBy("lang").count()), "lang")  # a name and a number for each language
        .where(may_be_among_first(F.col("doc_id"), rows, F.col("count")))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
        .where(F.col("place") <= rows)
    )

    def step(batch):
        made = {"lang": [], "size": [], "counts": []}
        for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
            if has_letter(text):
                made["lang"].append(lang)
                made["size"].append(len(text))
                made["counts"].append(np.minimum(counts_of(text), 65535).astype("<u2").tobytes())
        if made["lang"]:
            yield made

    ids = written(chosen.select("doc_id", "lang").distinct(), "ids")
    few = ids.select("lang").distinct().count() <= AT_ONCE  # then there are AT_ONCE x rows ids at most
    texts = kept.join(F.broadcast(ids) if few else ids, ["doc_id", "lang"]).select("lang", "text")
    sample = written(in_batches(texts, step, "lang string, size bigint, counts binary"), "sample")

    def presence(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = np.zeros(DIMENSIONS, "<i8")
        for counts in table.column("counts"):
            found += np.frombuffer(counts.as_buffer(), "<u2") > 0
        return pa.table({"n": [table.num_rows], "present": [found.tobytes()]})

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        present = sum(np.frombuffer(raw.as_buffer(), "<i8") for raw in table.column("present"))
        return pa.table({"n": [sum(table.column("n").to_pylist())], "present": [present.tobytes()]})

    counted = sample.groupBy("lang").applyInArrow(presence, "n bigint, present binary")
    parts = counted.groupBy(F.pmod(F.xxhash64("present"), F.lit(_SUM_PARTS))).applyInArrow(added, "n bigint, present binary")
    found = parts.toArrow().to_pylist()  # _SUM_PARTS rows at most
    if not found:
        return None
    total = sum(r["n"] for r in found)
    idf = np.log((1 + total) / (1 + sum(np.frombuffer(r["present"], "<i8") for r in found))) + 1

    def cluster(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("counts").to_pylist(), table.column("size").to_pylist(), strict=True))
        counts, sizes = [r[0] for r in rows], np.array([r[1] for r in rows])
        x = np.empty((len(rows), DIMENSIONS), np.float32)
        for row, raw in zip(x, counts, strict=True):
            row[:] = np.frombuffer(raw, "<u2")
        weights = idf.astype(np.float32)
        x = _vectors(x, weights)
        sums, own = _clusters(x, centroids, 0)
        made = _joined(x, counts, sizes, sums, own, weights)
        del x
        release()
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * len(sums), pa.string()),
                "sums": [r.astype("<f4").tobytes() for r in sums],
                "joined": pa.array([made if j == 0 else {"band": [], "cosine": []} for j in range(len(sums))], _JOINED),
            }
        )

    schema = "lang string, sums binary, joined struct<band:array<int>,cosine:array<double>>"
    fitted = written(sample.groupBy("lang").applyInArrow(cluster, schema), "centroids")
    names = sorted(r["lang"] for r in fitted.select("lang").distinct().toArrow().to_pylist())
    blocks = [(names[k], names[min(k + at_once, len(names)) - 1]) for k in range(0, len(names), at_once)]

    def windows(block):
        languages, sums = _centroids(fitted, block)
        places: dict[str, list[int]] = {}
        for i, lang in enumerate(languages):
            places.setdefault(lang, []).append(i)
        shared = labelled.sparkSession.sparkContext.broadcast((sums, places, idf))

        def window(batch):
            sums, places, idf = shared.value
            made = {"lang": [], "band": [], "cosine": []}
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
                pieces = _windows(text)
                if not pieces:
                    continue
                whole = _vectors(counts_of(text)[None], idf)[0]
                held = sums[places[lang]]
                held[(_unit(held) @ whole).argmax()] -= whole
                cosines = _held_out(_vectors(np.array([counts_of(w) for w in pieces.values()]), idf), held)
                if len(cosines):
                    made["lang"].extend([lang] * len(pieces))
                    made["band"].extend(pieces)
                    made["cosine"].extend(cosines.tolist())
            if made["lang"]:
                yield made

        found = in_batches(texts.where(F.col("lang").between(*block)), window, "lang string, band int, cosine double")
        return found if len(blocks) == 1 else written(found, "cosines")

    joined = fitted.select("lang", F.explode(F.arrays_zip("joined.band", "joined.cosine")).alias("j")).select("lang", "j.band", "j.cosine")
    cosines = reduce(DataFrame.unionByName, map(windows, blocks), joined)
    quantiles = cosines.groupBy("lang", "band").agg(F.percentile("cosine", F.lit(0.5)).alias("middle"), F.percentile("cosine", F.lit(REJECT_LOW)).alias("low"))
    # one row of numbers for each language and band
    limits = _limits(names, {(r["lang"], r["band"]): (r["middle"], r["low"]) for r in quantiles.toArrow().to_pylist()})
    return LanguageModel(fitted, idf, dict(zip(names, limits, strict=True)), blocks)


def _judged(batch: pa.RecordBatch, model: CentroidModel | None, earlier: bool) -> pa.StructArray:
    """What `model` finds for each text, or what the blocks before it found (last column) if that is as near."""
    raw = text_bytes(batch)
    found = model.judge(raw) if model is not None else ([UNDETERMINED] * len(raw), np.zeros(len(raw)), [True] * len(raw))
    if earlier:
        rows = zip(batch.column(batch.num_columns - 1).to_pylist(), *found, strict=True)
        rows = [(x["lang_pred"], x["score"], x["rejected"]) if x["score"] >= score else (lang, score, no) for x, lang, score, no in rows]
        found = tuple(zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)], ["lang_pred", "score", "rejected"])


def _with_earlier(docs: DataFrame, model: LanguageModel | None) -> tuple[DataFrame, Broadcast, bool]:
    """`docs` with what all blocks but the last find, in a last column if there are several; the last block."""
    context, number, schema = docs.sparkSession.sparkContext, 0, docs.schema
    name = next(n for n in (f"found_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    schema = StructType([*schema.fields, StructField(name, StructType.fromDDL("lang_pred string, score double, rejected boolean"))])
    for number in range(len(model.blocks) - 1) if model is not None else ():
        docs = written(_pass(docs, context.broadcast(model.block(number)), schema, number), "languages")
    several = model is not None and len(model.blocks) > 1
    return docs, context.broadcast(model.block(len(model.blocks) - 1) if model is not None else None), several


def _pass(docs: DataFrame, shared: Broadcast, schema: StructType, number: int) -> DataFrame:
    def run(batches):
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            found = _judged(batch, shared.value, number > 0)
            yield pa.RecordBatch.from_arrays([*(batch.columns[:-1] if number else batch.columns), found], names=schema.names)
        release()

    return map_batches(docs, run, schema)


def without_rejected(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of `docs`, whole, whose text (column text) is not rejected."""
    names = docs.columns
    rows, shared, several = _with_earlier(docs, model)

    def run(batches):
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            kept = pc.invert(_judged(batch, shared.value, several).field("rejected"))
            columns = batch.columns[:-1] if several else batch.columns
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(kept)
        release()

    return map_batches(rows, run, docs.schema)


def identify(docs: DataFrame, model: LanguageModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected (the cosine is under
    the limit of the language for a text of its bytes) of every row.

    A null text, a text without a letter, and any text without a model is `und` with score 0 and is rejected.
    Ties go to the language that sorts first; repeated rows are scored one by one; a null id stays null; other
    columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows, shared, several = _with_earlier(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), model)

    def step(batch):
        found = _judged(batch, shared.value, several)
        yield {"doc_id": batch.column(0)} | {c: found.field(c) for c in ("lang_pred", "score", "rejected")}

    return in_batches(rows, step, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
