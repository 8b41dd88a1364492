"""Quality classifier (1): zstandard dictionaries of good and of bad text.

A text that resembles good text compresses better with the dictionary of good text. Texts are compressed in
pieces, so that their end counts as much as their beginning. The difference of both sizes, over the uncompressed
size, becomes a score by a logistic curve fitted on labelled texts that are in neither dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinweir.llm.common import in_batches, may_be_among_first, text_bytes, written

SAMPLE_ROWS = 2_000  # labelled rows of each label that are used
SAMPLE_BYTES = 6_000  # of each of them in a dictionary, from places all over it: a document gives no more than its share
CUT_BYTES = 256  # a dictionary is filled with cuts of this size
DICTIONARY_BYTES = 512 << 10
PIECE_BYTES = 1_024
PRIOR_BYTES = 128
LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    shift: float = 0.0
    middle: float = 0.0  # mean difference of labelled texts

    def compressors(self):
        import zstandard as z

        options = z.ZstdCompressionParameters.from_level(LEVEL, dict_size=DICTIONARY_BYTES, write_content_size=False, write_dict_id=False)
        make = lambda raw: z.ZstdCompressor(
            dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=options
        )
        return make(self.good), make(self.bad)

    def judge(self, raw: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Difference and score of each text."""
        good, bad = self.compressors()
        x = np.array([difference(t or b"", good, bad, self.middle) for t in raw])
        return x, 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30)))


def difference(text: bytes, good, bad, middle: float = 0.0) -> float:
    """(size with the bad dictionary - size with the good one) / bytes.

    A few bytes say little, so every text gets PRIOR_BYTES of middling text for free; an empty one has just those.
    """
    return (PRIOR_BYTES * middle + saved(text, good, bad)) / (len(text) + PRIOR_BYTES)


def saved(text: bytes, good, bad) -> int:
    """Size with the bad dictionary - size with the good one, of the whole text in pieces."""
    pieces = (text[k : k + PIECE_BYTES] for k in range(0, len(text), PIECE_BYTES))
    return sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces)


def cuts(text: bytes) -> list[tuple[int, bytes]]:
    """Place and bytes of cuts of a text, all of them or SAMPLE_BYTES, in an order drawn by a hash of the text."""
    from xxhash import xxh3_64_intdigest

    rng = np.random.default_rng(xxh3_64_intdigest(text))
    places = rng.permutation(-(-len(text) // CUT_BYTES))[: -(-SAMPLE_BYTES // CUT_BYTES)] * CUT_BYTES
    return [(int(k), text[k : k + CUT_BYTES]) for k in places]


def _dictionary(texts: list[list[tuple[int, bytes]]]) -> bytes:
    """A first cut of each text, then a second one and so on until it is full; those of a text stay together."""
    chosen: list[tuple[int, int, bytes]] = []
    total = 0
    for turn in range(max(map(len, texts), default=0)):
        for i, made in enumerate(texts):
            if turn < len(made) and total < DICTIONARY_BYTES:
                chosen.append((i, *made[turn]))
                total += len(made[turn][1]) + 1
    return b"\n".join(c for *_, c in sorted(chosen))[:DICTIONARY_BYTES].ljust(8, b"\n")


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve, by Newton steps."""
    scale = x.std() or 1.0
    design, beta = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 1e-3 * beta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta += np.clip(np.linalg.solve(curve, gradient), -5, 5)
    return float(beta[0] / scale), float(beta[1])


def calibrate(model: QualityModel, saved: np.ndarray, sizes: np.ndarray, y: np.ndarray, share: dict[int, float]) -> QualityModel:
    """Mean and curve from what is saved on labelled texts of these sizes; `share` is how often a label is met."""
    w = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum()) * len(y)
    model.middle = float(np.average(saved / (sizes + PRIOR_BYTES), weights=w))
    model.slope, model.shift = _logistic((PRIOR_BYTES * model.middle + saved) / (sizes + PRIOR_BYTES), y, w)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality"
) -> QualityModel | None:
    """Fit on at most `rows` labelled rows of each label, chosen by a hash of the id.

    Every second of them goes into the dictionaries, by cuts from places all over the text; the others calibrate and
    are compressed as a whole in the tasks that read them. Rows with a null label, id or text teach nothing; with one
    label only there is no model.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    marked = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label"))
        .where("label IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")  # an id marked both ways says nothing
    )
    share = {r["label"]: float(r["count"]) for r in marked.groupBy("label").count().collect()}  # two rows
    size = F.coalesce(*[F.when(F.col("label") == label, n) for label, n in share.items()], F.lit(0.0))
    likely = marked.where(may_be_among_first(F.col("doc_id"), rows, size))
    chosen = likely.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows).select("doc_id", "label", "place")
    chosen = written(chosen, "chosen")
    texts = (
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # 2 x rows at most
        .where("text IS NOT NULL")
        .select("label", "place", "text")
    )

    def cut(batch):
        made = {"label": batch.column(0), "place": batch.column(1), "at": [], "cut": []}
        for text in text_bytes(batch):
            found = cuts(text)
            made["at"].append([k for k, _ in found])
            made["cut"].append([c for _, c in found])
        yield made

    def compress(batch):
        raw, (good, bad) = text_bytes(batch), shared.value.compressors()
        yield {"label": batch.column(0), "saved": [saved(t, good, bad) for t in raw], "size": [len(t) for t in raw]}

    # SAMPLE_BYTES of each text at most
    first = in_batches(texts.where("place % 2 = 1"), cut, "label int, place int, at array<int>, cut array<binary>").toArrow().to_pylist()
    first.sort(key=lambda r: (r["place"], r["label"], r["at"], r["cut"]))
    parts = [[list(zip(r["at"], r["cut"], strict=True)) for r in first if r["label"] == label] for label in (1, 0)]
    if not all(parts):
        return None
    model = QualityModel(*map(_dictionary, parts))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    second = in_batches(texts.where("place % 2 = 0"), compress, "label int, saved bigint, size bigint").toArrow().to_pylist()
    second.sort(key=lambda r: (r["label"], r["saved"], r["size"]))
    if {r["label"] for r in second} != {0, 1}:
        return None
    return calibrate(model, *(np.array([r[k] for r in second], float) for k in ("saved", "size", "label")), share)


def score(docs: DataFrame, model: QualityModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, difference, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    A null or empty text has the mean difference of labelled texts; without a model every score is 0.5.
    Repeated rows are scored one by one; a null id stays null; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    kind = docs.schema[id_column].dataType.simpleString()

    def step(batch):
        model, raw = shared.value, text_bytes(batch)
        x, p = model.judge(raw) if model is not None else (np.zeros(len(raw)), np.full(len(raw), 0.5))
        yield {"doc_id": batch.column(0), "difference": x, "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return in_batches(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")),
        step,
        f"doc_id {kind}, difference double, score double, predicted int",
    )
