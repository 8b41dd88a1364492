"""Encoding, scaling, splitting, training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coinweir.functions import fixed_values as V
from coinweir.operators import anomaly as A
from coinweir.operators.reports import binary_metrics
from coinweir.plans.skew import sorted_index
from coinweir.session import cut_lineage

CELL_BITS = (51, 39)  # 4,096 cells of all hashes, then 4,096 of the one at the cut

PART_ROWS = 100_000  # training rows that one task keeps in memory: 35 MB or so with the draws of 50 trees

FEATURES = [*V.NUMERIC_FEATURES, *[f"{name}_enc" for name in V.CATEGORICAL_FEATURES]]


def _label(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(V.UNKNOWN_LABEL))


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(label, code): distinct labels and the unseen label in binary order, coded from 0.

    The order comes from a range-partitioned sort, so a column with many labels is no single task.
    """
    labels = df.select(_label(column).alias("label")).distinct()
    unseen = df.sparkSession.range(1).select(F.lit(V.UNSEEN_LABEL).alias("label"))
    return sorted_index(labels.unionByName(unseen).distinct(), ["label"], "code")


def encode_join(df: DataFrame, dictionary: DataFrame, column: str, row_id: str) -> DataFrame:
    """`<column>_enc`: a label's code, or the code of the unseen label."""
    unseen = dictionary.where(F.col("label") == V.UNSEEN_LABEL).select("code").scalar()
    lookup = dictionary.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
    labelled = df.withColumn("_label", _label(column))
    joined = labelled.join(lookup, "_label", "left")  # Spark picks the join by measured bytes and splits hot labels
    return joined.withColumn(f"{column}_enc", F.coalesce("_code", unseen).cast("bigint")).drop("_label", "_code")


def scale_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of every column."""
    return df.agg(
        *[F.avg(name).alias(f"{name}_mean") for name in columns],
        *[F.stddev_pop(name).alias(f"{name}_std") for name in columns],
    )


def standard_scale(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a column without spread is only centred."""

    def stat(name: str) -> Column:
        return stats.select(name).scalar()

    def scaled(name: str) -> Column:
        spread = F.coalesce(F.nullif(stat(f"{name}_std"), F.lit(0.0)), F.lit(1.0))
        return F.coalesce((F.col(name) - stat(f"{name}_mean")) / spread, F.lit(0.0))  # a missing value is an average one

    return df.withColumns({name: scaled(name) for name in columns})


def stratified_split(df: DataFrame, label: str, row_id: str, test_share: float = 0.2, seed: int = V.SEED) -> DataFrame:
    """Adds `in_test`: exactly round(share x n) rows of every class, drawn by a seeded hash of the row id.

    All that is sought is the last hash of each class that is still in. Counts of hash cells lead to the cell that
    holds it, twice over, and only the rows of that cell are ranked; the rows themselves are never shuffled. `df` is
    read four times. Rows without a label are left out.
    """
    labelled = df.where(F.col(label).isNotNull()).withColumn(
        "_hash", F.shiftrightunsigned(F.xxhash64(F.col(row_id), F.lit(seed)), 1)
    )
    sizes = labelled.groupBy(label).agg(F.round(F.count(F.lit(1)) * test_share).cast("bigint").alias("_left"))
    place = labelled.select(label, row_id, "_hash").join(F.broadcast(sizes), label)  # one row per class
    for bits in CELL_BITS:
        cells = place.groupBy(label, "_left", F.shiftright("_hash", bits).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        below = F.sum("_n").over(Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        cut = (
            cells.withColumn("_below", F.coalesce(below, F.lit(0)))
            .where((F.col("_below") < F.col("_left")) & (F.col("_left") <= F.col("_below") + F.col("_n")))
            .select(label, "_cell", (F.col("_left") - F.col("_below")).alias("_left"))
        )
        inside = place.drop("_left").withColumn("_cell", F.shiftright("_hash", bits))
        place = inside.join(F.broadcast(cut), [label, "_cell"]).drop("_cell")  # one row per class
    position = F.struct(F.col("_hash"), F.col(row_id).alias("_id"))
    in_order = Window.partitionBy(label).orderBy("_hash", row_id)
    last = place.withColumn("_rank", F.row_number().over(in_order)).where(F.col("_rank") == F.col("_left"))
    last = cut_lineage(last.select(label, position.alias("_last")))
    drawn = labelled.join(F.broadcast(last), label, "left")  # one row per class
    return drawn.withColumn("in_test", F.coalesce(position <= F.col("_last"), F.lit(False))).drop("_hash", "_last")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """`weight` = n / (classes x rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("t")).scalar()
    classes = sizes.agg(F.count(F.lit(1)).alias("c")).scalar()
    weights = sizes.select(label, (total / (classes * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)  # one row per class


@dataclass
class Preprocessor:
    """Dictionaries and scaling fitted on training rows only; both are small written tables."""

    dictionaries: dict[str, DataFrame]
    stats: DataFrame

    def encode(self, df: DataFrame, row_id: str) -> DataFrame:
        for name, dictionary in self.dictionaries.items():
            df = encode_join(df, dictionary, name, row_id)
        return df

    def transform(self, df: DataFrame, row_id: str = "transaction_id") -> DataFrame:
        return self.scale(self.encode(df, row_id))

    def scale(self, encoded: DataFrame) -> DataFrame:
        scaled = standard_scale(encoded, self.stats, FEATURES)
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scaled)


def fit_preprocessor(split: DataFrame, row_id: str = "transaction_id") -> tuple[Preprocessor, DataFrame]:
    """(what the training rows teach, all rows encoded): the joins with the dictionaries are made and written once."""
    dictionaries = {name: label_dictionary(split.where(~F.col("in_test")), name) for name in V.CATEGORICAL_FEATURES}
    encoded = cut_lineage(Preprocessor(dictionaries, split).encode(split, row_id))
    stats = scale_stats(encoded.where(~F.col("in_test")), FEATURES)
    return Preprocessor(dictionaries, cut_lineage(stats)), encoded


def train_forest(train: DataFrame, label: str = "is_anomaly") -> RandomForestClassificationModel:
    """Forest over `features` and `weight`."""
    return RandomForestClassifier(
        numTrees=V.FOREST_TREES,
        maxDepth=V.FOREST_DEPTH,
        minInstancesPerNode=V.FOREST_MIN_LEAF,
        weightCol="weight",
        featuresCol="features",
        labelCol=label,
        seed=V.SEED,
    ).fit(train)


def anomaly_probability() -> Column:
    return vector_to_array("probability")[1]


def predict(model: RandomForestClassificationModel, rows: DataFrame, threshold: float) -> DataFrame:
    return (
        model.transform(rows)
        .withColumn("anomaly_probability", anomaly_probability())
        .withColumn("y_pred", (F.col("anomaly_probability") >= threshold).cast("int"))
        .drop("rawPrediction", "probability", "prediction")
    )


def feature_importance(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """Importances by feature, largest first; as many rows as the model has features."""
    pairs = [(name, float(value)) for name, value in zip(FEATURES, model.featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass
class TrainedModel:
    preprocessor: Preprocessor
    forest: RandomForestClassificationModel
    test: DataFrame
    version: str = "spark_forest_v1"

    def save(self, folder: str) -> None:
        """Write dictionaries, scaling, forest and test rows under `folder`, which must be new."""
        for name, dictionary in self.preprocessor.dictionaries.items():
            dictionary.write.parquet(f"{folder}/dictionary_{name}")
        self.preprocessor.stats.write.parquet(f"{folder}/scaling")
        self.test.write.parquet(f"{folder}/test")
        self.forest.write().save(f"{folder}/forest")

    def scorer(self, threshold: float = V.SCORING_THRESHOLD) -> Callable[[DataFrame, DataFrame], DataFrame]:
        return lambda batch, history: score_batch(batch, history, self, threshold)


def load_model(spark: SparkSession, folder: str) -> TrainedModel:
    """The model that `TrainedModel.save` wrote under `folder`."""
    dictionaries = {name: spark.read.parquet(f"{folder}/dictionary_{name}") for name in V.CATEGORICAL_FEATURES}
    preprocessor = Preprocessor(dictionaries, spark.read.parquet(f"{folder}/scaling"))
    forest = RandomForestClassificationModel.load(f"{folder}/forest")
    return TrainedModel(preprocessor, forest, spark.read.parquet(f"{folder}/test"))


def in_parts(rows: DataFrame, row_id: str, size: int = PART_ROWS) -> DataFrame:
    """Rows by hash of their id in parts of about `size`, whose number grows with the rows; few rows stay as they are."""
    n = rows.count()
    if n <= size:
        return rows
    return rows.repartition(max(-(-n // size), rows.sparkSession.sparkContext.defaultParallelism), row_id)


def train(features: DataFrame, label: str = "is_anomaly", row_id: str = "transaction_id") -> TrainedModel:
    """Split, fit on the training part only, train. The features are written once, and once more with their codes."""
    split = stratified_split(cut_lineage(features), label, row_id)
    preprocessor, encoded = fit_preprocessor(split, row_id)
    train_rows, test_rows = encoded.where(~F.col("in_test")), encoded.where(F.col("in_test"))
    weighted = balanced_weights(preprocessor.scale(train_rows), label)
    forest = train_forest(cut_lineage(in_parts(weighted, row_id).select("features", "weight", label)), label)
    return TrainedModel(preprocessor, forest, preprocessor.scale(test_rows))


def evaluate_model(model: TrainedModel, threshold: float = V.EVALUATION_THRESHOLD, label: str = "is_anomaly") -> DataFrame:
    return binary_metrics(predict(model.forest, model.test, threshold), label, "y_pred")


def score_batch(batch: DataFrame, history: DataFrame, model: TrainedModel, threshold: float = V.SCORING_THRESHOLD) -> DataFrame:
    """Safeguards first; only rows they leave open get features and reach the forest."""
    result = ["transaction_id", "user_id", "is_anomaly", "anomaly_status", "confidence", "reason", "model_version"]
    # The history ends here: what is written and read by both branches holds the features instead.
    guarded = cut_lineage(A.features_against_history(A.anomaly_safeguards(batch, history)).drop("history"))
    settled = guarded.where(F.col("anomaly_status").isNotNull()).select(
        "transaction_id",
        "user_id",
        F.lit(False).alias("is_anomaly"),
        "anomaly_status",
        F.lit(0.0).alias("confidence"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("string").alias("model_version"),
    )
    open_rows = guarded.where(F.col("anomaly_status").isNull())
    # The scaled columns replace the features, so the sentence is written before scaling.
    told = open_rows.withColumn("_sentence", A.anomaly_reason())
    scored = predict(model.forest, model.preprocessor.transform(told), threshold).withColumn(
        "is_anomaly", F.col("y_pred") == 1
    )
    judged = scored.select(
        "transaction_id",
        "user_id",
        "is_anomaly",
        F.when(F.col("is_anomaly"), "confirmed_anomaly").otherwise("normal").alias("anomaly_status"),
        F.round("anomaly_probability", 4).alias("confidence"),
        F.when(F.col("is_anomaly"), F.col("_sentence")).alias("reason"),
        F.lit(model.version).alias("model_version"),
    )
    return settled.select(*result).unionByName(judged.select(*result))
