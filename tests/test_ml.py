import pytest
from pyspark.sql import functions as F

from catalog import anomaly as CA
from catalog import ml as CM
from catalog import tables as T
from coinweir.functions import fixed_values as V
from coinweir.plans import ml as M
from coinweir.session import fresh_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return CM.trained(spark, FOLDER)


def test_split_is_exact_and_repeatable(spark):
    rows = CM.labelled(spark, FOLDER)
    picked = lambda: {r.transaction_id for r in M.stratified_split(rows.repartition(3), "is_anomaly", "transaction_id").where("in_test").collect()}
    first = picked()
    assert first == picked()
    sizes = {r.is_anomaly: r["count"] for r in rows.groupBy("is_anomaly").count().collect()}
    assert len(first) == sum(int(n * 0.2 + 0.5) for n in sizes.values())


def test_dictionary_order_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("B",), ("~",), (None,), ("b",)], "c string")
    codes = {r.label: r.code for r in M.label_dictionary(df, "c").collect()}
    assert codes == {"B": 0, "__unseen__": 1, "b": 2, "unknown": 3, "~": 4}
    new = spark.createDataFrame([(1, "b"), (2, "new"), (3, None)], "id long, c string")
    got = {r.id: r.c_enc for r in M.encode_join(new, M.label_dictionary(df, "c"), "c", "id").collect()}
    assert got == {1: 2, 2: 1, 3: 3}


def test_scaling_without_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = M.standard_scale(df, M.scale_stats(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_weights_balance(spark):
    w = M.balanced_weights(CM.labelled(spark, FOLDER), "is_anomaly").groupBy("is_anomaly").agg(F.sum("weight").alias("w")).collect()
    assert abs(w[0].w - w[1].w) < 1e-6


def test_forest_learns(spark, model):
    metrics = M.evaluate_model(model).first()
    assert metrics.recall > 0.8 and metrics.accuracy > 0.8  # the label is a threshold on the amount
    importance = M.feature_importance(spark, model.forest).collect()
    assert len(importance) == 13 and abs(sum(r.importance for r in importance) - 1) < 1e-6


def test_a_saved_model_scores_the_same(spark, model):
    folder = fresh_path(spark, "saved")
    model.save(folder)
    rows = lambda m: {r.transaction_id: r.anomaly_probability for r in M.predict(m.forest, m.test, 0.5).collect()}
    assert rows(M.load_model(spark, folder)) == rows(model)


def test_split_of_small_classes_and_null_labels(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 1), *((i, 2) for i in range(10, 20)), (99, None)], "id long, y int")
    got = {r.y: (r.n, r.t) for r in M.stratified_split(rows, "y", "id").groupBy("y").agg(F.count("*").alias("n"), F.count_if("in_test").alias("t")).collect()}
    assert got == {0: (2, 0), 1: (1, 0), 2: (10, 2)}
    assert M.stratified_split(rows.limit(0), "y", "id").count() == 0


def test_scores(spark, model):
    batch, history = CA.split(T.txn_events(spark, FOLDER))
    rows = M.score_batch(batch, history, model).collect()
    assert len(rows) == batch.count() and len({r.transaction_id for r in rows}) == len(rows)
    for r in rows:
        if r.model_version is None:
            assert not r.is_anomaly and r.confidence == 0.0 and r.anomaly_status in ("normal", "insufficient_history")
        else:
            assert r.is_anomaly == (r.confidence >= V.SCORING_THRESHOLD) and (r.reason is not None) == r.is_anomaly
    assert any(r.is_anomaly for r in rows)


def test_training_parts_grow_with_the_rows(spark):
    many = M.in_parts(spark.range(0, 3000, 1, 1).withColumnRenamed("id", "transaction_id"), "transaction_id", 100)
    sizes = [r.n for r in many.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) == 30 and max(sizes) < 200
    few = spark.range(0, 100, 1, 1).withColumnRenamed("id", "transaction_id")
    assert M.in_parts(few, "transaction_id", 100) is few
