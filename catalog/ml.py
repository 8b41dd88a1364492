"""Encoding, scaling, split, forest and scoring."""

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.anomaly import AGAINST, RULE, SIDES, split
from catalog.book import enter
from coinweir.functions import fixed_values as V
from coinweir.operators import anomaly as A
from coinweir.operators import features as X
from coinweir.plans import ml as M
from coinweir.session import fresh_path


def labelled(s, d):
    return T.labelled(s, d).withColumn("transaction_id", F.col("transaction_id").cast("bigint"))


DICTIONARY = """dict AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT {0} AS label FROM txn {1} UNION SELECT '__unseen__'))"""
enter(
    "label_encode_fit",
    lambda s, d: M.label_dictionary(labelled(s, d), "user_id"),
    f"WITH {T.TXN_EVENTS}, {DICTIONARY.format('user_id', '')} SELECT label, code FROM dict",
)
enter(
    "encode_join",
    lambda s, d: M.encode_join(labelled(s, d), M.label_dictionary(labelled(s, d).where("category <> 'view'"), "category"), "category", "transaction_id").select(
        "transaction_id", "category_enc"
    ),
    f"""WITH {T.TXN_EVENTS}, {DICTIONARY.format('category_name', "WHERE category_name <> 'view'")}
      SELECT id AS transaction_id, coalesce(code, (SELECT code FROM dict WHERE label = '__unseen__')) AS category_enc FROM txn LEFT JOIN dict ON label = category_name""",
)


def _scaled(s, d):
    rows = labelled(s, d).withColumn("log_amount", F.log1p("amount")).withColumn("flat", F.lit(3.0))
    columns = ["amount", "log_amount", "flat"]
    return M.standard_scale(rows, M.scale_stats(rows, columns), columns).select("transaction_id", *[F.round(c, 6).alias(c) for c in columns])


enter(
    "standard_scale",
    _scaled,
    f"""WITH {T.TXN_EVENTS} SELECT id AS transaction_id, round((amount - avg(amount) OVER ()) / stddev_pop(amount) OVER (), 6) AS amount,
      round((ln(1 + amount) - avg(ln(1 + amount)) OVER ()) / stddev_pop(ln(1 + amount)) OVER (), 6) AS log_amount, CAST(0.0 AS DOUBLE) AS flat FROM txn""",
)
enter(
    "stratified_split",
    lambda s, d: M.stratified_split(labelled(s, d), "is_anomaly", "transaction_id").groupBy("is_anomaly").agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.col("in_test"), 1)).alias("n_test")
    ),
    f"WITH {T.LABELLED} SELECT is_anomaly, count(*) AS n_rows, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM labelled GROUP BY 1",
)
enter(
    "balanced_weights",
    lambda s, d: M.balanced_weights(labelled(s, d), "is_anomaly").select("transaction_id", F.round("weight", 9).alias("weight")),
    f"""WITH {T.LABELLED} SELECT CAST(transaction_id AS BIGINT) AS transaction_id, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY is_anomaly)), 9) AS weight FROM labelled""",
)


_MODELS: dict[tuple[str, str], str] = {}


def trained(s, d):
    """The model of a folder, trained and saved once in a session, then loaded by every query that needs it."""
    key = (s.sparkContext.applicationId, d)
    if key not in _MODELS:
        folder = fresh_path(s, "model")
        M.train(X.engineer_features(labelled(s, d))).save(folder)
        _MODELS[key] = folder
    return M.load_model(s, _MODELS[key])


def _predicted(s, d, threshold=V.EVALUATION_THRESHOLD):
    model = trained(s, d)
    return M.predict(model.forest, model.test, threshold)


enter("forest_predictions", lambda s, d: _predicted(s, d).select("transaction_id", "is_anomaly", "anomaly_probability", "y_pred"))
# A forest has no SQL; its test part does: exact sizes, each id once, a probability in [0, 1] that agrees with the decision.
enter(
    "train_forest",
    lambda s, d: _predicted(s, d).groupBy("is_anomaly").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("transaction_id").alias("n_ids"),
        F.count(
            F.when(F.col("anomaly_probability").between(0, 1) & (F.col("y_pred") == (F.col("anomaly_probability") >= V.EVALUATION_THRESHOLD).cast("int")), 1)
        ).alias("n_sound"),
    ),
    f"""WITH {T.LABELLED}, n AS (SELECT is_anomaly, CAST(round(count(*) * 0.2) AS BIGINT) AS n FROM labelled GROUP BY 1)
      SELECT is_anomaly, n AS n_rows, n AS n_ids, n AS n_sound FROM n WHERE n > 0""",
)
enter("model_metrics", lambda s, d: M.evaluate_model(trained(s, d)))


def _metrics_against_rows(s, d):
    """The metrics beside the same ones from the rows, both in one row."""
    hit = (F.col("is_anomaly") == 1) & (F.col("y_pred") == 1)
    plain = _predicted(s, d).agg(
        F.count("*").alias("n_test"),
        F.avg((F.col("is_anomaly") == F.col("y_pred")).cast("int")).alias("plain_accuracy"),
        (F.count(F.when(hit, 1)) / F.count(F.when(F.col("is_anomaly") == 1, 1))).alias("plain_recall"),
    )
    near = lambda name: F.abs(F.col(name) - F.col(f"plain_{name}")) < 1e-9
    both = M.evaluate_model(trained(s, d)).withColumn("one", F.lit(1)).join(plain.withColumn("one", F.lit(1)), "one")
    return both.select(
        "n_test", (near("accuracy") & near("recall")).alias("agrees"), ((F.col("accuracy") > 0.8) & (F.col("recall") > 0.8)).alias("learned")
    )


enter(
    "evaluate_model",
    _metrics_against_rows,
    f"""WITH {T.LABELLED}, n AS (SELECT CAST(round(count(*) * 0.2) AS BIGINT) AS n FROM labelled GROUP BY is_anomaly)
      SELECT CAST(sum(n) AS BIGINT) AS n_test, TRUE AS agrees, TRUE AS learned FROM n""",
)
enter("model_importance", lambda s, d: M.feature_importance(s, trained(s, d).forest))
enter(
    "feature_importance",
    lambda s, d: M.feature_importance(s, trained(s, d).forest).agg(
        F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("features"),  # as many as the model has
        F.round(F.sum("importance"), 6).alias("total"),
        F.count(F.when(F.col("importance") < 0, 1)).alias("n_negative"),
    ),
    f"""SELECT '{",".join(sorted(M.FEATURES))}' AS features, CAST(1.0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n_negative""",
)


def _scores(s, d):
    batch, history = split(T.txn_events(s, d))
    return M.score_batch(batch, history, trained(s, d))


enter("batch_scores", _scores)
enter(
    "score_batch",
    lambda s, d: _scores(s, d).select(
        "transaction_id",
        F.col("model_version").isNull().alias("settled"),
        F.when(F.col("model_version").isNull(), ~F.col("is_anomaly") & (F.col("confidence") == 0) & F.col("reason").isNull())
        .otherwise(
            (F.col("is_anomaly") == (F.col("anomaly_status") == "confirmed_anomaly"))
            & (F.col("is_anomaly") == F.col("reason").isNotNull())
            & F.when(F.col("is_anomaly"), F.col("confidence") >= V.SCORING_THRESHOLD).otherwise(F.col("confidence") <= V.SCORING_THRESHOLD)
        )
        .alias("agrees"),
    ),
    f"WITH {SIDES}, {AGAINST} SELECT transaction_id, {RULE} IS NOT NULL AS settled, TRUE AS agrees FROM facts",
)


def _settled(s, d):
    """What the safeguards settle, without any model."""
    rows = A.anomaly_safeguards(*split(T.txn_events(s, d))).where(F.col("anomaly_status").isNotNull())
    return rows.select("transaction_id", F.lit(False).alias("is_anomaly"), "anomaly_status", F.lit(0.0).alias("confidence"))


# What the safeguards settle does not depend on the forest.
enter(
    "score_batch_settled",
    _settled,
    f"""WITH {SIDES}, {AGAINST} SELECT transaction_id, FALSE AS is_anomaly, CASE WHEN {RULE} LIKE 'cold%' THEN 'insufficient_history' ELSE 'normal' END AS anomaly_status,
      CAST(0.0 AS DOUBLE) AS confidence FROM facts WHERE {RULE} IS NOT NULL""",
)
