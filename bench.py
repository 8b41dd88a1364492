"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from catalog import statements as CS  # noqa: E402
from catalog import tables as T  # noqa: E402
from catalog.features import _lineitem_rows  # noqa: E402
from coinweir.functions.text import normalize_merchant  # noqa: E402
from coinweir.operators import anomaly, detectors, features, reports  # noqa: E402
from coinweir.plans import statements  # noqa: E402
from coinweir.session import build_session  # noqa: E402

HEADLINE = {
    "engineer_features": lambda s, d: features.engineer_features(
        _lineitem_rows(s, d).withColumn("transaction_id", F.col("amount")), "transaction_id"
    ),
    "category_breakdown": lambda s, d: reports.category_breakdown(
        T.txn_lineitem(s, d).withColumn("category_id", F.col("category_name")).withColumn("id", F.col("amount"))
    ),
    "anomaly_safeguards": lambda s, d: anomaly.anomaly_safeguards(*_split(s, d)),
    "normalize_merchant": lambda s, d: T.raw_merchants(s, d).select(normalize_merchant("raw").alias("key")),
    "parse_text_lines": lambda s, d: statements.parse_text_lines(CS.typed(CS.plain_lines(s, d)), CS.REF_YEAR),
    "dashboard_totals": lambda s, d: reports.dashboard_totals(T.txn_lineitem(s, d)),
    "det_velocity": lambda s, d: detectors.velocity(T.txn_events(s, d), 4, 2, 1440),
}


def _split(spark, folder):
    from catalog.anomaly import split

    return split(T.txn_events(spark, folder))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, query in HEADLINE.items():
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
