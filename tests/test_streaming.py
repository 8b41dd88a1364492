import datetime

from pyspark.sql import functions as F

from catalog import streams
from coinweir.session import fresh_path
from coinweir.streaming import jobs as J

SCHEMA = "id long, user_id string, amount double, created_at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def stream_of(spark, *batches):
    """One file per batch, read one file at a time, oldest first."""
    import time

    folder = fresh_path(spark, "stream")
    for rows in batches:
        df = spark.createDataFrame([(i, u, a, T0 + datetime.timedelta(hours=h)) for i, u, a, h in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are ordered by modification time
    return J.file_stream(spark, folder, df.schema, files_per_batch=1)


def test_dedup_within_the_delay(spark):
    first = [(1, "u", 5.0, 0), (2, "u", 5.0, 1), (3, "v", 5.0, 1)]
    second = [(4, "u", 5.0, 2), (5, "w", 1.0, 200)]  # moves the watermark far ahead
    third = [(6, "u", 5.0, 201), (7, "u", 5.0, 3)]  # a new charge, and a row behind the watermark
    out = J.drain(J.stream_dedup(stream_of(spark, first, second, third), ["user_id", "amount"], delay="6 hours"), "dedup")
    ids = sorted(r.id for r in out.collect())
    assert len(ids) == 4 and {3, 5, 6} <= set(ids) and (1 in ids or 2 in ids)


def test_sessions_and_windows_match_batch(spark):
    rows = [(i, "u", 1.0, h) for i, h in enumerate([0, 0.2, 0.4, 0.6, 5, 5.1, 9])]
    late_end = [(99, "z", 1.0, 24 * 40)]
    sessions = J.drain(J.stream_burst_sessions(stream_of(spark, rows, late_end), ["user_id"], min_rows=2), "s").orderBy("session_start").collect()
    assert [(s.n_rows, s.total) for s in sessions] == [(4, 4.0), (2, 2.0)]
    windows = J.drain(J.stream_freq_windows(stream_of(spark, rows, late_end), ["user_id"]), "w")
    assert windows.where("user_id = 'u'").count() == 7
    assert windows.where("user_id = 'u'").agg(F.max("n_rows"), F.min("n_rows")).first()[:] == (7, 7)


FOLDER = "/root/testdata/sf0.001"


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _batch(spark, job, number):
    """The events of a batch of the import stream."""
    events = spark.read.schema(streams.schemas.EVENTS).parquet(f"{FOLDER}/events.parquet")
    return events.where(streams._arrival() == number)


def test_import_stream_is_idempotent(spark):
    job = streams.import_stream(spark, FOLDER)
    tables = {"transactions": ("id", "upload_id", "row_no", "merchant", "batch"), "late": ("row_no", "batch"), "cache": ("user_id", "normalized_merchant", "confidence"), "recent": ("user_id", "recent")}
    before = {name: _rows(job.read(spark, name), *columns) for name, columns in tables.items()}
    last = max(r[4] for r in before["transactions"])
    for _ in range(2):
        job(_batch(spark, job, last), last)  # the same batch again, as after a lost driver
    assert {name: _rows(job.read(spark, name), *columns) for name, columns in tables.items()} == before
    assert before["late"]


def test_later_batches_number_on_and_see_the_state_only(spark):
    job = streams.import_stream(spark, FOLDER)
    spans = job.read(spark, "transactions").groupBy("batch").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).orderBy("batch").collect()
    assert len(spans) == 4
    for a, b in zip(spans, spans[1:]):
        assert b.low == a.high + 1 and b.high - b.low + 1 == b.n
    touched = job.recent.touched(_event_rows_of(_batch(spark, job, 3)))
    read = job.recent.read(spark, 3, touched).inputFiles()
    assert read and all(any(f"bucket={b}/" in f for b in touched) for f in read)


def _event_rows_of(events):
    return streams._event_rows(events)


def test_session_setting_is_put_back(spark):
    rows = [(i, "u", 1.0, h) for i, h in enumerate([0, 0.2, 900])]
    key = next(iter(J.MERGE_SESSIONS_FIRST))
    before = spark.conf.get(key)
    assert J.drain(J.stream_burst_sessions(stream_of(spark, rows), ["user_id"], min_rows=2), "s", J.MERGE_SESSIONS_FIRST).count() == 1
    assert spark.conf.get(key) == before


def test_windows_count_rows_once(spark):
    rows = [(i, "u", 1.0, 24 * (i % 10) + 0.1 * (i % 7)) for i in range(300)]
    end = [(999, "z", 1.0, 24 * 60)]
    out = J.drain(J.stream_freq_windows(stream_of(spark, rows, end), ["user_id"]), "w").where("user_id = 'u'")
    assert out.agg(F.sum("n_rows"), F.max("n_rows"), F.count("*")).first()[:] == (7 * 300, 210, 16)


def test_inputs_of_the_import_stream_are_built_once(spark):
    job = streams.import_stream(spark, FOLDER)
    for table in (job.uploads, job.answers):  # every batch asks them: they are tables, not the queries that build them
        assert "Aggregate" not in table._jdf.queryExecution().optimizedPlan().toString()
