"""Streams give what their batch forms give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parley.streaming import progress

SCHEMA = "meeting_id long, ts timestamp, stage string, progress double"


def events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(m, start + timedelta(seconds=0.7 * k + m), "transcribing" if k < 12 else "categorizing", (k % 12) / 10 - (0.3 if k == 5 else 0)) for m in range(3) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "events")), spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "events"))


def drained(spark, stream, name, mode, path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def test_throttled_progress(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    expected = sorted(map(tuple, progress.throttle_batch(batch).collect()), key=repr)
    assert 0 < len(expected) < batch.count()
    assert all(0 <= r[3] <= 1 for r in expected)
    assert drained(spark, progress.throttle_progress(stream), "throttled", "append", tmp_path / "c") == expected


def test_latest_status(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    expected = sorted(map(tuple, progress.latest_status(batch).collect()), key=repr)
    assert len(expected) == 3
    assert drained(spark, progress.latest_status(stream), "latest", "update", tmp_path / "c") == expected


def test_estimates(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    columns = ["meeting_id", "stage", "ts", "progress", "eta_seconds"]
    expected = sorted(map(tuple, progress.progress_eta(batch).select(columns).collect()), key=repr)
    assert any(r[4] is not None for r in expected) and any(r[4] is None for r in expected)
    assert drained(spark, progress.progress_eta_stream(stream).select(columns), "eta", "append", tmp_path / "c") == expected
    assert progress.clamp(batch).agg(F.min("progress")).first()[0] == 0


def parts(spark, tmp_path, batch):
    """The events as two files, the earlier half first, and a stream that sees only what has been written."""
    middle = batch.agg(F.percentile_approx("ts", 0.5)).first()[0]
    folder = tmp_path / "split"
    batch.where(F.col("ts") <= middle).coalesce(1).write.parquet(str(folder))
    later = batch.where(F.col("ts") > middle)
    return folder, later, lambda: spark.readStream.schema(SCHEMA).parquet(str(folder))


def test_a_stopped_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    batch, _ = events(spark, tmp_path)
    folder, later, stream = parts(spark, tmp_path, batch)
    for name, run, expected in (("throttled2", progress.throttle_progress, progress.throttle_batch(batch)), ("eta2", progress.progress_eta_stream, progress.progress_eta_batch(batch))):
        out, saved = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-c")
        for k in range(2):
            if k:
                later.coalesce(1).write.mode("append").parquet(str(folder))
            q = run(stream()).writeStream.format("parquet").option("path", out).option("checkpointLocation", saved).trigger(availableNow=True).start()
            assert q.awaitTermination(90)
        assert sorted(map(tuple, spark.read.parquet(out).select(expected.columns).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
        newest = max(folder.glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
        newest.unlink()  # the next stream begins with the earlier half again


def test_streams_begin_with_a_batch(spark, tmp_path):
    batch, _ = events(spark, tmp_path)
    folder, later, _ = parts(spark, tmp_path, batch)
    early = spark.read.schema(SCHEMA).parquet(str(folder))
    later.coalesce(1).write.parquet(str(tmp_path / "later"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "later"))
    columns = ["meeting_id", "stage", "ts", "progress", "eta_seconds"]
    middle = early.agg(F.max("ts")).first()[0]
    expected = progress.progress_eta(batch).where(F.col("ts") > middle).select(columns)
    assert drained(spark, progress.progress_eta_stream(stream, initial=early).select(columns), "eta3", "append", tmp_path / "c3") == sorted(map(tuple, expected.collect()), key=repr)
    passed = progress.throttle_batch(early)
    expected = progress.throttle_batch(batch).where(F.col("ts") > middle)
    assert drained(spark, progress.throttle_progress(stream, initial=passed), "throttled3", "append", tmp_path / "c4") == sorted(map(tuple, expected.collect()), key=repr)


def table_of(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("meeting_id", "ts", "stage", "progress").collect()), key=repr)


def test_statuses_go_into_a_table(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    path = str(tmp_path / "status")
    q = progress.status_table(stream, path, str(tmp_path / "c"), 4).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    expected = sorted(map(tuple, progress.latest_status(batch).collect()), key=repr)
    assert table_of(spark, path) == expected
    # a batch given again, or an older one after it, changes nothing
    progress.upsert_status(batch, path, 4)
    progress.upsert_status(batch.where("progress < 0.5"), path, 4)
    progress.upsert_status(batch.where("false"), path, 4)
    assert table_of(spark, path) == expected
    # a new meeting touches its own bucket only
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "status").rglob("*.parquet")}
    progress.upsert_status(spark.createDataFrame([(77, datetime(2024, 1, 2), "aligning", 0.5)], SCHEMA), path, 4)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "status").rglob("*.parquet")}
    gone = {f.parent.name for f in before if f not in after}
    assert len({f.parent.name for f in after if f not in before}) == 1 and len(gone) <= 1 and len(table_of(spark, path)) == len(expected) + 1


def test_progress_is_the_share_of_the_total(spark):
    rows = [(1, datetime(2024, 1, 1, 0, 0, k), "transcribing", float(k), total) for k, total in ((0, 10.0), (3, 10.0), (6, None), (9, 0.0), (40, 20.0))]
    heard = spark.createDataFrame(rows, "meeting_id long, ts timestamp, stage string, seconds double, total_seconds double")
    assert [r["progress"] for r in progress.throttle_batch(heard).orderBy("ts").collect()] == [0.0, 0.3, 1.0]


def test_estimates_by_states(spark, tmp_path):
    batch, _ = events(spark, tmp_path)
    columns = ["meeting_id", "stage", "ts", "progress", "eta_seconds"]
    told = [sorted(map(tuple, f(batch).select(columns).collect()), key=repr) for f in (progress.progress_eta, progress.progress_eta_batch)]
    assert told[0] == told[1]


def test_states_of_many_keys_in_one_pass(spark):
    """Keys and their bases go on from one batch of rows to the next, and no call is made for each key."""
    start = datetime(2024, 1, 1)
    rows = [(m, start + timedelta(seconds=3 * k + m), s, ((7 * k + m) % 11) / 11) for m in range(40) for k in range(9) for s in progress.STAGES]
    rows += [(99, start + timedelta(seconds=k), "transcribing", None if k in (2, 4) else 0.1 * (k + 1)) for k in range(6)]
    rows += [(98, start + timedelta(seconds=k), "transcribing", None if k == 0 else 0.1 * k) for k in range(4)]
    batch = spark.createDataFrame(rows, SCHEMA).repartition(5)
    columns = ["meeting_id", "stage", "ts", "progress", "eta_seconds"]
    # where progress is missing the window form has no base any more, the states keep theirs
    expected = progress.progress_eta(batch.where("meeting_id < 98 or progress is not null")).select(columns).where("meeting_id <> 98")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        told = progress.progress_eta_batch(batch)
        got = [tuple(r) for r in told.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(rows)
    assert [r[4] for r in got if r[0] == 98 or r[3] is None] == [None] * 6
    assert sorted((r for r in got if r[0] != 98 and r[3] is not None), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    plan = told._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
