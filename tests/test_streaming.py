import os

from pyspark.sql import functions as F

from rulegrain.schema import LOG_EVENTS, RUN_PROGRESS, SELECTION_PROGRESS, TELEMETRY
from rulegrain.streaming import events as ev


def batches(spark, tmp_path, schema, *parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame([(None, n, *r) for n, r in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for f in os.listdir(tmp_path / f"in/{k}"):
            if f.startswith("part"):
                os.rename(tmp_path / f"in/{k}/{f}", tmp_path / f"in/{k}-{f}")
                os.utime(tmp_path / f"in/{k}-{f}", (k + 1, k + 1))
    return ev.read_log(spark, str(tmp_path / "in/*.parquet"), schema)


def drained(stream, name, tmp_path):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination(90)
    return stream.sparkSession.table(name).collect()


def test_selection_progress_of_two_cores_stops_when_done(spark, tmp_path):
    steps = [(0, (0, 0.0)), (1, (1, 25.9)), (2, (0, 50.0)), (3, (1, 100.0)), (4, (0, 100.0)), (5, (0, 10.0))]
    stream = batches(spark, tmp_path, SELECTION_PROGRESS, steps[:3], steps[3:])
    got = [(r.percent, r.done) for r in drained(ev.tracked_selection(stream, 2), "selection", tmp_path)]
    assert got == [(0, False), (12, False), (37, False), (75, False), (100, True)]


def test_run_progress_keeps_the_last_word(spark, tmp_path):
    steps = [(0, ("b", 10.0, None)), (1, ("a", 100.0, "m")), (2, ("b", 50.0, "x")), (3, ("b", 100.0, None))]
    stream = batches(spark, tmp_path, RUN_PROGRESS, steps[:2], steps[2:])
    got = [(r.engine, r.percent, r.n_finished, r.n_engines) for r in drained(ev.tracked_run(stream), "run", tmp_path)]
    assert got == [("b", 10.0, 0, 1), ("a", 100.0, 1, 2), ("b", 50.0, 1, 2), ("b", 100.0, 2, 2)]
    batch = spark.createDataFrame([(None, n, *r) for n, r in steps], RUN_PROGRESS)
    assert {r.engine: r.percent for r in ev.latest_run_progress(batch).collect()} == {"a": 100.0, "b": 100.0}
    assert ev.finished(ev.latest_run_progress(batch)).first().done is True


def test_runs_keep_their_own_state(spark, tmp_path):
    rows = [("r1", 0, "a", 100.0), ("r2", 1, "a", 20.0), ("r1", 2, "b", 0.0), ("r2", 3, "a", 100.0)]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "job string, seq long, engine string, percent double").withColumn("message", F.lit("m")).write.mode("append").parquet(str(tmp_path / "runs"))
    stream = ev.tracked_run(spark.readStream.schema("job string, seq long, engine string, percent double, message string").parquet(str(tmp_path / "runs")), "job")
    got = {(r.run, r.engine, r.percent, r.n_finished, r.n_engines) for r in drained(stream, "runs", tmp_path)}
    assert got == {("r1", "a", 100.0, 1, 1), ("r1", "b", 0.0, 1, 2), ("r2", "a", 20.0, 0, 1), ("r2", "a", 100.0, 1, 1)}
    cores = spark.readStream.schema("job string, seq long, engine string, percent double").parquet(str(tmp_path / "runs")).withColumn("core_idx", F.when(F.col("engine") == "a", 0).otherwise(1))
    stream = ev.tracked_selection(cores, 2, "job")
    got = {(r.run, r.percent, r.done) for r in drained(stream, "cores", tmp_path / "more")}
    assert got == {("r1", 50, False), ("r2", 10, False), ("r2", 50, False)}


def test_log_streams(spark, tmp_path):
    ts = F.to_timestamp(F.lit("2025-02-20 14:30:18.014"))
    rows = spark.createDataFrame([(None, "Core", n, f"m{n}") for n in range(1, 6)], LOG_EVENTS).withColumn("ts", ts)
    assert [(r.channel, r.text) for r in ev.log_display(rows).collect()] == [("error", "Core [14:30:18]: m1"), ("warn", "Core [14:30:18]: m2"), ("info", "Core [14:30:18]: m3")]
    assert [r.text for r in ev.log_file(rows).collect()][3] == "[2025-02-20T14:30:18.014Z] DEBUG Core - m4" and ev.log_file(rows, 1).count() == 1
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG_EVENTS).parquet(str(tmp_path / "in"))
    ev.append_log(ev.log_file(stream), str(tmp_path / "log"), str(tmp_path / "ck1")).awaitTermination(90)
    assert spark.read.text(str(tmp_path / "log")).count() == 4
    seen = {}
    sinks = {c: (lambda df, c=c: seen.__setitem__(c, seen.get(c, 0) + df.count())) for c in ("error", "warn", "info")}
    ev.fan_out(ev.log_display(stream), sinks, str(tmp_path / "ck2")).awaitTermination(90)
    assert seen == {"error": 1, "warn": 1, "info": 1}


def test_telemetry(spark):
    rows = spark.createDataFrame([(None, "e", "run", {"k": "v", "event": "mine"}), (None, "e", "run", None)], TELEMETRY).withColumn("ts", F.to_timestamp(F.lit("1970-01-01 00:00:01")))
    first, second = (r.data for r in ev.telemetry(rows).collect())
    assert first["k"] == "v" and first["event"] == "run" and first["timestamp"] == "1000" and first["uuid"] != second["uuid"]


def test_event_sources(spark):
    e = spark.createDataFrame([("x", "m")], "engine string, message string")
    assert ev.engine_events(e).first().source == "x" and ev.core_events(e.drop("engine")).first().source == "Core"


def test_a_restarted_log_writes_no_line_twice(spark, tmp_path, monkeypatch):
    """The query dies after a batch is written and before it is committed; the next start runs that batch again."""
    from pyspark.sql.readwriter import DataFrameWriter

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.txt").write_text(f"line {k}a\nline {k}b\n")
    lines = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    text = DataFrameWriter.text

    def dies(self, path, *rest, **more):
        text(self, path, *rest, **more)
        if path.endswith("batch=1"):
            raise RuntimeError("killed")

    monkeypatch.setattr(DataFrameWriter, "text", dies)
    query = ev.append_log(lines(), str(tmp_path / "log"), str(tmp_path / "ck"))
    try:
        query.awaitTermination(90)
        raise AssertionError("the query should have died")
    except Exception as e:
        assert "killed" in str(e)
    assert spark.read.text(str(tmp_path / "log")).count() == 4
    monkeypatch.setattr(DataFrameWriter, "text", text)
    ev.append_log(lines(), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(90)
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect())
    assert got == sorted(f"line {k}{x}" for k in range(3) for x in "ab")
