import time

from rulegrain.streaming.progress import ticking_run

EVENTS = "job string, seq long, engine string, percent double, message string"


def started(spark, tmp_path, name, tick, ttl=86_400_000):
    (tmp_path / "in").mkdir(exist_ok=True)
    stream = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
    out = ticking_run(stream, "job", tick, ttl)
    return out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()


def put(spark, tmp_path, k, *rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.json(str(tmp_path / f"w{k}"))
    next((tmp_path / f"w{k}").glob("part-*")).rename(tmp_path / f"in/{k}.json")


def until(spark, name, n, query, kind=None, seconds=60):
    stop = time.time() + seconds
    while time.time() < stop and query.isActive:
        rows = [r for r in spark.table(name).collect() if kind in (None, r.kind)]
        if len(rows) >= n:
            return rows
        time.sleep(0.3)
    raise AssertionError((spark.table(name).collect(), query.exception()))


def test_a_run_ticks_without_events_and_ends(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = started(spark, tmp_path, "ticks", 1000)
    try:
        put(spark, tmp_path, 0, ("r", 1, "b", 10.0, None), ("r", 0, "b", 0.0, "old"), ("r", 2, "a", 100.0, "m"))
        first = until(spark, "ticks", 1, query)[0]
        assert (first.run, first.kind, first.n_finished, first.n_engines, first.status) == ("r", "events", 1, 2, "b at 10%; a at 100%: m")
        ticks = until(spark, "ticks", 2, query, "tick")
        assert all(t.status == first.status for t in ticks) and ticks[1].seconds > first.seconds
        put(spark, tmp_path, 1, ("r", 3, "b", 100.0, "done"), ("r", 4, None, None, None))
        end = until(spark, "ticks", 1, query, "end")[0]
        assert (end.n_finished, end.status) == (2, "b at 100%: done; a at 100%: m")
        n = spark.table("ticks").count()
        put(spark, tmp_path, 2, ("r", 5, "c", 1.0, None), ("s", 0, "c", 5.0, None))
        assert until(spark, "ticks", n + 1, query)[-1].run == "s"
        assert [r for r in spark.table("ticks").collect()[n:] if r.run == "r"] == []
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_negative_period_disables_ticks_and_state_expires(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = started(spark, tmp_path, "silent", -1, ttl=2000)
    try:
        put(spark, tmp_path, 0, ("r", 0, "a", 50.0, None))
        until(spark, "silent", 1, query)
        time.sleep(5)
        assert [r.kind for r in spark.table("silent").collect()] == ["events"]
        put(spark, tmp_path, 1, ("r", 1, "b", 1.0, None))
        last = until(spark, "silent", 2, query)[1]
        assert (last.kind, last.n_engines, last.status) == ("events", 1, "b at 1%")  # `a` has expired
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
