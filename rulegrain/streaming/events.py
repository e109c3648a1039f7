"""Log, progress and telemetry events.

The stateless functions take batch or streaming DataFrames alike. The tracked_*
functions are the stateful streams; latest_* and *_progress are what they come
to over a finished log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rulegrain.functions import clock, iso_timestamp, merged
from rulegrain.schema import DEFAULT_LOG_LEVEL, LOG_LEVELS, label

CORE = "Core"


def core_events(events: DataFrame) -> DataFrame:
    return events.withColumn("source", F.lit(CORE))


def engine_events(events: DataFrame) -> DataFrame:
    """Events of engines are tagged by their engine."""
    return events.withColumn("source", F.col("engine")).drop("engine")


def log_display(events: DataFrame) -> DataFrame:
    """What a terminal shows: errors, warnings and infos, each on its channel."""
    text = F.concat("source", F.lit(" ["), clock(F.col("ts")), F.lit("]: "), F.coalesce("message", F.lit("")))
    return events.where(F.col("level") <= 3).withColumns({"channel": F.lower(label(F.col("level"), LOG_LEVELS)), "text": text})


def log_file(events: DataFrame, level: int = DEFAULT_LOG_LEVEL) -> DataFrame:
    """Lines `[ISO] LEVEL source - message` of events up to a level."""
    text = F.concat(F.lit("["), iso_timestamp(F.col("ts")), F.lit("] "), F.upper(label(F.col("level"), LOG_LEVELS)), F.lit(" "), "source", F.lit(" - "), F.coalesce("message", F.lit("")))
    return events.where(F.col("level") <= level).withColumn("text", text)


def telemetry(events: DataFrame) -> DataFrame:
    """Every event as one map: its data, then its name, time (ms) and id, which win."""
    fixed = F.create_map(F.lit("event"), "event", F.lit("timestamp"), F.unix_millis("ts").cast("string"), F.lit("uuid"), F.uuid())
    return events.withColumn("data", merged(F.coalesce("data", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), fixed))


def engine_selection(rules: DataFrame, engines: DataFrame) -> DataFrame:
    """Selected rules of each known engine that has any."""
    return rules.join(engines.select("engine").distinct(), "engine", "left_semi").groupBy("engine").agg(F.count("*").alias("rule_count"))


def engine_execution(violations: DataFrame, rules: DataFrame, engines: DataFrame) -> DataFrame:
    """Violations of each known engine with selected rules, 0 included."""
    active = engines.select("engine").distinct().join(rules.select("engine").distinct(), "engine", "left_semi")
    counts = violations.groupBy("engine").agg(F.count("*").alias("n"))
    return active.join(counts, "engine", "left").select("engine", F.coalesce("n", F.lit(0)).alias("violation_count"))


def selection_progress(events: DataFrame) -> DataFrame:
    """The mean over cores of their latest whole percent, rounded down, and whether all are done."""
    latest = events.groupBy("core_idx").agg(F.floor(F.max_by("percent", F.struct("ts", "seq"))).alias("percent"))
    return latest.agg(F.floor(F.avg("percent")).alias("percent"), F.coalesce(F.bool_and(F.col("percent") == 100), F.lit(False)).alias("done"))


def latest_run_progress(events: DataFrame) -> DataFrame:
    """Each engine's last percent and message, and when it was first heard of."""
    last = F.max_by(F.struct("percent", "message"), F.struct("ts", "seq"))
    return events.groupBy("engine").agg(last.alias("__last"), F.min(F.struct("ts", "seq")).alias("first_seen")).select("engine", "__last.percent", "__last.message", "first_seen")


def finished(latest: DataFrame) -> DataFrame:
    """n_finished of n_engines, and whether all are done."""
    return latest.agg(F.count_if(F.col("percent") == 100).alias("n_finished"), F.count("*").alias("n_engines"), F.coalesce(F.bool_and(F.col("percent") == 100), F.lit(False)).alias("done"))


def _by_run(events: DataFrame, run: str | None, *columns: str) -> DataFrame:
    """events with the key `run`: the column of that name; null where all are one run's."""
    return events.select(*columns, (F.col(run) if run else F.lit(None)).cast("string").alias("run"))


def tracked_selection(events: DataFrame, n_cores: int, run: str | None = None) -> DataFrame:
    """A stream of (run, percent, done), one row for each event, until all cores of a run are done; later events say nothing.

    events: streaming, core_idx and percent in order of `seq` within a trigger;
    run: the column that names an event's run, where the stream has several.
    State, for each run apart: one percent for each core.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        percents = list(state.get[0]) if state.exists else [0] * n_cores
        out = []
        for row in pd.concat(frames).sort_values("seq").itertuples():
            if all(p == 100 for p in percents):
                break
            percents[row.core_idx] = int(row.percent // 1)
            out.append((sum(percents) // n_cores, all(p == 100 for p in percents)))
        state.update((percents,))
        yield pd.DataFrame([(*key, *o) for o in out], columns=["run", "percent", "done"])

    return _by_run(events, run, "seq", "core_idx", "percent").groupBy("run").applyInPandasWithState(step, "run string, percent int, done boolean", "percents array<int>", "append", GroupStateTimeout.NoTimeout)


def tracked_run(events: DataFrame, run: str | None = None) -> DataFrame:
    """A stream of (run, engine, percent, message, n_finished, n_engines), one row for each event.

    The last event of an engine counts; engines keep the order in which they
    came. run: as above. State, for each run apart: one row for each engine.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for row in pd.concat(frames).sort_values("seq").itertuples():
            seen[row.engine] = float(row.percent)
            out.append((row.engine, float(row.percent), row.message, sum(p == 100 for p in seen.values()), len(seen)))
        state.update((list(seen), list(seen.values())))
        yield pd.DataFrame([(*key, *o) for o in out], columns=["run", "engine", "percent", "message", "n_finished", "n_engines"])

    return _by_run(events, run, "seq", "engine", "percent", "message").groupBy("run").applyInPandasWithState(step, "run string, engine string, percent double, message string, n_finished int, n_engines int", "engines array<string>, percents array<double>", "append", GroupStateTimeout.NoTimeout)


def append_log(lines: DataFrame, folder: str, checkpoint: str, every: str | None = None):
    """A stream of lines (`text`) to text files, each batch in a folder of its own (`batch=<id>`); starts the query. every: a trigger such as '1 second'.

    A batch that a restarted query runs again replaces what its folder holds, so
    no line is there twice, and none of a half-written attempt stays.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").text(f"{folder.rstrip('/')}/batch={number}")

    out = lines.select("text").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def fan_out(lines: DataFrame, sinks: dict, checkpoint: str):
    """A stream of (channel, text) to one function for each channel: sinks[channel](batch DataFrame)."""

    def each(batch: DataFrame, _: int) -> None:
        for channel, sink in sinks.items():
            sink(batch.where(F.col("channel") == channel))

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet events as a stream, files in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
