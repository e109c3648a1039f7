"""Progress of runs with a clock: states that tick without events and end.

What a run's engines have done is kept for each run apart; each trigger with
events of a run gives one row, and so does each period without any, so that a watcher
sees time pass. A run ends with a row without an engine; its state goes then, and
what still comes for it says nothing until its mark expires. State of a run that
never ends expires after `ttl`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "run string, kind string, seconds long, n_finished int, n_engines int, status string"
DAY = 86_400_000


class RunProgress(StatefulProcessor):
    """State: the engines as a list (name, first and last place in the stream, percent, message), when the run began, its end's mark."""

    def __init__(self, tick: int, ttl: int):
        self.tick, self.ttl = tick, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.engines = handle.getListState("engines", "name string, first long, last long, percent double, message string", self.ttl)
        self.began = handle.getValueState("began", "at long", self.ttl)
        self.ended = handle.getValueState("ended", "at long", self.ttl)

    def status(self, run: str, kind: str, now: int, engines: list[tuple]) -> Row:
        lines = [f"{name} at {percent:g}%" + (f": {message}" if message else "") for name, _, _, percent, message in engines]
        return Row(run=run, kind=kind, seconds=(now - self.began.get()[0]) // 1000, n_finished=sum(e[3] == 100 for e in engines), n_engines=len(engines), status="; ".join(lines))

    def kept(self) -> list[tuple]:
        return sorted((tuple(e) for e in self.engines.get()), key=lambda e: e[1]) if self.engines.exists() else []

    def next_tick(self, now: int) -> None:
        """One timer at a time; a period of 0 or less means no ticks."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self.tick > 0:
            self.handle.registerTimer(now + self.tick)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.ended.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.began.exists():
            self.began.update((now,))
        known, end = {e[0]: e for e in self.kept()}, False
        for r in rows:  # in any order: an engine's last word counts
            if r.engine is None:
                end = True
                continue
            name, first, last, percent, message = known.get(r.engine, (r.engine, r.seq, -1, 0.0, None))
            newer = r.seq >= last
            known[name] = (name, min(first, r.seq), max(last, r.seq), float(r.percent) if newer else percent, r.message if newer else message)
        engines = sorted(known.values(), key=lambda e: e[1])
        if end:
            yield self.status(key[0], "end", now, engines)
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.engines.clear()
            self.began.clear()
            self.ended.update((now,))
            return
        self.engines.put(engines)
        self.began.update(self.began.get())  # lives as long as the engines do
        self.next_tick(now)
        yield self.status(key[0], "events", now, engines)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.began.exists() and self.engines.exists():
            self.next_tick(now)
            yield self.status(key[0], "tick", now, self.kept())

    def close(self) -> None:
        pass


def ticking_run(events: DataFrame, run: str | None = None, tick: int = 1000, ttl: int = DAY) -> DataFrame:
    """A stream of STATUS from a stream of events (seq, engine, percent, message): kind `events`, `tick` or `end`.

    run: the column that names an event's run. tick: milliseconds without
    events until a status comes again, by the clock of the triggers; 0 and less disable it.
    An event without an engine ends its run. ttl: milliseconds that state outlives its last event.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = events.select("seq", "engine", "percent", "message", F.coalesce(F.col(run).cast("string") if run else F.lit(None), F.lit("")).alias("run"))
    return keyed.groupBy("run").transformWithState(RunProgress(tick, ttl), STATUS, "Update", "ProcessingTime")
