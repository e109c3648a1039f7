"""Listeners around a run: what is going on, told while the run's jobs go on.

A listener is told of the selection, of the share of tasks that are done, and at
the end of the counts that the plan itself observed: files read, violations
found. Listeners begin before rules are selected and stop before results are written.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import SparkSession

SELECTION, EXECUTION = "selection", "execution"


@dataclass(frozen=True)
class ProgressEvent:
    """percent of a phase; counts: what is known by then (rules, files, violations)."""

    phase: str
    percent: int
    engines: tuple[str, ...] = ()
    counts: dict[str, int] = field(default_factory=dict)


class Listener(Protocol):
    def listen(self) -> None: ...

    def handle(self, event: ProgressEvent) -> None: ...

    def stop(self) -> None: ...


class Recorder:
    """Keeps what it hears, for tests and logs."""

    def __init__(self) -> None:
        self.heard: list[ProgressEvent] = []
        self.listening = False

    def listen(self) -> None:
        self.listening = True

    def handle(self, event: ProgressEvent) -> None:
        if self.listening:
            self.heard.append(event)

    def stop(self) -> None:
        self.listening = False


class Listeners:
    """Several listeners as one; from `with` to its end they listen, also where the run fails."""

    def __init__(self, listeners: Iterable[Listener] = ()):
        self.all = list(listeners)

    def __enter__(self) -> Listeners:
        for x in self.all:
            x.listen()
        return self

    def __exit__(self, *_: object) -> None:
        for x in self.all:
            x.stop()

    def say(self, phase: str, percent: int, engines: Iterable[str] = (), **counts: int) -> None:
        for x in self.all:
            x.handle(ProgressEvent(phase, percent, tuple(engines), counts))


class Watched:
    """Within `with`, jobs that this thread starts are watched: every `tick` milliseconds their done tasks' share is told, up to 99.

    A period of 0 or less means no watching.
    """

    def __init__(self, spark: SparkSession, listeners: Listeners, engines: Iterable[str], tick: int):
        self.context, self.listeners, self.engines, self.tick = spark.sparkContext, listeners, tuple(engines), tick
        self.group, self.over = f"rulegrain-{uuid.uuid4().hex}", threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True) if tick > 0 and listeners.all else None

    def __enter__(self) -> Watched:
        self.before = {k: self.context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
        self.context.setJobGroup(self.group, "rules over files")
        if self.thread:
            self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        if self.thread:
            self.thread.join()
        for k, v in self.before.items():
            self.context.setLocalProperty(k, v)

    def percent(self) -> int:
        tracker = self.context.statusTracker()
        jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(self.group)) if j]
        stages = [s for s in map(tracker.getStageInfo, {s for j in jobs for s in j.stageIds}) if s]
        total = sum(s.numTasks for s in stages)
        return min(99, 100 * sum(s.numCompletedTasks for s in stages) // total) if total else 0

    def _watch(self) -> None:
        most = 0
        while not self.over.wait(self.tick / 1000):
            most = max(most, self.percent())  # later jobs bring tasks: never backwards
            self.listeners.say(EXECUTION, most, self.engines)
