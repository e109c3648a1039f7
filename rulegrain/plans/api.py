"""The three actions as functions: run(), rules() and config()."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from contextlib import suppress
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rulegrain.operators import catalog, confdiff, results, selector, summary
from rulegrain.plans import sinks
from rulegrain.schema import DEFAULT_TAG, FIELDS, parse_severity
from rulegrain.sources import config as conf
from rulegrain.sources import workspace as ws
from rulegrain.sources.engines import RegexEngine, Registry
from rulegrain.streaming.events import CORE, engine_execution, engine_selection
from rulegrain.streaming.listeners import EXECUTION, SELECTION, Listener, Listeners, Watched

VIEWS = ("table", "detail")


def view_of(view: str | None, output: Iterable[str]) -> str | None:
    """An explicit view wins; without output files, a table; else none."""
    if view is not None and view not in VIEWS:
        raise ValueError(f"{view!r} is no view; use one of {', '.join(VIEWS)}")
    return view or (None if list(output) else "table")


@dataclass
class RunResult:
    violations: DataFrame
    rules: DataFrame
    view: DataFrame | None
    lines: list[str]
    gate: summary.Gate
    telemetry: dict = field(default_factory=dict)
    log: str | None = None  # the log file, where the configuration has a log_folder
    before: list[str] = field(default_factory=list)  # what was said before the run

    def text(self) -> DataFrame | None:
        """The view as text: num and text of each violation."""
        if self.view is None:
            return None
        return results.detail_text(self.view) if "title" in self.view.columns else results.table_text(self.view)


def registry_for(config: conf.Config, registry: Registry | None, failed: dict | None = None) -> Registry:
    """The given engines and the configured regex rules, less disabled engines.

    failed: takes the error of an engine whose configuration is wrong; that
    engine is left out. Without it the error is raised.
    """
    out = Registry(list(registry.engines) if registry else [])
    custom = (config.engines.get("regex") or {}).get("custom_rules")
    if custom:
        try:
            mine = RegexEngine.from_config(custom)
        except ValueError as e:
            if failed is None:
                raise
            failed[RegexEngine.name] = str(e)
            return out.without([*config.disabled(), RegexEngine.name])
        old = next((e for e in out.engines if e.name == mine.name), None)
        if old is not None:
            out.engines[out.engines.index(old)] = RegexEngine([*old.rules, *mine.rules], old.name)
        else:
            out.add(mine)
    return out.without(config.disabled())


def _files(spark: SparkSession, workspace, target, files: DataFrame | None, scan: bool) -> DataFrame | None:
    """The files to work on; a target that no file lies at or under is an error, found by names alone."""
    targets = [os.path.abspath(t) for t in ws.expand(target)] if target else None
    rows = spark.createDataFrame([(t,) for t in targets], "path string") if targets else None
    places = None
    if files is None:
        workspace, target = ws.resolve(workspace, target, scan)
        if workspace is None:
            return None
        places = ws.expand(workspace)
    if targets:
        known = ws.scan(spark, places, targets, names=True) if places else files
        if stray := [r.path for r in ws.stray_targets(known, rows).collect()]:
            raise ValueError(f"targets outside the workspace: {stray}")
    if places:
        return ws.scan(spark, places, targets)
    return ws.targeted(files, rows).where("is_target") if targets else files


def _executed(spark: SparkSession, engines: Registry, chosen: DataFrame, scanned: DataFrame, told: Listeners, active: list[str], tick: int) -> DataFrame:
    """The violations, found and kept: writers, views and counts read them."""
    seen = Observation()
    violations = results.enriched(engines.run(chosen, scanned, seen), chosen).cache()
    told.say(EXECUTION, 0, active)
    with Watched(spark, told, active, tick):
        counts = {"violations": violations.count()}
    if any(type(e) is RegexEngine and e.name in active for e in engines.engines):
        with suppress(Py4JJavaError):  # nothing was observed where the plan turned out empty before the files were read
            counts |= seen.get
    told.say(EXECUTION, 100, active, **counts)
    return violations


def run(
    spark: SparkSession, workspace: list[str] | None = None, target: list[str] | None = None, rule_selector: str | list[str] = DEFAULT_TAG, severity_threshold: int | str | None = None,
    view: str | None = None, output_file: list[str] | str = (), config_file: str | None = None, registry: Registry | None = None, files: DataFrame | None = None,
    listeners: Iterable[Listener] = (), tick: int = 1000, say: Callable[[list[str]], None] = lambda lines: None,
) -> RunResult:
    """Select rules, scan, and report. Arguments are checked before anything is read.

    files: a table (file, ext, content) in place of a workspace. listeners: told of
    progress from before the selection until before results are written, every
    `tick` milliseconds (0 and less: at beginnings and ends only). say: gets the
    lines before the run as soon as they are known. The gate comes last, so results
    are written even where it fails.
    """
    output = selector.flat(output_file)
    writers, view = sinks.writers(output), view_of(view, output)
    threshold = None if severity_threshold is None else parse_severity(severity_threshold)
    config = conf.load(config_file)
    engines = registry_for(config, registry)
    names = engines.names(spark)
    log = sinks.RunLog(config.log_folder, config.log_level)
    before = summary.before_lines(log.path)
    say(before)
    try:
        scanned = _files(spark, workspace, target, files, scan=True)
        with Listeners(listeners) as told:
            told.say(SELECTION, 0)
            chosen = selector.select(catalog.overridden(engines.catalogue(spark, scanned), conf.overrides(spark, config)), rule_selector)
            per = {r.engine: r["count"] for r in chosen.groupBy("engine").count().collect()}
            told.say(SELECTION, 100, sorted(per), rules=sum(per.values()))
            violations = _executed(spark, engines, chosen, scanned, told, sorted(per), tick)
        sent = {"engine_selection": engine_selection(chosen, names), "engine_execution": engine_execution(violations, chosen, names)}
        if config.log_folder:
            for r in sent["engine_selection"].orderBy("engine").collect():
                log.say(4, r.engine, f"{r.rule_count} rules selected")
            for r in sent["engine_execution"].orderBy("engine").collect():
                log.say(3, r.engine, f"{r.violation_count} violations found")
    except Exception as e:
        log.say(1, CORE, str(e))
        raise
    finally:  # the log ends before results are written or shown
        logged = log.close(spark)
    for write in writers:
        write(violations)
    shown = {"table": results.table, "detail": results.details}[view](violations).orderBy("num") if view else None
    return RunResult(violations, chosen, shown, summary.results_lines(violations, output), summary.gate(violations, threshold), sent, logged, before)


@dataclass
class RulesResult:
    rules: DataFrame
    view: DataFrame | None
    lines: list[str]


def rules(
    spark: SparkSession, workspace: list[str] | None = None, target: list[str] | None = None, rule_selector: str | list[str] = DEFAULT_TAG, view: str | None = None,
    output_file: str | None = None, config_file: str | None = None, registry: Registry | None = None, files: DataFrame | None = None,
) -> RulesResult:
    """The selected rules, in order; written first, then shown."""
    output = [output_file] if output_file else []
    writer, view = sinks.rules_writer(output_file) if output_file else None, view_of(view, output)
    config = conf.load(config_file)
    engines = registry_for(config, registry)
    scanned = _files(spark, workspace, target, files, scan=False)
    chosen = catalog.ordered(selector.select(catalog.overridden(engines.catalogue(spark, scanned), conf.overrides(spark, config)), rule_selector))
    if writer:
        writer(chosen)
    shown = {"table": results.rule_table, "detail": results.rule_details}[view](chosen) if view else None
    return RulesResult(chosen, shown, summary.rules_lines(chosen, output))


TOP = (
    ("config_root", "The folder that relative paths start from.", "null"),
    ("log_folder", "The folder for log files.", "null"),
    ("log_level", "1 Error, 2 Warn, 3 Info, 4 Debug, 5 Fine.", "4"),
)


def config(
    spark: SparkSession, rule_selector: str | list[str] = "all", config_file: str | None = None, output_file: str | None = None, include_unmodified_rules: bool = False,
    registry: Registry | None = None, files: DataFrame | None = None, overwrite: Callable[[str], bool] = lambda path: True, view: Callable[[str], None] = lambda text: None,
) -> str:
    """The user's configuration against the defaults as YAML; returned, and written where asked.

    view: gets the text where it wasn't written: no file was named, or the file is to stay.

    An engine whose configuration is wrong is logged, and shown with the user's own values.
    """
    if output_file and not output_file.lower().endswith((".yaml", ".yml")):
        raise ValueError(f"{output_file!r}: a configuration is written as .yaml or .yml")
    user = conf.load(config_file)
    failed: dict[str, str] = {}
    mine, default = registry_for(user, registry, failed), registry_for(user.only_disabling(), registry)
    if failed:
        log = sinks.RunLog(user.log_folder, user.log_level)
        for engine, error in failed.items():
            log.say(1, engine, error)
        log.close(spark)
    effective = selector.select(catalog.overridden(mine.catalogue(spark, files), conf.overrides(spark, user)), rule_selector)
    every = default.catalogue(spark, files)
    names = (registry_for(conf.Config(engines={}), registry)).names(spark)
    off = catalog.disabled_engines(names, mine.names(spark)).select("engine")
    relevant = catalog.relevant_engines(off, effective, selector.select(every, rule_selector)).select("engine")
    order = {r.engine: r.engine_ord for r in names.collect()}
    engines = sorted((r.engine for r in relevant.collect()), key=lambda e: order.get(e, 0))
    described = [(e.name, f, k, text, kind, value) for e in (registry.engines if registry else []) for k, (f, text, kind, value) in enumerate([("disable_engine", "Whether the engine is off.", "boolean", "false"), *e.fields()])]
    fields = spark.createDataFrame(described, "engine string, field string, field_ord int, description string, value_type string, default_json string")
    settings = conf.settings(spark, user)
    made = mine.names(spark).join(settings, "engine", "left").select("engine", "field", "value_json")
    fields = confdiff.field_diff(confdiff.resolved(fields, made, settings), user.config_root)
    top = spark.createDataFrame([("", f, k, text, None, value, json.dumps(getattr(user, f)), f in user.supplied) for k, (f, text, value) in enumerate(TOP)], FIELDS)
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]  # noqa: E731  a configuration: small by nature
    diff = confdiff.rule_diff(effective, every, include_unmodified_rules)
    text = confdiff.yaml_text(rows(confdiff.field_diff(top), "field_ord"), rows(diff, "engine", "rule"), engines, rows(fields.where(F.col("engine").isin(engines)), "engine", "field_ord"))
    if not (output_file and sinks.write_config(text, output_file, overwrite)):
        view(text)
    return text
