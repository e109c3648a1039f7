"""The registered queries of the rule model over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulegrain.functions import commented, compact_timestamp, elapsed_seconds, header_and_body, indented, inline_comment, message, property_list
from rulegrain.operators import catalog, confdiff, results, selector, summary
from rulegrain.plans import sinks
from rulegrain.plans.api import view_of
from rulegrain.schema import FIELDS, OVERRIDES, SEVERITIES, VIOLATIONS, parse_severity, severity_of
from rulegrain.sources import config as conf
from rulegrain.sources import trigrams
from rulegrain.sources import workspace as ws
from rulegrain.sources.engines import RegexEngine, RegexRule, Registry
from rulegrain.sources.shared import shared_path
from rulegrain.sources.tables import duplicate_blocks
from rulegrain.streaming import events as ev

R = "Recommended"
REGISTRY = Registry([
    RegexEngine([
        RegexRule("email_address", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", ("txt",), 2, (R, "Security", "Privacy"), "An e-mail address", ("https://example.org/rules/email",)),
        RegexRule("long_hex", r"[0-9a-f]{12,}", ("txt",), 1, (R, "Security", "Secrets"), "A long hexadecimal string", ("https://example.org/rules/hex",)),
        RegexRule("long_number", r"[0-9]{10,}", ("txt", "html"), 3, ("Privacy",), "A long number"),
        RegexRule("access_key", r"AKIA[0-9A-Z]{16}", (), 1, (R, "Security"), "An access key"),
    ], "secrets"),
    RegexEngine([
        RegexRule("license_line", r"[Ll]icen[sc]e|[Cc]opyright", ("txt",), 4, (R, "Legal"), "A line about a licence", ("https://example.org/rules/licence", "https://example.org/legal")),
        RegexRule("todo_note", r"TODO|FIXME", (), 5, ("CodeStyle",), "A note to do something"),
        RegexRule("shouted_word", r"[A-Z]{8,}", ("txt",), 5, ("CodeStyle", "Legal"), "A word in capitals"),
    ], "prose"),
    RegexEngine([
        RegexRule("inline_script", r"<script", ("html",), 2, (R, "Security"), "A script in the page"),
        RegexRule("plain_http", r"http://", ("html", "txt"), 3, (R, "BestPractice"), "A link without encryption"),
        RegexRule("nested_bold", r"<p><b>", ("html",), 4, ("CodeStyle",), "Bold text that opens a paragraph"),
    ], "web"),
    RegexEngine([RegexRule("never_there", r"zqxjkv{3}", (), 3, ("Custom",), "Matches nothing")], "idle"),
])
CHANGES = [("secrets", "long_number", 2, None), ("prose", "license_line", None, ["Legal"]), ("web", "plain_http", 5, ["CodeStyle", "BestPractice"]), ("web", "nested_bold", None, []), ("web", "inline_script", 2, None)]
FIELD_ROWS = [
    ("web", "p1", 0, "text", "string", '"a"', '"b"', True), ("web", "p2", 1, None, None, None, '"x"', True), ("web", "p3", 2, "text", "object", '{"k":1}', '{"k":2}', True),
    ("web", "p4", 3, "text", "string", "null", None, False), ("web", "p5", 4, "text", "string", '"d"', '"e"', False), ("web", "p6", 5, "text", "array", "[1,2]", "[1,2]", True),
]


def rules(spark: SparkSession) -> DataFrame:
    return REGISTRY.catalogue(spark)


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANGES, OVERRIDES)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and pages as files; ids are unique, so the parts are disjoint."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return ws.from_documents(read("documents")).unionByName(ws.from_pages(read("pages")))


def violations(spark: SparkSession, sf_dir: str, select: str = "all") -> DataFrame:
    chosen = selector.select(rules(spark), select)
    return results.enriched(REGISTRY.run(chosen, files(spark, sf_dir)), chosen)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("engine", "rule", "severity", F.array_join("tags", ",").alias("tags"))


SELECTIONS = {"all": "all", "tag_ci": "sEcUrItY", "engine": "web", "severity": "high", "severity_number": "3", "intersection": "web:Recommended:2", "union": "secrets:1,prose:Recommended", "rule_name": "todo_note", "none": "NonsensicalTag", "default": R}
#: The same by hand, over columns engine, rule, severity, tags.
SELECTION_SQL = {
    "all": "true", "tag_ci": "list_contains(list_transform(tags, lambda t: lower(t)), 'security')", "engine": "engine = 'web'", "severity": "severity = 2", "severity_number": "severity = 3",
    "intersection": "engine = 'web' AND list_contains(tags, 'Recommended') AND severity = 2", "union": "(engine = 'secrets' AND severity = 1) OR (engine = 'prose' AND list_contains(tags, 'Recommended'))",
    "rule_name": "rule = 'todo_note'", "none": "false", "default": "list_contains(tags, 'Recommended')",
}


def _q(v) -> str:
    return "NULL" if v is None else f"[{', '.join(map(_q, v))}]::VARCHAR[]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) AS t({names}))"


_RULE_ROWS = [(e.name, k, r.name, i, r.severity, list(r.tags), r.pattern, list(r.extensions), r.description, list(r.urls)) for k, e in enumerate(REGISTRY.engines) for i, r in enumerate(e.rules)]
RULES_SQL = "rules AS " + _values(_RULE_ROWS, "engine, engine_ord, rule, rule_ord, severity, tags, pattern, extensions, description, urls")
OVERRIDES_SQL = "over AS " + _values(CHANGES, "engine, rule, o_severity, o_tags") + ", eff AS (SELECT r.* REPLACE (coalesce(o_severity, severity) AS severity, coalesce(o_tags, tags) AS tags) FROM rules r LEFT JOIN over USING (engine, rule))"
FILES_SQL = """files AS (SELECT '/ws/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS file, 'txt' AS ext, coalesce(text, '') AS content FROM documents
UNION ALL SELECT '/ws/pages/' || lpad(page_id::VARCHAR, 8, '0') || '.html', 'html', coalesce(html, '') FROM pages)"""
#: Each match stands between two marks, so what is before it, less the marks, tells its column.
_PER_RULE = " UNION ALL ".join(
    f"SELECT file, n AS start_line, '{r[0]}' AS engine, '{r[2]}' AS rule, s, unnest(range(2, len(s) + 1)) AS k FROM (SELECT file, n, string_split(regexp_replace(line, '({r[6]})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS s FROM lines WHERE regexp_matches(line, '{r[6]}')" + (f" AND ext IN ({', '.join(map(_q, r[7]))})" if r[7] else "") + ")" for r in _RULE_ROWS
)
VIOLATIONS_SQL = f"""WITH {RULES_SQL}, {FILES_SQL},
lines AS (SELECT file, ext, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
marked AS ({_PER_RULE}),
hits AS (SELECT file, start_line, engine, rule, length(replace(array_to_string(s[1:k - 1], ''), chr(2), '')) + 1 AS c, length(split_part(s[k], chr(2), 1)) AS size FROM marked),
v AS (SELECT h.file, h.start_line::INT AS start_line, c::INT AS start_column, (c + size)::INT AS end_column, h.engine, h.rule, severity, description AS message, tags, urls FROM hits h JOIN rules USING (engine, rule))"""


def _at() -> Column:
    return F.get("code_locations", F.lit(0))


def _place() -> list[Column]:
    return [_at()[c].alias(c) for c in ("file", "start_line", "start_column", "end_column")]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = reduce(lambda c, p: F.when(F.col("event_type") == p[0], p[1]).otherwise(c), {"error": 1, "signup": 2, "view": 3, "click": 4}.items(), F.lit(5))
    return events(spark, sf_dir).select("event_id", "ts", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source"), level.alias("level"), F.col("props").alias("message"))


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("engine"), F.least(F.lit(100.0), F.floor("value").cast("double")).alias("percent"), F.col("props").alias("message"))


def _selected(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _shown(selector.select(rules(spark), SELECTIONS[name]))


LOG_SQL = "log AS (SELECT event_id, ts, 'user' || user_id AS source, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS level, props AS message FROM events)"
PROGRESS_SQL = "progress AS (SELECT ts, event_id AS seq, event_type AS engine, least(100.0, floor(value))::DOUBLE AS percent, props AS message FROM events)"
_TAGS = "engine, rule, severity, array_to_string(tags, ',') AS tags"
#: name: (query, SQL)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {f"rules_select_{n}": (_selected(n), f"WITH {RULES_SQL} SELECT {_TAGS} FROM rules WHERE {SELECTION_SQL[n]}") for n in SELECTIONS}


def query(sql: str):
    def keep(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


@query(f"WITH {RULES_SQL} SELECT engine, count(*) AS n_rules FROM rules GROUP BY engine")
def rules_per_engine(spark, sf_dir):
    return catalog.per_engine(rules(spark))


@query(f"WITH {RULES_SQL} SELECT count(*) AS n_rules, count(DISTINCT engine) AS n_engines FROM rules")
def rules_totals(spark, sf_dir):
    return catalog.totals(rules(spark))


@query(f"WITH {RULES_SQL}, {OVERRIDES_SQL} SELECT {_TAGS} FROM eff")
def rules_with_overrides(spark, sf_dir):
    return _shown(catalog.overridden(rules(spark), overrides(spark)))


@query(f"WITH {RULES_SQL}, {OVERRIDES_SQL} SELECT {_TAGS} FROM eff WHERE list_contains(tags, 'CodeStyle')")
def rules_override_then_select(spark, sf_dir):
    return _shown(selector.select(catalog.overridden(rules(spark), overrides(spark)), "codestyle"))


@query(f"WITH {RULES_SQL} SELECT row_number() OVER (ORDER BY engine_ord, engine, rule)::INT AS num, rule AS name, engine, severity || ' (' || ['Critical', 'High', 'Moderate', 'Low', 'Info'][severity] || ')' AS severity, array_to_string(tags, ', ') AS tag FROM rules")
def rules_table(spark, sf_dir):
    return results.rule_table(rules(spark))


@query(f"""WITH {RULES_SQL} SELECT row_number() OVER (ORDER BY engine_ord, engine, rule)::INT AS num, rule, severity || ' (' || ['Critical', 'High', 'Moderate', 'Low', 'Info'][severity] || ')' AS severity, engine,
array_to_string(tags, ', ') AS tags, CASE WHEN len(urls) = 1 THEN urls[1] END AS resource, CASE WHEN len(urls) > 1 THEN array_to_string(urls, ' ') END AS resources, nullif(description, '') AS description FROM rules""")
def rules_detail(spark, sf_dir):
    return results.rule_details(rules(spark)).withColumn("resources", F.array_join("resources", " "))


@query(f"WITH {RULES_SQL} SELECT {_TAGS} FROM rules WHERE engine NOT IN ('idle', 'prose')")
def rules_engine_disabled(spark, sf_dir):
    return _shown(catalog.enabled(rules(spark), spark.createDataFrame([("idle",), ("prose",)], "engine string")))


@query("SELECT * FROM (VALUES ('idle', 3), ('prose', 1)) AS t(engine, engine_ord)")
def engines_disabled(spark, sf_dir):
    return catalog.disabled_engines(REGISTRY.names(spark), REGISTRY.without(["idle", "prose"]).names(spark))


@query("SELECT * FROM (VALUES ('idle', 0), ('secrets', 1), ('web', 1), ('prose', 2)) AS t(engine, ord)")
def engines_relevant(spark, sf_dir):
    off = spark.createDataFrame([("idle",)], "engine string")
    return catalog.relevant_engines(off, selector.select(rules(spark), "Security"), selector.select(rules(spark), "all"))


_DIFF = f"""WITH {RULES_SQL}, {OVERRIDES_SQL} SELECT e.engine, e.rule, e.severity, r.severity AS default_severity, array_to_string(e.tags, ',') AS tags, array_to_string(r.tags, ',') AS default_tags,
e.severity <> r.severity AS severity_modified, array_to_string(e.tags, ',') <> array_to_string(r.tags, ',') AS tags_modified FROM eff e JOIN rules r USING (engine, rule)"""


def _diff(spark, everything):
    out = confdiff.rule_diff(catalog.overridden(rules(spark), overrides(spark)), rules(spark), everything)
    return out.withColumns({c: F.array_join(c, ",") for c in ("tags", "default_tags")})


@query(_DIFF + " WHERE e.severity <> r.severity OR array_to_string(e.tags, ',') <> array_to_string(r.tags, ',')")
def config_rule_diff(spark, sf_dir):
    return _diff(spark, False)


@query(_DIFF)
def config_rule_diff_all(spark, sf_dir):
    return _diff(spark, True)


@query(f"""WITH f AS {_values(FIELD_ROWS, "engine, field, field_ord, description, value_type, default_json, value_json, supplied")},
g AS (SELECT *, coalesce(value_json, default_json) AS v FROM f WHERE description IS NOT NULL),
s AS (SELECT *, CASE WHEN NOT supplied AND v IS DISTINCT FROM default_json THEN 'derived' WHEN v IS NOT DISTINCT FROM default_json THEN 'default' ELSE 'modified' END AS status FROM g)
SELECT engine, field, status, CASE WHEN status = 'modified' THEN v ELSE default_json END AS printed_json, CASE status WHEN 'derived' THEN v WHEN 'modified' THEN default_json END AS note_json FROM s""")
def config_field_diff(spark, sf_dir):
    return confdiff.field_diff(spark.createDataFrame(FIELD_ROWS, FIELDS)).select("engine", "field", "status", "printed_json", "note_json")


@query(f"WITH {FILES_SQL} SELECT ext, count(*) AS n_files, sum(length(content))::BIGINT AS n_chars FROM files GROUP BY ext")
def workspace_files_by_ext(spark, sf_dir):
    return files(spark, sf_dir).groupBy("ext").agg(F.count("*").alias("n_files"), F.sum(F.length("content")).alias("n_chars"))


@query(f"WITH {FILES_SQL} SELECT ext, file LIKE '/ws/src1/%' OR file LIKE '/ws/src2/de/%' OR file = '/ws/pages/00000007.html' AS is_target, count(*) AS n FROM files GROUP BY ALL")
def target_narrowing(spark, sf_dir):
    targets = spark.createDataFrame([("/ws/src1",), ("/ws/src2/de/",), ("/ws/pages/00000007.html",)], "path string")
    return ws.targeted(files(spark, sf_dir), targets).groupBy("ext", "is_target").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('/ws/nowhere')) AS t(path)")
def targets_outside(spark, sf_dir):
    targets = spark.createDataFrame([("/ws/nowhere",), ("/ws/pages",)], "path string")
    return ws.stray_targets(files(spark, sf_dir), targets)


@query(VIOLATIONS_SQL + " SELECT file, start_line, start_column, end_column, engine, rule FROM v")
def violations_regex(spark, sf_dir):
    return REGISTRY.run(rules(spark), files(spark, sf_dir)).select(*_place(), "engine", "rule")


@query(VIOLATIONS_SQL + " SELECT file, start_line, engine, rule, severity, message, array_to_string(tags, ',') AS tags, array_to_string(urls, ' ') AS resources FROM v WHERE list_contains(tags, 'Recommended')")
def violations_enriched(spark, sf_dir):
    return violations(spark, sf_dir, R).select(*_place()[:2], "engine", "rule", "severity", "message", F.array_join("tags", ",").alias("tags"), F.array_join("resource_urls", " ").alias("resources"))


def _ordered(df: DataFrame) -> DataFrame:
    """A stable order of arrival that SQL can have too."""
    place = Window.partitionBy(_at()["file"], _at()["start_line"], _at()["start_column"]).orderBy("engine", "rule")
    return df.withColumn("violation_ord", F.dense_rank().over(place).cast("long"))


@query(VIOLATIONS_SQL + " SELECT row_number() OVER (ORDER BY severity, file, start_line, start_column, engine, rule) AS num, severity || ' (' || ['Critical', 'High', 'Moderate', 'Low', 'Info'][severity] || ')' AS severity, engine || ':' || rule AS rule, substr(file, 5) || ':' || start_line || ':' || start_column AS location, message FROM v")
def violations_sorted_num(spark, sf_dir):
    return results.table(_ordered(violations(spark, sf_dir)), collation=None)


@query(VIOLATIONS_SQL + " SELECT engine, rule, file || ' (' || start_line || ':' || start_column || '-' || start_line || ':' || end_column || ')' AS location FROM v")
def violations_location_str(spark, sf_dir):
    return violations(spark, sf_dir).select("engine", "rule", results.location_text(_at()).alias("location"))


@query(VIOLATIONS_SQL + """, g AS (SELECT file, rule, file || ' (' || start_line || ':' || start_column || '-' || start_line || ':' || end_column || ')' AS l, row_number() OVER (PARTITION BY file, rule ORDER BY start_line, start_column) AS k, count(*) OVER (PARTITION BY file, rule) AS n FROM v WHERE rule = 'license_line')
SELECT file, rule, (k - 1)::INT AS k, CASE WHEN n > 1 AND k = n THEN '(main) ' ELSE '' END || l AS location FROM g""")
def violations_multi_location(spark, sf_dir):
    """One violation for each file and rule with all its locations, the last one primary."""
    v = violations(spark, sf_dir).where("rule = 'license_line'")
    one = v.groupBy(_at()["file"].alias("file"), "rule").agg(F.array_sort(F.flatten(F.collect_list("code_locations"))).alias("code_locations"))
    one = one.withColumn("primary_location_index", F.size("code_locations") - 1)
    return one.select("file", "rule", F.posexplode(results.location_texts()).alias("k", "location"))


@query(VIOLATIONS_SQL + " SELECT severity, ['Critical', 'High', 'Moderate', 'Low', 'Info'][severity] AS label, count(*) AS n FROM v GROUP BY severity")
def violations_by_severity(spark, sf_dir):
    return summary.by_severity(violations(spark, sf_dir))


@query(VIOLATIONS_SQL + ", e AS (SELECT DISTINCT engine FROM rules) SELECT e.engine, count(v.rule) AS n FROM e LEFT JOIN v USING (engine) GROUP BY e.engine")
def violations_by_engine(spark, sf_dir):
    return summary.by_engine(violations(spark, sf_dir), REGISTRY.names(spark))


@query(VIOLATIONS_SQL + " SELECT count(*) AS n_violations, count(DISTINCT file) AS n_files FROM v")
def violations_distinct_files(spark, sf_dir):
    return summary.totals(violations(spark, sf_dir))


@query(VIOLATIONS_SQL + ", t AS (SELECT unnest([1, 2, 3, 4, 5])::INT AS threshold) SELECT threshold, count(v.rule) AS n, min(severity)::INT AS worst FROM t LEFT JOIN v ON severity <= threshold GROUP BY threshold")
def threshold_gate(spark, sf_dir):
    """Every threshold from one aggregation by severity: the five counts, summed up."""
    per = summary.by_severity(violations(spark, sf_dir)).select("severity", "n")
    at = per.select(F.explode(F.sequence("severity", F.lit(5))).alias("threshold"), "severity", "n")
    every = spark.createDataFrame([(n,) for n in SEVERITIES], "threshold int")
    found = at.groupBy("threshold").agg(F.sum("n").alias("n"), F.min("severity").alias("worst"))
    return every.join(found, "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).alias("n"), "worst")


@query(FILES_SQL.replace("files AS", "WITH files AS", 1) + """, d AS (SELECT ext, string_split(regexp_replace(file, '/[^/]*$', ''), '/') AS p FROM files),
m AS (SELECT ext, min(p) AS lo, max(p) AS hi FROM d GROUP BY ext)
SELECT ext, array_to_string(list_filter(lo, lambda x, i: list_slice(lo, 1, i) = list_slice(hi, 1, i)), '/') AS folder FROM m""")
def common_parent_folder(spark, sf_dir):
    return files(spark, sf_dir).groupBy("ext").agg(results.common_parent(F.col("file")).alias("folder"))


@query(VIOLATIONS_SQL + " SELECT engine, rule, severity, message, file, start_line, start_column, start_line AS end_line, end_column, 1 AS n_locations, array_to_string(urls, ' ') AS resources FROM v")
def results_csv_rows(spark, sf_dir):
    return sinks.flat_rows(violations(spark, sf_dir))


@query(VIOLATIONS_SQL + " SELECT engine AS tool, rule AS rule_id, ['error', 'error', 'warning', 'note', 'note'][severity] AS level, message, 0 AS location, file AS uri, start_line, start_column FROM v")
def results_sarif_rows(spark, sf_dir):
    return sinks.sarif_rows(violations(spark, sf_dir))


@query(VIOLATIONS_SQL + " SELECT row_number() OVER (ORDER BY severity, file, start_line, start_column, engine, rule) AS num, severity, rule FROM v QUALIFY num <= 20")
def violations_most_severe(spark, sf_dir):
    top = results.most_severe(_ordered(violations(spark, sf_dir)), 20, collation=None)
    return results.numbered(top, collation=None).select("num", "severity", "rule")


@query(VIOLATIONS_SQL + ", f AS (SELECT DISTINCT doc_id FROM v JOIN documents ON file = '/ws/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt') SELECT quality, count(*) AS n_docs, count(f.doc_id) AS n_with_violations FROM labels LEFT JOIN f USING (doc_id) GROUP BY quality")
def violations_by_label(spark, sf_dir):
    v = violations(spark, sf_dir).where(_at()["file"].endswith(".txt"))
    ids = v.select(F.regexp_extract(_at()["file"], r"(\d+)\.txt$", 1).cast("long").alias("doc_id")).distinct().withColumn("hit", F.lit(1))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.join(ids, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n_docs"), F.count("hit").alias("n_with_violations"))


@query(f"WITH {LOG_SQL} SELECT event_id, ['error', 'warn', 'info'][level] AS channel, source || ' [' || hour(ts) || ':' || minute(ts) || ':' || second(ts) || ']: ' || coalesce(message, '') AS text FROM log WHERE level <= 3")
def log_display(spark, sf_dir):
    return ev.log_display(log_events(spark, sf_dir)).select("event_id", "channel", "text")


@query(f"WITH {LOG_SQL} SELECT event_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] ' || ['ERROR', 'WARN', 'INFO', 'DEBUG', 'FINE'][level] || ' ' || source || ' - ' || coalesce(message, '') AS text FROM log WHERE level <= 4")
def log_file_lines(spark, sf_dir):
    return ev.log_file(log_events(spark, sf_dir)).select("event_id", "text")


@query(f"WITH {LOG_SQL} SELECT ['error', 'warn', 'info'][level] AS channel, count(*) AS n FROM log WHERE level <= 3 GROUP BY 1")
def log_channel_counts(spark, sf_dir):
    return ev.log_display(log_events(spark, sf_dir)).groupBy("channel").agg(F.count("*").alias("n"))


@query(f"WITH {PROGRESS_SQL} SELECT engine, arg_max(percent, (ts, seq)) AS percent, arg_max(message, (ts, seq)) AS message FROM progress GROUP BY engine")
def progress_latest_per_engine(spark, sf_dir):
    return ev.latest_run_progress(run_progress(spark, sf_dir)).select("engine", "percent", "message")


@query(f"WITH {PROGRESS_SQL}, l AS (SELECT engine, arg_max(percent, (ts, seq)) AS percent FROM progress GROUP BY engine) SELECT count(*) FILTER (percent = 100) AS n_finished, count(*) AS n_engines, bool_and(percent = 100) AS done FROM l")
def progress_finished(spark, sf_dir):
    return ev.finished(ev.latest_run_progress(run_progress(spark, sf_dir)))


@query(f"WITH {PROGRESS_SQL}, l AS (SELECT floor(arg_max(percent, (ts, seq))) AS percent FROM progress GROUP BY engine) SELECT floor(avg(percent))::BIGINT AS percent, bool_and(percent = 100) AS done FROM l")
def progress_average(spark, sf_dir):
    cores = run_progress(spark, sf_dir).withColumnRenamed("engine", "core_idx")
    return ev.selection_progress(cores)


@query(f"WITH {RULES_SQL} SELECT engine, count(*) AS rule_count FROM rules WHERE list_contains(tags, 'Recommended') AND engine IN ('secrets', 'web', 'idle') GROUP BY engine")
def telemetry_engine_selection(spark, sf_dir):
    known = spark.createDataFrame([("secrets",), ("web",), ("idle",)], "engine string")
    return ev.engine_selection(selector.select(rules(spark), R), known)


@query(VIOLATIONS_SQL + ", e AS (SELECT DISTINCT engine FROM rules WHERE engine IN ('secrets', 'web', 'idle')) SELECT e.engine, count(v.rule) AS violation_count FROM e LEFT JOIN v USING (engine) GROUP BY e.engine")
def telemetry_engine_execution(spark, sf_dir):
    known = spark.createDataFrame([("secrets",), ("web",), ("idle",)], "engine string")
    return ev.engine_execution(violations(spark, sf_dir), rules(spark), known)


@query("SELECT event_type, (json_extract_string(props, '$.k')::INT // 10)::INT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def telemetry_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf_dir).groupBy("event_type", F.floor(k / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y_%m_%d_%H_%M_%S_%g') AS stamp, '    ' || props AS text FROM events")
def text_functions(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", compact_timestamp(F.col("ts")).alias("stamp"), indented(F.col("props")).alias("text"))


_LEVEL_TEXT = "severity || ' (' || ['Critical', 'High', 'Moderate', 'Low', 'Info'][severity] || ')'"
_SPOT_TEXT = "file || ' (' || start_line || ':' || start_column || '-' || start_line || ':' || end_column || ')'"


@query(VIOLATIONS_SQL + f""" SELECT row_number() OVER (ORDER BY severity, file, start_line, start_column, engine, rule) AS num, engine || ':' || rule AS title, {_LEVEL_TEXT} AS severity, engine, rule, message,
{_SPOT_TEXT} AS location, NULL::VARCHAR AS locations, CASE WHEN len(urls) = 1 THEN urls[1] END AS resource, CASE WHEN len(urls) > 1 THEN array_to_string(urls, ' ') END AS resources FROM v WHERE list_contains(tags, 'Legal')""")
def violations_details(spark, sf_dir):
    out = results.details(_ordered(violations(spark, sf_dir, "Legal")), collation=None)
    return out.withColumns({c: F.array_join(c, " ") for c in ("locations", "resources")})


@query(VIOLATIONS_SQL + f""", w AS (SELECT *, row_number() OVER (ORDER BY severity, file, start_line, start_column, engine, rule) AS num, CASE WHEN len(urls) > 1 THEN 11 ELSE 10 END AS w FROM v WHERE list_contains(tags, 'Legal'))
SELECT num, '=== ' || num || '. ' || rule || chr(10) || '    ' || rpad('severity:', w, ' ') || {_LEVEL_TEXT} || chr(10) || '    ' || rpad('engine:', w, ' ') || engine || chr(10) || '    ' || rpad('message:', w, ' ') || message || chr(10) || '    ' || rpad('location:', w, ' ') || {_SPOT_TEXT}
|| CASE len(urls) WHEN 0 THEN '' WHEN 1 THEN chr(10) || '    resource: ' || urls[1] ELSE chr(10) || '    resources:' || chr(10) || array_to_string(list_transform(urls, lambda u: '        ' || u), chr(10)) END AS text FROM w""")
def violations_detail_text(spark, sf_dir):
    return results.detail_text(results.details(_ordered(violations(spark, sf_dir, "Legal")), collation=None))


@query(VIOLATIONS_SQL + f""", u AS (SELECT *, CASE WHEN regexp_extract(file, '([0-9])[.][a-z]+$', 1)::INT % 2 = 1 THEN replace(replace(file, 'src', 'SRC'), 'pages', 'PAGES') ELSE file END AS named FROM v WHERE list_contains(tags, 'Legal'))
SELECT row_number() OVER (ORDER BY severity, lower(named), start_line, start_column, engine, rule) AS num, named AS file, rule FROM u""")
def violations_sorted_locale(spark, sf_dir):
    """Files of two cases stand among each other in a language's order, not capitals first."""
    odd = F.regexp_extract(_at()["file"], r"([0-9])\.[a-z]+$", 1).cast("int") % 2 == 1
    loud = F.replace(F.replace(_at()["file"], F.lit("src"), F.lit("SRC")), F.lit("pages"), F.lit("PAGES"))
    v = _ordered(violations(spark, sf_dir, "Legal"))
    v = v.withColumn("code_locations", F.transform("code_locations", lambda x: x.withField("file", F.when(odd, loud).otherwise(x["file"]))))
    return results.numbered(v).select("num", _at()["file"].alias("file"), "rule")


@query("""WITH m AS (SELECT '/ws/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT 'any_the' AS rule, sum(len(regexp_extract_all(lower(line), 'the')))::BIGINT AS n FROM m UNION ALL SELECT 'first_the', count(*) FILTER (contains(line, 'the')) FROM m""")
def violations_custom_rules(spark, sf_dir):
    custom = {"any_the": {"regex": "/the/gi", "file_extensions": [".txt"]}, "first_the": {"regex": "/the/", "file_extensions": [".TXT"]}, "no_such": {"regex": "/the/g", "file_extensions": [".cls"]}}
    engine = RegexEngine.from_config(custom)
    return engine.run(list(custom), files(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


def _document(spark, sf_dir, ending: str) -> DataFrame:
    """The lines of a results file, written by tasks and read again: a line is a violation."""
    path = shared_path(spark, "results") + ending
    sinks.write_results(violations(spark, sf_dir, "Legal"), path)
    return spark.read.text(path)


_LEGAL = VIOLATIONS_SQL + " SELECT <columns> FROM v WHERE list_contains(tags, 'Legal')"


@query(_LEGAL.replace("<columns>", "engine, rule, severity, message, file, start_line, start_column, end_column, array_to_string(urls, ' ') AS resources"))
def results_json_file(spark, sf_dir):
    rows = _document(spark, sf_dir, ".json").where("value like '{\"violation_ord\"%' or value like '{\"engine\"%'")
    v = rows.select(F.from_json(F.rtrim("value", F.lit(",")), VIOLATIONS + ", severity int").alias("v")).select("v.*")
    return v.select("engine", "rule", "severity", "message", *_place(), F.array_join("resource_urls", " ").alias("resources"))


@query(_LEGAL.replace("<columns>", "rule, ['error', 'error', 'warning', 'note', 'note'][severity] AS level, message, file, start_line, start_column, end_column"))
def results_sarif_file(spark, sf_dir):
    rows = _document(spark, sf_dir, ".sarif").where("value like '{\"ruleId\"%'")
    region = "region struct<startLine:int,startColumn:int,endColumn:int>"
    kind = f"ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,{region.replace(' ', ':', 1)}>>>"
    r = rows.select(F.from_json(F.rtrim("value", F.lit(",")), kind).alias("r")).select("r.*", F.col("r.locations")[0]["physicalLocation"].alias("at"))
    return r.select(F.col("ruleId").alias("rule"), "level", F.col("message.text").alias("message"), F.col("at.artifactLocation.uri").alias("file"), F.col("at.region.startLine").alias("start_line"), F.col("at.region.startColumn").alias("start_column"), F.col("at.region.endColumn").alias("end_column"))


@query(_LEGAL.replace("<columns>", "engine, rule, severity || ' (' || ['Critical', 'High', 'Moderate', 'Low', 'Info'][severity] || ')' AS severity, message, file, start_line::VARCHAR AS start_line"))
def results_html_file(spark, sf_dir):
    cells = F.regexp_extract_all("value", F.lit("<td>(.*?)</td>"), F.lit(1))
    rows = _document(spark, sf_dir, ".html").where("value like '<tr><td>%'").select(cells.alias("c"))
    return rows.select(*(F.col("c")[k].alias(n) for k, n in enumerate(("engine", "rule", "severity", "message", "file", "start_line"))))


_COUNTED = " SELECT engine, rule, severity, count(*) AS n FROM v WHERE {} GROUP BY ALL"


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("engine", "rule", "severity").agg(F.count("*").alias("n"))


for _n, _selector in SELECTIONS.items():  # each form of selector, by what its rules find
    _ALL[f"violations_select_{_n}"] = (lambda spark, sf_dir, x=_selector: _counted(violations(spark, sf_dir, x)), VIOLATIONS_SQL + _COUNTED.replace("{}", SELECTION_SQL[_n]))
_EFFECTIVE = VIOLATIONS_SQL + ", " + OVERRIDES_SQL + ", e AS (SELECT v.* REPLACE (eff.severity AS severity, eff.tags AS tags), v.severity AS default_severity FROM v JOIN eff USING (engine, rule))"


def _overridden(spark, sf_dir, select: str) -> DataFrame:
    chosen = selector.select(catalog.overridden(rules(spark), overrides(spark)), select)
    return results.enriched(REGISTRY.run(chosen, files(spark, sf_dir)), chosen)


@query(_EFFECTIVE + " SELECT engine, rule, severity, count(*) AS n FROM e WHERE list_contains(tags, 'CodeStyle') GROUP BY ALL")
def violations_override_then_select(spark, sf_dir):
    """Overrides come before the selection: a tag that a user gives selects."""
    return _counted(_overridden(spark, sf_dir, "codestyle"))


@query(_EFFECTIVE + " SELECT engine, rule, severity, default_severity, severity <> default_severity AS severity_modified, count(*) AS n FROM e GROUP BY ALL")
def violations_rule_diff(spark, sf_dir):
    """What changed rules find, under the severities of the user and of the catalogue."""
    diff = confdiff.rule_diff(catalog.overridden(rules(spark), overrides(spark)), rules(spark), True)
    found = _overridden(spark, sf_dir, "all").join(diff.drop("severity", "tags"), ["engine", "rule"])
    return found.groupBy("engine", "rule", "severity", "default_severity", "severity_modified").agg(F.count("*").alias("n"))


@query(VIOLATIONS_SQL + _COUNTED.replace("{}", "engine NOT IN ('idle', 'prose')"))
def violations_engine_disabled(spark, sf_dir):
    left = REGISTRY.without(["idle", "prose"])
    mine = catalog.enabled(left.catalogue(spark), catalog.disabled_engines(REGISTRY.names(spark), left.names(spark)))
    return _counted(results.enriched(left.run(mine, files(spark, sf_dir)), mine))


@query(VIOLATIONS_SQL + """, hit AS (SELECT DISTINCT engine, rule FROM v), r AS (SELECT rules.*, hit.rule IS NOT NULL AS is_hit FROM rules LEFT JOIN hit USING (engine, rule))
SELECT engine, min(CASE WHEN is_hit THEN 0 ELSE 1 END)::INT AS ord, count(*) FILTER (is_hit) AS n_rules FROM r GROUP BY engine""")
def engines_of_violations(spark, sf_dir):
    """Engines whose rules found something, then the others, with the number of such rules."""
    hit = rules(spark).join(violations(spark, sf_dir).select("engine", "rule").distinct(), ["engine", "rule"], "left_semi")
    per = catalog.per_engine(hit)
    return catalog.relevant_engines(hit, rules(spark)).join(per, "engine", "left").select("engine", "ord", F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


@query(VIOLATIONS_SQL + """, hit AS (SELECT DISTINCT engine, rule FROM v)
SELECT row_number() OVER (ORDER BY engine_ord, engine, rule)::INT AS num, rule, severity || ' (' || ['Critical', 'High', 'Moderate', 'Low', 'Info'][severity] || ')' AS severity, engine, array_to_string(tags, ', ') AS tags,
CASE WHEN len(urls) = 1 THEN urls[1] END AS resource, CASE WHEN len(urls) > 1 THEN array_to_string(urls, ' ') END AS resources, nullif(description, '') AS description FROM rules SEMI JOIN hit USING (engine, rule)""")
def rules_that_found(spark, sf_dir):
    """Details of the rules that found something."""
    hit = rules(spark).join(violations(spark, sf_dir).select("engine", "rule").distinct(), ["engine", "rule"], "left_semi")
    return results.rule_details(hit).withColumn("resources", F.array_join("resources", " "))


@query(VIOLATIONS_SQL + """, t AS (SELECT *, regexp_extract(file, '([0-9])[.]', 1)::INT % 3 AS k FROM v WHERE list_contains(tags, 'Privacy'))
SELECT row_number() OVER (ORDER BY severity, CASE k WHEN 0 THEN '' ELSE file END, CASE k WHEN 2 THEN start_line ELSE 0 END, CASE k WHEN 2 THEN start_column ELSE 0 END, (regexp_extract(file, '([0-9]+)[.][a-z]+$', 1)::BIGINT * 2 + (file LIKE '%.html')::INT) * 10000000000 + start_line::BIGINT * 100000 + start_column) AS num,
CASE k WHEN 2 THEN regexp_replace(file, '^/ws/', '') || ':' || start_line || ':' || start_column END AS location, message FROM t""")
def violations_missing_places(spark, sf_dir):
    """A third of the violations without a file, a third without a line: their place in the table is null."""
    v = violations(spark, sf_dir, "Privacy")
    number = F.regexp_extract(_at()["file"], r"(\d+)\.[a-z]+$", 1).cast("long") * 2 + _at()["file"].endswith(".html").cast("long")
    v = v.withColumn("violation_ord", number * 10**10 + _at()["start_line"] * 10**5 + _at()["start_column"])
    k = F.regexp_extract(_at()["file"], r"([0-9])\.", 1).cast("int") % 3
    less = lambda x: x.withField("file", F.when(k != 0, x["file"])).withField("start_line", F.when(k == 2, x["start_line"])).withField("start_column", F.when(k == 2, x["start_column"]))
    return results.table(v.withColumn("code_locations", F.transform("code_locations", less)), collation=None).select("num", "location", "message")


@query("""WITH g AS (SELECT event_id, ['1', 'critical', ' hIGH ', '3', 'Low', 'INFO'][event_id % 6 + 1] AS given, [1, 1, 2, 3, 4, 5][event_id % 6 + 1] AS severity FROM events)
SELECT given, severity, count(*) AS n FROM g GROUP BY ALL""")
def severities_of_events(spark, sf_dir):
    names = F.array(*map(F.lit, ("1", "critical", " hIGH ", "3", "Low", "INFO")))
    given = events(spark, sf_dir).select(F.get(names, (F.col("event_id") % 6).cast("int")).alias("given"))
    return given.groupBy("given", severity_of(F.col("given")).alias("severity")).agg(F.count("*").alias("n"))


@query(r"""SELECT event_id, '{"at":"' || event_type || '/x","/root/cfg/k":["say \"/root/cfg/q\"","a\"b",{"deep":"","n":' || user_id || '}],"other":"/root/cfgs/y"}' AS value FROM events""")
def values_with_relative_paths(spark, sf_dir):
    """Values at any depth become relative; keys, quotes inside strings and other folders stay."""
    root = F.lit("/root/cfg/")
    e = events(spark, sf_dir)
    listed = F.array(*(F.to_json(F.struct(x.alias("v"))).substr(F.lit(6), F.lit(10_000)) for x in (F.lit('say "/root/cfg/q"'), F.concat(root, F.lit('a"b')))))
    text = lambda c: F.regexp_replace(c, "[}]$", "")
    deep = F.concat(F.lit('{"deep":"/root/cfg/","n":'), F.col("user_id").cast("string"), F.lit("}"))
    value = F.concat(F.lit('{"at":"'), root, "event_type", F.lit('/x","/root/cfg/k":['), text(listed[0]), F.lit(","), text(listed[1]), F.lit(","), deep, F.lit('],"other":"/root/cfgs/y"}'))
    return e.select("event_id", confdiff.shortened(value, "/root/cfg").alias("value"))


@query("""WITH u AS (SELECT 'web' AS engine, 'u' || user_id AS field, arg_min(props, event_id) AS default_json, arg_max(props, event_id) AS value_json, bool_or(event_type = 'error') AS supplied, user_id % 5 <> 0 AS described FROM events GROUP BY user_id),
s AS (SELECT *, CASE WHEN NOT supplied AND value_json <> default_json THEN 'derived' WHEN value_json = default_json THEN 'default' ELSE 'modified' END AS status FROM u WHERE described)
SELECT engine, field, status, CASE WHEN status = 'modified' THEN value_json ELSE default_json END AS printed_json, CASE status WHEN 'derived' THEN value_json WHEN 'modified' THEN default_json END AS note_json FROM s""")
def fields_of_events(spark, sf_dir):
    """Settings from events: each user's first and last value."""
    user = F.col("user_id")
    per = events(spark, sf_dir).groupBy("user_id").agg(F.min_by("props", "event_id").alias("default_json"), F.max_by("props", "event_id").alias("value_json"), F.bool_or(F.col("event_type") == "error").alias("supplied"))
    fields = per.select(F.lit("web").alias("engine"), F.concat(F.lit("u"), user.cast("string")).alias("field"), user.cast("int").alias("field_ord"), F.when(user % 5 != 0, F.lit("text")).alias("description"), F.lit("string").alias("value_type"), "default_json", "value_json", "supplied")
    return confdiff.field_diff(fields).select("engine", "field", "status", "printed_json", "note_json")


@query(f"""WITH {FILES_SQL}, l AS (SELECT file, string_split(content, chr(10)) AS l FROM files WHERE ext = 'txt'),
w AS (SELECT file, unnest(range(1, len(l) - 1))::INT AS line, l FROM l WHERE len(l) >= 3),
b AS (SELECT file, line, l[line:line + 2] AS b FROM w WHERE len(list_filter(l[line:line + 2], lambda x: trim(x) = '')) = 0),
f AS (SELECT b, min({{'file': file, 'line': line}}) AS first FROM b GROUP BY b HAVING min(file) <> max(file))
SELECT file, min(line) AS start_line, min(line) + 2 AS end_line, first.file AS other_file, first.line AS other_line FROM b JOIN f USING (b) WHERE file <> first.file GROUP BY b, file, first""")
def violations_repeated_blocks(spark, sf_dir):
    """An engine that is a table function: three lines that an earlier document has too."""
    engine = duplicate_blocks(3)
    docs = ws.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    both = Registry([engine])
    place, other = (F.get("code_locations", F.lit(k)) for k in (0, 1))
    found = both.run(both.catalogue(spark), docs)
    return found.select(place["file"].alias("file"), place["start_line"].alias("start_line"), place["end_line"].alias("end_line"), other["file"].alias("other_file"), other["start_line"].alias("other_line"))


_PHRASE = "regexp_extract(text, '^([^ ]+ ){4}[^ ]+')"


@query(f"""WITH r AS (SELECT item_id, {_PHRASE} AS p FROM benchmark WHERE length({_PHRASE}) > 0), {FILES_SQL},
lines AS (SELECT file, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files WHERE ext = 'txt'),
s AS (SELECT item_id, p, file, n, string_split(line, p) AS parts FROM lines JOIN r ON contains(line, p)),
k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM s),
c AS (SELECT *, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(p) + 1 AS c FROM k)
SELECT 'benchmark' AS engine, 'item_' || item_id AS rule, file, n::INT AS start_line, c::INT AS start_column, (c + length(p))::INT AS end_column FROM c""")
def violations_table_rules(spark, sf_dir):
    """Rules from a table: the first five words of each benchmark item, looked for in all documents."""
    phrase = F.regexp_extract("text", "^([^ ]+ ){4}[^ ]+", 0)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", phrase.alias("phrase")).where("length(phrase) > 0")
    escaped = F.regexp_replace("phrase", r"([^\p{L}\p{N} ])", r"\\$1")
    mine = items.select(F.lit("benchmark").alias("engine"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("rule"), escaped.alias("pattern"), F.lit("A benchmark passage").alias("message"))
    docs = ws.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return trigrams.matched(mine, docs).select("engine", "rule", *_place())


@query("SELECT * FROM (VALUES ('1', 1), ('Critical', 1), (' hIGH ', 2), ('3', 3), ('low', 4), ('INFO', 5)) AS t(given, severity)")
def severities_parsed(spark, sf_dir):
    rows = spark.createDataFrame([(x, parse_severity(x)) for x in ("1", "Critical", " hIGH ", "3", "low", "INFO")], "given string, parsed int")
    same = F.when(F.col("parsed") == severity_of(F.col("given")), F.col("parsed"))
    return rows.select("given", same.alias("severity"))


@query("SELECT * FROM (VALUES ('a.csv', 'csv'), ('A.JSON', 'json'), ('x.sarif.json', 'sarif'), ('b.Sarif', 'sarif'), ('c.htm', 'html'), ('d.html', 'html'), ('e.json.xml', 'xml')) AS t(path, format)")
def output_formats(spark, sf_dir):
    return spark.createDataFrame([(p, sinks.format_of(p)) for p in ("a.csv", "A.JSON", "x.sarif.json", "b.Sarif", "c.htm", "d.html", "e.json.xml")], "path string, format string")


@query("SELECT * FROM (VALUES (NULL, 0, 'table'), (NULL, 2, NULL), ('detail', 0, 'detail'), ('table', 1, 'table')) AS t(asked, n_files, view)")
def view_choice(spark, sf_dir):
    asked = [(None, 0), (None, 2), ("detail", 0), ("table", 1)]
    return spark.createDataFrame([(v, n, view_of(v, ["out.csv"] * n)) for v, n in asked], "asked string, n_files int, view string")


ROOTED = [
    ("web", "p1", 0, "text", "string", '"a"', '"/root/cfg/sub/a"', True), ("web", "p2", 1, "text", "array", "[]", '["/root/cfg/x","/root/cfgs/y","z/root/cfg/"]', True),
    ("web", "p3", 2, "text", "object", "{}", '{"/root/cfg/k":"/root/cfg/v","n":1}', True), ("web", "p4", 3, "text", "string", '"/root/cfg/d"', '"/root/cfg/d"', True), ("web", "p5", 4, "text", "string", '"d"', '"/root/cfg/e"', False),
]


@query("""SELECT * FROM (VALUES ('p1', 'modified', '"sub/a"'), ('p2', 'modified', '["x","/root/cfgs/y","z/root/cfg/"]'), ('p3', 'modified', '{"/root/cfg/k":"v","n":1}'), ('p4', 'default', '"/root/cfg/d"'), ('p5', 'derived', '"d"')) AS t(field, status, printed_json)""")
def config_paths_relative(spark, sf_dir):
    return confdiff.field_diff(spark.createDataFrame(ROOTED, FIELDS), "/root/cfg").select("field", "status", "printed_json")


@query("SELECT * FROM (VALUES ('web', 'p1', '\"v\"', true), ('web', 'p2', '2', false), ('broken', 'p1', '\"raw\"', true), ('broken', 'p2', NULL, false)) AS t(engine, field, value_json, supplied)")
def config_validated_or_raw(spark, sf_dir):
    """The engine `broken` could not be made, so the user's raw values stand in."""
    described = spark.createDataFrame([(e, f) for e in ("web", "broken") for f in ("p1", "p2")], "engine string, field string")
    fields = described.withColumns({"value_json": F.lit(None).cast("string"), "supplied": F.lit(None).cast("boolean")})
    settings = "engine string, field string, value_json string"
    validated = spark.createDataFrame([("web", "p1", '"v"'), ("web", "p2", "2")], settings)
    raw = spark.createDataFrame([("web", "p1", '" v "'), ("broken", "p1", '"raw"')], settings)
    return confdiff.resolved(fields, validated, raw).select("engine", "field", "value_json", "supplied")


@query("SELECT * FROM (VALUES ('web', 'r1', 2, NULL), ('web', 'r2', NULL, ''), ('prose', 'r1', 5, 'a,b')) AS t(engine, rule, severity, tags)")
def config_overrides(spark, sf_dir):
    raw = {"rules": {"web": {"r1": {"severity": "High"}, "r2": {"tags": []}}, "prose": {"r1": {"severity": 5, "tags": ["a", "b"]}}}}
    return conf.overrides(spark, conf.checked(raw)).select("engine", "rule", "severity", F.array_join("tags", ",").alias("tags"))


@query("SELECT source, count(*) AS n_files FROM documents GROUP BY source")
def workspace_union(spark, sf_dir):
    """Two paths that overlap: each file counts once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = ws.union(ws.from_documents(docs), ws.from_documents(docs.where("doc_id % 3 = 0")))
    return both.groupBy(F.get(F.split("file", "/"), F.lit(2)).alias("source")).agg(F.count("*").alias("n_files"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(string_split(t, chr(10)), lambda x: '# ' || x), chr(10))) AS commented,
md5(CASE WHEN contains(t, chr(10)) THEN substr(t, 1, strpos(t, chr(10)) - 1) || '  # note ' || doc_id || substr(t, strpos(t, chr(10))) ELSE t || '  # note ' || doc_id END) AS inline,
md5(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN x = '' THEN x ELSE '    ' || x END), chr(10))) AS indented FROM d""")
def text_comments(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    note = F.concat(F.lit("note "), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.md5(commented(F.col("t"))).alias("commented"), F.md5(inline_comment(F.col("t"), note)).alias("inline"), F.md5(indented(F.col("t"))).alias("indented"))


@query("""SELECT event_id, 'id:        ' || event_id || chr(10) || CASE WHEN coalesce(props, '') = '' THEN 'props:' ELSE 'props:     ' || props END || chr(10) || 'user name: u' || user_id || chr(10) || 'none:' AS listed,
'=== Event ' || event_id || chr(10) || '    id: ' || event_id AS headed FROM events""")
def text_property_list(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    id_, user = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    pairs = F.array(pair("id", id_), pair("props", F.col("props")), pair("user name", user), pair("none", F.lit(None)))
    headed = header_and_body(F.concat(F.lit("Event "), id_.cast("string")), F.array(pair("id", id_)))
    return events(spark, sf_dir).select("event_id", property_list(pairs).alias("listed"), headed.alias("headed"))


@query("SELECT user_id, ((epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) // 1000)::BIGINT AS seconds, 'user ' || user_id || ' sent ' || count(*) || ' events' AS text FROM events GROUP BY user_id")
def elapsed_and_messages(spark, sf_dir):
    per = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return per.select("user_id", elapsed_seconds(F.col("first"), F.col("last")).alias("seconds"), message("user %d sent %d events", F.col("user_id"), F.col("n")).alias("text"))


@query("SELECT event_id, event_type AS event, (epoch_us(ts) // 1000)::VARCHAR AS timestamp, 'u' || user_id AS sender, 4 AS n_keys FROM events")
def telemetry_events(spark, sf_dir):
    """The event's own data, then its name, time and id, which win over data of the same key."""
    data = F.create_map(F.lit("sender"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("event"), F.lit("theirs"))
    sent = ev.telemetry(events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("event"), data.alias("data")))
    return sent.select("event_id", *(F.col("data")[k].alias(k) for k in ("event", "timestamp", "sender")), F.size("data").alias("n_keys"))


@query("SELECT source, count(*) AS n FROM (SELECT event_type AS source FROM events WHERE event_type <> 'error' UNION ALL SELECT 'Core' FROM events WHERE event_type = 'error') GROUP BY source")
def log_sources(spark, sf_dir):
    """The core's and the engines' events in one log."""
    e = events(spark, sf_dir).select("ts", F.col("event_type").alias("engine"), F.col("props").alias("message"))
    both = ev.engine_events(e.where("engine <> 'error'")).unionByName(ev.core_events(e.where("engine = 'error'").drop("engine")))
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1::BIGINT, NULL, 'no place'), (2::BIGINT, 'a.ts:3:4', 'whole'), (3::BIGINT, NULL, 'no line')) AS t(num, location, message)")
def table_missing_places(spark, sf_dir):
    """A location without a file, a line or a column is null in the table."""
    at = lambda file, line, column: [(file, line, column, None, None, None)] if file else []
    rows = [(0, "e", "r", "no place", at(None, None, None), 0, []), (1, "e", "r", "whole", at("/w/a.ts", 3, 4), 0, []), (2, "e", "r", "no line", at("/w/b.ts", None, None), 0, [])]
    return results.table(spark.createDataFrame(rows, VIOLATIONS).withColumn("severity", F.lit(2)), collation=None).select("num", "location", "message")


QUERIES = {n: f for n, (f, _) in _ALL.items()}
ORACLE = {n: sql for n, (_, sql) in _ALL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommended rules over all files: violations and files by severity."""
    v = violations(spark, sf_dir, R)
    return v.groupBy("severity").agg(F.count("*").alias("n_violations"), F.count_distinct(_at()["file"]).alias("n_files")).orderBy("severity")
