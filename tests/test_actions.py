import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from rulegrain.plans import api, sinks
from rulegrain.queries import REGISTRY
from rulegrain.sources import config, engines, messages, workspace


@pytest.fixture()
def tree(tmp_path):
    for d in (".", "und-a", "und-b", ".dot-a", ".dot-b"):
        (tmp_path / d).mkdir(exist_ok=True)
    for p in ("und-1.txt", "und-2.txt", ".dot-1.txt", ".dot-2.txt", "und-a/und-2a.txt", "und-a/.dot-2a.txt", "und-b/und-2b.txt", "und-b/.dot-2b.txt", ".dot-a/und-1a.txt", ".dot-a/.dot-1a.txt", ".dot-b/und-1b.txt", ".dot-b/.dot-1b.txt"):
        (tmp_path / p).write_text("x")
    return tmp_path


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("und*1.txt", ["und-1.txt"]), ("und*", ["und-1.txt", "und-2.txt"]), ("*", ["und-1.txt", "und-2.txt"]), (".*", [".dot-1.txt", ".dot-2.txt"]),
        (".*/.*", [".dot-a/.dot-1a.txt", ".dot-b/.dot-1b.txt"]), ("*/.*", ["und-a/.dot-2a.txt", "und-b/.dot-2b.txt"]), (".**/*", [".dot-a/und-1a.txt", ".dot-b/und-1b.txt"]),
        ("*/*", ["und-a/und-2a.txt", "und-b/und-2b.txt"]), (r"und-a\*", ["und-a/und-2a.txt"]), ("und-[1]?txt", []), ("und-?.txt", ["und-1.txt", "und-2.txt"]), ("und-a", ["und-a"]), ("missing", ["missing"]),
    ],
)
def test_globs(tree, pattern, want):
    assert workspace.expand([pattern], str(tree)) == want
    assert sorted(workspace.expand([f"{tree}/{pattern}"])) == sorted(f"{tree}/{w}".replace("\\", "/") for w in want)


def test_negation_and_defaults(tree):
    with pytest.raises(ValueError):
        workspace.expand(["a!b"])
    assert workspace.resolve(None, None, True) == (["."], None) and workspace.resolve(None, None, False) == (None, None) and workspace.resolve(None, ["t"], False) == (["."], ["t"])


@pytest.fixture()
def project(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.ts").write_text("// TODO one\nfine\n  todo two\n")
    (src / "b.txt").write_text("todo in text\n")
    conf = tmp_path / "rulegrain.json"
    conf.write_text(json.dumps({"engines": {"regex": {"custom_rules": {"NoTodos": {"regex": "/todo/gi", "file_extensions": [".ts"], "description": "No notes", "severity": "high"}}}}}))
    return src, conf


def test_run_with_custom_rule(spark, project, tmp_path):
    src, conf = project
    out = [str(tmp_path / n) for n in ("r.csv", "r.json", "r.sarif.json", "r.html", "r.xml")]
    got = api.run(spark, [str(src)], config_file=str(conf), output_file=out, severity_threshold="high", view="detail")
    assert got.gate.failed and got.gate.exit_code == 2 and got.gate.n == 2
    places = sorted((r.code_locations[0].file, r.code_locations[0].start_line, r.code_locations[0].start_column) for r in got.violations.collect())
    assert places == [(str(src / "a.ts"), 1, 4), (str(src / "a.ts"), 3, 3)]
    assert got.lines[:2] == ["Violations: 2 in 1 files", "    2 High"]
    rows = [r for f in glob.glob(out[0] + "/part*") for r in csv.DictReader(open(f))]
    assert len(rows) == 2 and rows[0]["rule"] == "NoTodos"
    assert len(json.load(open(out[1]))["violations"]) == 2
    sarif = json.load(open(out[2]))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == 2 and sarif["runs"][0]["tool"]["driver"]["name"] == "regex"
    assert open(out[3]).read().count("<tr>") == 3 and os.path.isdir(out[4])
    assert [r.num for r in got.view.collect()] == [1, 2]
    assert {r.engine: r.violation_count for r in got.telemetry["engine_execution"].collect()} == {"regex": 2}


def test_targets(spark, project):
    src, conf = project
    assert api.run(spark, [str(src)], target=[str(src / "b.txt")], config_file=str(conf)).violations.count() == 0
    assert api.run(spark, [str(src)], target=[str(src / "*.ts")], config_file=str(conf)).violations.count() == 2
    with pytest.raises(ValueError, match="outside"):
        api.run(spark, [str(src)], target=["/nowhere/x"], config_file=str(conf))


def test_rules_action(spark, tmp_path):
    path = str(tmp_path / "rules.json")
    got = api.rules(spark, rule_selector="web:Security", registry=REGISTRY, output_file=path, view="table")
    assert [r.name for r in got.view.collect()] == ["inline_script"] and [r["rule"] for r in json.load(open(path))["rules"]] == ["inline_script"]
    assert api.rules(spark, rule_selector="nothing", registry=REGISTRY).rules.count() == 0
    with pytest.raises(ValueError):
        api.rules(spark, output_file="x.csv", registry=REGISTRY)


def test_config_action(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    conf = tmp_path / "c.json"
    conf.write_text(json.dumps({"log_level": "warn", "rules": {"web": {"plain_http": {"severity": "Critical"}, "nested_bold": {"tags": []}}}, "engines": {"idle": {"disable_engine": True}}}))
    text = api.config(spark, config_file=str(conf), registry=REGISTRY, output_file=str(tmp_path / "out.yml"))
    made = yaml.safe_load(text)
    assert made["log_level"] == 2 and "# Modified from: 4" in text and made["config_root"] is None
    assert made["rules"]["web"]["plain_http"]["severity"] == 1 and "# Modified from: 3" in text and made["rules"]["web"]["nested_bold"]["tags"] == []
    assert made["rules"]["prose"] == {} and made["engines"]["idle"]["disable_engine"] is True and made["engines"]["web"]["disable_engine"] is False
    assert open(tmp_path / "out.yml").read() == text
    assert not sinks.write_config("x", str(tmp_path / "out.yml"), overwrite=lambda p: False)
    every = yaml.safe_load(api.config(spark, rule_selector="web", registry=REGISTRY, include_unmodified_rules=True))
    assert list(every["rules"]) == ["web"] and len(every["rules"]["web"]) == 3


def test_formats_and_views():
    assert [sinks.format_of(p) for p in ("a.csv", "A.HTML", "a.htm", "a.json", "a.sarif", "a.sarif.json", "a.xml")] == ["csv", "html", "html", "json", "sarif", "sarif", "xml"]
    with pytest.raises(ValueError):
        sinks.writers(["a.csv", "a.txt"])
    assert api.view_of(None, []) == "table" and api.view_of(None, ["x"]) is None and api.view_of("detail", ["x"]) == "detail"
    with pytest.raises(ValueError):
        api.view_of("list", [])


def test_config_sources(tmp_path):
    assert config.find(None, str(tmp_path)) is None
    (tmp_path / "rulegrain.yml").write_text("log_level: 5")
    (tmp_path / "rulegrain.yaml").write_text('{"log_level": "error"}')
    assert config.find("x", str(tmp_path)) == "x" and config.load(folder=str(tmp_path)).log_level == 1
    with pytest.raises(ValueError, match="no/such"):
        config.checked({"log_folder": "/no/such"})
    with pytest.raises(ValueError, match="severity"):
        config.checked({"rules": {"e": {"r": {"severity": 9}}}})
    assert config.checked({"rules": {"e": {"r": {"severity": "Info"}}}}).rules["e"]["r"]["severity"] == 5


def test_engines(spark):
    assert engines.regex_literal("/a.b/gi") == "(?i)a.b"
    for bad in ("todo", "/x/y"):
        with pytest.raises(ValueError):
            engines.regex_literal(bad)
    with pytest.raises(ValueError):
        engines.Registry().add(engines.RegexEngine()).add(engines.RegexEngine())
    with pytest.raises(ModuleNotFoundError):
        engines.Registry().load("no_such_module_here")

    class Broken:
        name = "broken"

        def describe(self, spark, files):
            raise RuntimeError("can't list rules")

    with pytest.raises(RuntimeError):
        api.rules(spark, registry=engines.Registry([Broken()]))


def test_only_selected_engines_run(spark):
    files = spark.createDataFrame([("/f.html", "html", "<script>\nhttp://x")], "file string, ext string, content string")
    got = api.run(spark, rule_selector="web:Recommended", registry=REGISTRY, files=files)
    assert sorted(r.rule for r in got.violations.collect()) == ["inline_script", "plain_http"]


def test_messages_and_documented_rules(spark, tmp_path):
    (tmp_path / "b.md").write_text("# first\n\nHello %s, %d.\n\n# list\n\n- a\n- b\n")
    path = str(tmp_path / "b.md")
    assert messages.message(path, "first", "x", 3) == "Hello x, 3." and messages.messages(path, "list") == ["a", "b"]
    with pytest.raises(KeyError):
        messages.message(path, "none")
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "MyRule.md").write_text("MyRule\n===\nViolation\n\nText\n\nPriority\n\nMedium (3)\n")
    row = engines.documented(spark, str(docs)).first()
    assert (row.page, row.rule, row.severity) == ("MyRule.md", "MyRule", 3)


def test_scan_reads_every_file_once_by_its_own_name(spark, tmp_path):
    (tmp_path / "in/.deep/_er").mkdir(parents=True)
    names = ["a b.ts", "c+d.ts", "e%20f.ts", ".dot.ts", "_und.ts", ".deep/x.ts", ".deep/_er/y.ts"]
    for n in names:
        (tmp_path / "in" / n).write_text(f"{n}\r\nend")
    want = sorted((str(tmp_path / "in" / n), "ts", f"{n}\r\nend") for n in names)
    got = workspace.scan(spark, [str(tmp_path / "in"), str(tmp_path / "in/a b.ts"), str(tmp_path / "in/.deep")])
    assert sorted(map(tuple, got.collect())) == want
    assert [r.file for r in workspace.scan(spark, [str(tmp_path / "in/.dot.ts"), str(tmp_path / "in/c+d.ts")]).orderBy("file").collect()] == [str(tmp_path / "in/.dot.ts"), str(tmp_path / "in/c+d.ts")]
    assert workspace.tops(["/a/b", "/a", "/ab", "/a/b/c", "s3://x/y/", "s3://x/y/z"]) == ["/a", "/ab", "s3://x/y"]


def test_run_writes_its_log(spark, project, tmp_path):
    src, conf = project
    (tmp_path / "logs").mkdir()
    raw = json.loads(conf.read_text()) | {"log_folder": str(tmp_path / "logs"), "log_level": "info"}
    conf.write_text(json.dumps(raw))
    got = api.run(spark, [str(src)], config_file=str(conf))
    lines = open(got.log).read().splitlines()
    assert len(lines) == 2 and lines[0].endswith("INFO regex - 2 violations found") and lines[1] == sinks.LOG_END
    with pytest.raises(ValueError, match="outside"):
        api.run(spark, [str(src)], target=["/nowhere/x"], config_file=str(conf))
    assert any("ERROR Core - targets outside" in open(f).read() for f in glob.glob(f"{tmp_path}/logs/*.log"))


def test_config_goes_on_with_a_wrong_engine(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    conf = tmp_path / "c.json"
    conf.write_text(json.dumps({"log_folder": str(tmp_path / "logs"), "engines": {"regex": {"custom_rules": {"Bad": {"regex": "no literal"}}}}}))
    assert "log_folder:" in api.config(spark, config_file=str(conf), registry=REGISTRY)
    (log,) = glob.glob(f"{tmp_path}/logs/*.log")
    assert "ERROR regex - 'no literal' is no /pattern/flags" in open(log).read()
    with pytest.raises(ValueError):
        api.run(spark, ["."], config_file=str(conf))


def test_texts_before_after_and_instead(spark, project, tmp_path):
    src, conf = project
    said, shown = [], []
    got = api.run(spark, [str(src)], config_file=str(conf), view="detail", say=said.append)
    assert said == [got.before] == [["No log is kept"]]
    assert got.text().orderBy("num").first().text == f"=== 1. NoTodos\n    severity: 2 (High)\n    engine:   regex\n    message:  No notes\n    location: {src}/a.ts (1:4-1:8)"
    assert api.run(spark, [str(src)], config_file=str(conf)).text().orderBy("num").first().text == "1 | 2 (High) | regex:NoTodos | a.ts:1:4 | No notes"
    logged = tmp_path / "logs"
    logged.mkdir()
    with_log = tmp_path / "with.json"
    with_log.write_text(json.dumps({"log_folder": str(logged)}))
    got = api.run(spark, [str(src)], config_file=str(with_log), registry=REGISTRY)
    assert got.before == ["Log goes to:", f"    {got.log}"] and os.path.exists(got.log)
    out = tmp_path / "c.yml"
    text = api.config(spark, registry=REGISTRY, output_file=str(out), view=shown.append)
    assert shown == [] and out.read_text() == text
    api.config(spark, registry=REGISTRY, output_file=str(out), overwrite=lambda p: False, view=shown.append)
    api.config(spark, registry=REGISTRY, view=shown.append)
    assert shown == [text, text]
