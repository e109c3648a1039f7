import json

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import catalog, confdiff, selector, summary
from rulegrain.schema import FIELDS, OVERRIDES, RULES, label, parse_severity, severity_of

R = "Recommended"
STUBS = [
    ("one", 0, "a", 0, 4, [R, "CodeStyle"]), ("one", 0, "b", 1, 2, [R, "Security"]), ("one", 0, "c", 2, 3, [R, "Performance", "Custom"]), ("one", 0, "d", 3, 4, ["CodeStyle"]),
    ("one", 0, "e", 4, 3, ["Performance"]), ("two", 1, "f", 0, 3, [R, "Security"]), ("two", 1, "g", 1, 4, ["Performance", "Custom"]), ("two", 1, "h", 2, 2, [R, "BestPractice"]),
]


@pytest.fixture(scope="module")
def stubs(spark):
    return spark.createDataFrame([(*r, "text", ["u"]) for r in STUBS], RULES)


@pytest.mark.parametrize(
    "given,want",
    [
        ("all", "abcdefgh"), ("CodeStyle", "ad"), ("Codestyle", "ad"), (R, "abcfh"), ("NonsensicalTag", ""), ("one:Security", "b"), ("one:3", "ce"), ("one:Recommended:2", "b"),
        (["one:3", "two:Recommended"], "cefh"), ("one:3,two:Recommended", "cefh"), ("one", "abcde"), ("one:all", "abcde"), ("h", "h"), ("high", "bh"), (["b", "b,B"], "b"), ([], ""), ("ONE:custom", "c"),
    ],
)
def test_selectors(stubs, given, want):
    assert "".join(sorted(r.rule for r in selector.select(stubs, given).collect())) == want


def test_default_selector_and_null_tags(spark, stubs):
    assert selector.select(stubs).count() == 5
    odd = spark.createDataFrame([("e", 0, "r", 0, 1, None, None, None)], RULES)
    assert selector.select(odd, "all").count() == 1 and selector.select(odd, "x").count() == 0


def test_overrides_replace_before_selection(spark, stubs):
    over = spark.createDataFrame([("one", "a", None, [R, "Beep"]), ("one", "b", 1, None), ("two", "h", None, []), ("no", "rule", 1, None)], OVERRIDES)
    got = {r.rule: (r.severity, r.tags) for r in catalog.overridden(stubs, over).collect()}
    assert got["a"] == (4, [R, "Beep"]) and got["b"] == (1, [R, "Security"]) and got["h"] == (2, []) and len(got) == 8
    assert {r.rule for r in selector.select(catalog.overridden(stubs, over), "CodeStyle").collect()} == {"d"}


def test_rule_diff(spark, stubs):
    over = spark.createDataFrame([("one", "a", 4, None), ("one", "b", 1, None), ("two", "f", None, ["Security", R])], OVERRIDES)
    user = catalog.overridden(stubs, over)
    diff = {r.rule: (r.severity_modified, r.tags_modified) for r in confdiff.rule_diff(user, stubs).collect()}
    assert diff == {"b": (True, False), "f": (False, True)}
    assert confdiff.rule_diff(user, stubs, include_unmodified=True).count() == 8
    assert confdiff.rule_diff(user, stubs.where("rule <> 'b'")).count() == 1  # no default: the same


def test_field_diff_and_paths(spark):
    rows = [
        ("e", "p1", 0, "t", "string", '"default1"', '"foo"', True), ("e", "p2", 1, None, None, None, '"bar"', True), ("e", "p4", 2, "t", "object", '{"a":10,"b":true}', '{"a":42,"b":false}', True),
        ("e", "p6", 3, "t", "string", "null", None, False), ("e", "p7", 4, "t", "string", "null", '"/root/logs"', False), ("e", "p8", 5, "t", "object", "{}", '{"sub":["/root/x/y.txt","other","/roots"],"/root/k":"/root/z"}', True),
    ]
    got = {r.field: (r.status, r.printed_json, r.note_json) for r in confdiff.field_diff(spark.createDataFrame(rows, FIELDS), "/root").collect()}
    assert got["p1"] == ("modified", '"foo"', '"default1"') and "p2" not in got and got["p6"] == ("default", "null", None)
    assert got["p7"] == ("derived", "null", '"/root/logs"')
    assert json.loads(got["p8"][1])["sub"] == ["x/y.txt", "other", "/roots"]


def test_severities(spark):
    assert [parse_severity(x) for x in (1, "2", "Moderate", "LOW", "info")] == [1, 2, 3, 4, 5]
    for bad in (0, "7", "beep", ""):
        with pytest.raises(ValueError):
            parse_severity(bad)
    df = spark.createDataFrame([("High",), ("5",), (None,)], "t string")
    assert [r[0] for r in df.select(severity_of(F.col("t"))).collect()] == [2, 5, None]
    with pytest.raises(Exception, match="no such severity"):
        spark.createDataFrame([("beep",)], "t string").select(severity_of(F.col("t"))).collect()
    assert spark.range(1).select(label(F.lit(3))).first()[0] == "Moderate"


def violations(spark, levels):
    rows = [(k, "one", "b", "m", [("f", 1, 1, None, None, None)], 0, [], n) for k, n in enumerate(levels)]
    return spark.createDataFrame(rows, "violation_ord long, engine string, rule string, message string, code_locations array<struct<file:string,start_line:int,start_column:int,end_line:int,end_column:int,comment:string>>, primary_location_index int, resource_urls array<string>, severity int")


@pytest.mark.parametrize("levels,threshold,want", [([2], 3, (True, 2)), ([2], 2, (True, 2)), ([3], 1, (False, 0)), ([4, 2, 1], "low", (True, 1)), ([], 5, (False, 0)), ([1], None, (False, 0))])
def test_threshold(spark, levels, threshold, want):
    g = summary.gate(violations(spark, levels), threshold)
    assert (g.failed, g.exit_code) == want


def test_summaries(spark, stubs):
    assert summary.results_lines(violations(spark, [2, 4])) == ["Violations: 2 in 1 files", "    1 High", "    1 Low"]
    assert summary.results_lines(violations(spark, [])) == ["Violations: 0"]
    assert summary.rules_lines(selector.select(stubs)) == ["Rules: 5 from 2 engines", "    3 one", "    2 two"]
    per = {r.engine: r.n for r in summary.by_engine(violations(spark, [1, 1]), stubs).collect()}
    assert per == {"one": 2, "two": 0}


def test_patterns_that_tell_line_ends_from_breaks_are_found(spark):
    from rulegrain.sources.engines import RegexEngine, RegexRule

    files = spark.createDataFrame([("f", "txt", "a\nx foo\nb")], "file string, ext string, content string")
    patterns = (r"foo(?!\s)", r"foo\z", r"(?<!\n)x", r"\Ax", r"foo\s*+$", "(?i)FOO", "(?:x) f")
    rules = [RegexRule(str(k), p) for k, p in enumerate(patterns)]
    for r in rules:
        assert RegexEngine([r]).run([r.name], files).count() == 1, r.pattern


def test_every_match_of_a_line_at_its_place(spark):
    from rulegrain.sources.engines import RegexEngine, RegexRule

    files = spark.createDataFrame([("a.ts", "ts", "foobar foo TODO\nx todo, Todo\n\u00e9\u00e9 foo foo")], "file string, ext string, content string")

    def places(engine):
        rows = engine.run([r.name for r in engine.rules], files).select("code_locations").collect()
        return sorted((p.start_line, p.start_column, p.end_column) for r in rows for p in r.code_locations)

    assert places(RegexEngine([RegexRule("w", r"\bfoo\b")])) == [(1, 8, 11), (3, 4, 7), (3, 8, 11)]
    assert places(RegexEngine([RegexRule("a", r"^x|foo")])) == [(1, 1, 4), (1, 8, 11), (2, 1, 2), (3, 4, 7), (3, 8, 11)]
    config = lambda flags: {"NoTodos": {"regex": f"/todo/{flags}", "file_extensions": [".ts"], "description": "d"}}
    assert places(RegexEngine.from_config(config("gi"))) == [(1, 12, 16), (2, 3, 7), (2, 9, 13)]
    assert places(RegexEngine.from_config(config("i"))) == [(1, 12, 16), (2, 3, 7)]
    assert places(RegexEngine([RegexRule("e", r"(?=x)")])) == [(2, 1, 1)]
