import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulegrain.operators import selector
from rulegrain.queries import REGISTRY, rules
from rulegrain.sources.engines import LiteralIndex, RegexEngine, RegexRule, Registry, begins
from rulegrain.sources.factors import required


def found(spark, rule, *contents, ext="txt"):
    files = spark.createDataFrame([(f"/w/{k}.{ext}", ext, c) for k, c in enumerate(contents)], "file string, ext string, content string")
    rows = RegexEngine([rule]).run([rule.name], files).select(F.col("code_locations")[0].alias("at")).collect()
    return sorted((int(r["at"].file[3:].split(".")[0]), r["at"].start_line, r["at"].start_column, r["at"].end_column) for r in rows)


def plain(pattern, *contents):
    return [(k, n + 1, m.start() + 1, m.end() + 1) for k, c in enumerate(contents) for n, line in enumerate(c.split("\n")) for m in re.finditer(pattern, line)]


TEXTS = ("foo foo bar\nbar foo foo", 'a "b" \'c\' "d', "", "\n\nx", "ab ab  ab\tfoo", "Ünder foo foo éé", "xxx x", "one\r\ntwo")


@pytest.mark.parametrize("pattern", [r"(\w+) \1", r"([\"']).*?\1", r"(?<q>[\"'])\w\k<q>", r"foo|bar", r"\bfoo", r"foo$", r"^foo", r"x", r"[a-z]{3}", r"(?<=o) (?=f)", r"(a)(b)", r"é+", r"o{2}"])
def test_same_places_as_plain_search(spark, pattern):
    python = re.sub(r"\(\?<q>", "(?P<q>", pattern).replace(r"\k<q>", "(?P=q)")
    assert found(spark, RegexRule("r", pattern), *TEXTS) == plain(python, *TEXTS)


@pytest.mark.parametrize("pattern", ["x*", r"\b", "(?=o)", "a?"])
def test_empty_matches(spark, pattern):
    texts = ("foo", "xxaxx", "", "ob xx")
    want = [(k, 1, m.start() + 1, m.end() + 1) for k, c in enumerate(texts) for m in re.finditer(pattern, c)]
    assert found(spark, RegexRule("r", pattern), *texts) == want


def test_many_matches_of_a_line_take_linear_time(spark):
    rule = RegexRule("r", "ab")
    found(spark, rule, "ab")
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        got = found(spark, rule, "ab " * n + "c" * 200_000)
        took.append(time.perf_counter() - began)
        assert len(got) == n and got[-1] == (0, 1, 3 * n - 2, 3 * n)
    assert took[1] < 8 * took[0] + 5


def test_first_match_only_and_extensions(spark):
    assert found(spark, RegexRule("r", "a", every=False), "a a\na") == [(0, 1, 1, 2), (0, 2, 1, 2)]
    assert found(spark, RegexRule("r", "a", ("ts",)), "a") == [] and len(found(spark, RegexRule("r", "a", ("ts",)), "a", ext="ts")) == 1
    assert found(spark, RegexRule("r", "[0-9]{2}", ("ts",)), "12") == [] and len(found(spark, RegexRule("r", "[0-9]{2}", ("ts",)), "12", ext="ts")) == 1


def test_hundreds_of_rules_are_one_scan(spark):
    many = [RegexRule(f"r{k}", f"word{k}\\b") for k in range(400)]
    registry = Registry([RegexEngine(many[:200], "one"), RegexEngine(many[200:], "two")])
    files = spark.createDataFrame([(f"/w/{k}", "txt", f"a word{k} b\nword{k + 1}x") for k in range(50)], "file string, ext string, content string")
    out = registry.run(registry.catalogue(spark), files)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan and "rlike" not in plan.lower()
    assert sorted((r.engine, r.rule) for r in out.collect()) == sorted(("one", f"r{k}") for k in range(50))


def test_regex_engines_scan_each_table_once(spark):
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), F.lit("txt").alias("ext"), F.col("text").alias("content"))
    plan = REGISTRY.run(rules(spark), files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


WORDS = st.sampled_from(["foo", "Bar", "a", "k", "é", ".", "@", "0", "xyz "])
ATOM = st.one_of(WORDS.map(re.escape), st.sampled_from(["[a-z]", "[ab]", ".", r"\w", r"\d", "[^x]", "(?i:FOO)", r"\bfoo"]))
PATTERN = st.recursive(ATOM, lambda p: st.one_of(st.lists(p, min_size=1, max_size=3).map("".join), st.lists(p, min_size=1, max_size=3).map(lambda x: f"(?:{'|'.join(x)})"), st.tuples(p, st.sampled_from(["*", "+", "?", "{2}", "{1,3}", "{0,2}"])).map(lambda x: f"(?:{x[0]}){x[1]}")), max_leaves=8)


@settings(max_examples=500, deadline=None)
@given(PATTERN, st.lists(WORDS, max_size=12).map("".join))
def test_every_match_holds_a_required_literal(pattern, text):
    literals = required(pattern)
    for m in re.finditer(pattern, text):
        assert literals is None or any(x in m[0].lower() for x in literals)


def test_required_literals():
    assert required("TODO|FIXME") == ["fixme", "todo"] and required("[Ll]icen[sc]e") == ["licence", "license"] and required("[A-Z]{8,}") is None
    assert required(r"\Qa.b\E") is None and required("[a-z&&[^b]]x") is None and required("(") is None and required("") is None
    assert required("(?iu)sky") == ["y"] and required("(?i)sky") == ["sky"]


def test_index_finds_lines_in_any_case():
    index = LiteralIndex([(["foo"], ()), (None, ("md",)), (["bar"], ("txt",))])
    assert index.candidates("İ FOO\nx\nBar foo", "txt", []) == [(0, 0, "İ FOO"), (0, 2, "Bar foo"), (2, 2, "Bar foo")]
    assert index.candidates("bar\n", "md", [1]) == [(1, 0, "bar"), (1, 1, "")]
    assert LiteralIndex([]).candidates("x", "txt", []) == []


def test_a_selector_of_no_tokens_names_nothing(spark):
    assert selector.select(rules(spark), ":").count() == 0 and selector.select(rules(spark), [":", "web::2"]).count() == 1


def test_begins_are_summed():
    import numpy as np
    import pandas as pd

    got = begins.func(pd.Series([np.array([3, 4]), np.array([1, 0, 2])]), pd.Series([np.array([1, 2]), np.array([0, 1])]))
    assert [x.tolist() for x in got] == [[2, 5], [1, 3]]


def test_candidates_hold_one_content_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from rulegrain.sources.engines import _candidates

    n = 2_000
    batch = pa.RecordBatch.from_arrays([pa.array([f"/w/{k}.txt" for k in range(n)]), pa.array(["txt"] * n), pa.array(["ab " * 5_000 + "\nfoo"] * n), pa.array([None] * n, pa.list_(pa.int32()))], ["file", "ext", "content", "everywhere"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in _candidates([(["foo"], ())])(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == n and peak < 10_000_000  # all contents at once are 30 MB
