import pytest
from pyspark.sql import functions as F

from rulegrain import functions as fn
from rulegrain.operators import results
from rulegrain.schema import RULES, VIOLATIONS


def loc(file, line=None, column=None, end=None, end_column=None, comment=None):
    return (file, line, column, end, end_column, comment)


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([("e", 0, "A", 0, 4, ["t"], "d", ["rule-url"]), ("e", 0, "B", 1, 2, ["t", "u"], "", [])], RULES)


def table(spark, rules, rows):
    v = spark.createDataFrame([(k, "e", rule, "msg", places, main, urls) for k, (rule, places, main, urls) in enumerate(rows)], VIOLATIONS)
    return results.enriched(v, rules)


def test_order_and_numbers(spark, rules):
    v = table(spark, rules, [("A", [loc("fileA", 20, 1)], 0, []), ("A", [loc("fileA", 1, 1)], 0, []), ("A", [loc("fileZ", 1, 1)], 0, []), ("B", [loc("fileZ", 20, 1)], 0, []), ("A", [loc(None)], 0, []), ("A", [loc("fileA", 1, 1)], 0, [])])
    want = [3, 4, 1, 5, 0, 2]
    assert [r.violation_ord for r in results.ordered(v).collect()] == want
    assert [r.violation_ord for r in results.numbered(v).orderBy("num").collect()] == want
    assert [r.num for r in results.numbered(v).orderBy("num").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r.violation_ord for r in results.most_severe(v, 2).collect()] == want[:2]


def test_locale_order(spark, rules):
    v = table(spark, rules, [("A", [loc(f, 1, 1)], 0, []) for f in ("b", "B", "a", "A")])
    assert [r.code_locations[0].file for r in results.ordered(v).collect()] == ["a", "A", "b", "B"]


def test_locations(spark, rules):
    v = table(spark, rules, [("A", [loc("/run/fileA", 20, 1), loc("/run/fileZ", 2, 1, None, 7, "note"), loc("x/fileA", 1, 1, 3, None, "more"), loc("/run/n")], 1, [])])
    got = v.select(results.location_texts(F.lit("/run/")).alias("t")).first().t
    assert got == ["fileA (20:1)", '(main) fileZ (2:1) "note"', 'x/fileA (1:1-3:1) "more"', "n"]


def test_details(spark, rules):
    v = table(spark, rules, [("A", [loc("f", 1, 1)], 0, ["own-url"]), ("B", [], 0, [])])
    b, a = results.details(v).orderBy("num").collect()
    assert (a.severity, a.location, a.locations, a.resource, a.resources) == ("4 (Low)", "f (1:1)", None, None, ["rule-url", "own-url"])
    assert (b.severity, b.location, b.locations, b.resource, b.resources) == ("2 (High)", None, None, None, None)


def test_table_is_relative_to_the_common_folder(spark, rules):
    v = table(spark, rules, [("A", [loc("/w/x/f", 1, 2)], 0, []), ("A", [loc("/w/y/g", 3, None)], 0, [])])
    assert {(r.rule, r.location) for r in results.table(v).collect()} == {("e:A", "x/f:1:2"), ("e:A", None)}


@pytest.mark.parametrize("files,want", [(["/a/b/c.txt"], "/a/b"), (["/a/b/c", "/a/d/e"], "/a"), (["/a", "/b"], "/"), (["/a/x", "/b"], "/"), (["C:/a/x", "D:/a/x"], ""), ([None, ""], ""), (["/ab/x", "/a/x"], "/"), (["/a/b/c", "/a/b"], "/a"), ([], "")])
def test_common_parent(spark, files, want):
    assert spark.createDataFrame([(f,) for f in files], "f string").agg(results.common_parent(F.col("f"))).first()[0] == want


def test_rule_views(spark, rules):
    rows = results.rule_details(rules).orderBy("num").collect()
    assert [(r.num, r.rule, r.tags, r.resource, r.description) for r in rows] == [(1, "A", "t", "rule-url", "d"), (2, "B", "t, u", None, None)]
    assert results.rule_table(rules).columns == ["num", "name", "engine", "severity", "tag"]


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    ts = F.to_timestamp(F.lit("2025-02-20 04:03:08.014"))
    assert one(fn.compact_timestamp(ts)) == "2025_02_20_04_03_08_014" and one(fn.clock(ts)) == "4:3:8" and one(fn.iso_timestamp(ts)) == "2025-02-20T04:03:08.014Z"
    assert one(fn.indented(F.lit("a\n\n b\n"))) == "    a\n\n     b\n"
    assert one(fn.commented(F.lit("a\n\nb"))) == "# a\n# \n# b"
    assert one(fn.inline_comment(F.lit("a\nb"), F.lit("c"))) == "a  # c\nb" and one(fn.inline_comment(F.lit("a"), F.lit("c"))) == "a  # c"
    pairs = F.array(F.struct(F.lit("k").alias("key"), F.lit("v").alias("value")), F.struct(F.lit("long").alias("key"), F.lit(None).cast("string").alias("value")))
    assert one(fn.property_list(pairs)) == "k:    v\nlong:"
    assert [one(fn.extension(F.lit(p))) for p in ("/a/b.TXT", "/a.b/c", ".hidden", "x.tar.gz")] == ["txt", "", "", "gz"]
    assert [one(fn.dir_name(F.lit(p))) for p in ("/a/b", "/a", "a", "a/b/c")] == ["/a", "/", "", "a/b"]
    assert one(fn.elapsed_seconds(ts, ts + F.expr("interval 1999 milliseconds"))) == 1
    assert one(fn.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3")))) == {"a": "3", "b": "2"}
    assert one(fn.message("%s has %d", F.lit("x"), F.lit(2))) == "x has 2"
    assert one(fn.same_value(F.to_json(F.array(F.lit("a"), F.lit("b"))), F.to_json(F.array(F.lit("b"), F.lit("a"))))) is False


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_numbers_of_many_rows_at_one_place(spark, rules, n):
    """A third of the rows share severity, file and line; every row gets the number of its place in order."""
    import random

    rng = random.Random(4)
    spots = [("f", 1, 1) if k % 3 == 0 else (rng.choice("abc") * 3, rng.randrange(9), rng.choice([None, 2])) for k in range(n)]
    v = spark.createDataFrame([(k, "e", rng.choice("AB"), "m", [loc(*s)], 0, []) for k, s in enumerate(spots)], VIOLATIONS).repartition(5)
    v = results.enriched(v, rules)
    got = results.numbered(v, None)
    rows = sorted(got.collect(), key=lambda r: (r.severity, r.code_locations[0].file, r.code_locations[0].start_line, r.code_locations[0].start_column or 0, r.violation_ord))
    assert [r.num for r in rows] == list(range(1, n + 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert got.columns == [*v.columns, "num"]


def test_properties_of_several_lines(spark):
    pair = lambda k, v=None, vs=None: F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value"), (F.array(*map(F.lit, vs)) if vs else F.lit(None)).cast("array<string>").alias("values"))
    text = spark.range(1).select(fn.properties(F.array(pair("k", "one\ntwo"), pair("longer"), pair("many", None, ["a", "b\nc"]))).alias("x")).first().x
    assert text == "k:      one\n        two\nlonger:\nmany:\n    a\n    b\n    c"
