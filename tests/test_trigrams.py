import random
import re

from pyspark.sql import functions as F

from rulegrain.sources import trigrams

RULES = "engine string, rule string, pattern string, message string, extensions array<string>"
FILES = "file string, ext string, content string"


def plain(rules, files):
    return sorted((rule, file, n + 1, m.start() + 1, m.end() + 1) for _, rule, p, _, ext in rules for file, e, c in files if p is not None and (not ext or e in ext) for n, line in enumerate((c or "").split("\n")) for m in re.finditer(p, line))


def got(spark, rules, files):
    out = trigrams.matched(spark.createDataFrame(rules, RULES), spark.createDataFrame(files, FILES))
    return sorted((r.rule, r["at"].file, r["at"].start_line, r["at"].start_column, r["at"].end_column) for r in out.select("rule", F.col("code_locations")[0].alias("at")).collect())


def test_same_matches_as_every_rule_on_every_file(spark):
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma", "delta1", "épée", "x", "the", "the", "the"]
    files = [(f"/w/{k}", rng.choice(["txt", "md"]), "\n".join(" ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(4))) for k in range(60)]
    files += [("/w/null", "txt", None), ("/w/empty", "txt", "")]
    patterns = ["alpha", "beta|gamma", "the the", "delta[0-9]", r"\w+1", "x", "[A-Z]", "épée", "no such", "(?i)BETA", "^the", "(the|alpha) x", None]
    rules = [("e", f"r{k}", p, None if k % 2 else "m", [["txt"], [], None][k % 3]) for k, p in enumerate(patterns)]
    assert got(spark, rules, files) == plain(rules, files)
    assert got(spark, rules, []) == [] and got(spark, [], files) == []


def test_rules_and_files_meet_by_equal_keys(spark):
    files = spark.createDataFrame([(f"/w/{k}", "txt", f"some words and number{k:04d} here") for k in range(300)], FILES)
    rules = spark.createDataFrame([("e", f"r{k}", f"number{k:04d}", "m", None) for k in range(200)], RULES)
    keyed = rules.select(F.col("rule").substr(2, 9).cast("long").alias("key"), "pattern")
    pairs = trigrams.candidates(keyed, files)
    assert pairs.count() < 3 * 200 and pairs.where("file <> concat('/w/', key)").count() < 400
    plan = trigrams.matched(rules, files)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert trigrams.matched(rules, files).count() == 200
