from collections import defaultdict

from pyspark.sql import functions as F

from rulegrain.plans import api
from rulegrain.sources.engines import RegexEngine, RegexRule, Registry
from rulegrain.sources.tables import duplicate_blocks

FILES = "file string, ext string, content string"


def plain(files, n):
    places = defaultdict(list)
    for file, _, content in files:
        rows = (content or "").split("\n")
        for k in range(len(rows) - n + 1):
            if all(r.strip(" ") for r in rows[k : k + n]):
                places[tuple(rows[k : k + n])].append((file, k + 1))
    out = []
    for at in places.values():
        first, seen = min(at), set()
        for file, line in sorted(at):
            if file != first[0] and file not in seen:
                seen.add(file)
                out.append((file, line, line + n - 1, *first))
    return sorted(out)


def got(spark, files, n):
    registry = Registry([duplicate_blocks(n)])
    v = registry.run(registry.catalogue(spark), spark.createDataFrame(files, FILES).repartition(5))
    a, b = (F.get("code_locations", F.lit(k)) for k in (0, 1))
    return sorted(tuple(r) for r in v.select(a["file"], a["start_line"], a["end_line"], b["file"], b["start_line"]).collect())


def test_blocks_of_two_files_are_found(spark):
    files = [("/a", "txt", "one\ntwo\nthree\nfour"), ("/b", "txt", "zero\ntwo\nthree\nfour\ntwo\nthree\nfour"), ("/c", "txt", "x\n\ny"), ("/d", "txt", "x\n\ny\none\ntwo\nthree"), ("/e", "txt", None), ("/f", "txt", "")]
    assert got(spark, files, 3) == plain(files, 3) == [("/b", 2, 4, "/a", 2), ("/d", 4, 6, "/a", 1)]
    assert got(spark, files, 1) == plain(files, 1)
    assert got(spark, files[:1], 3) == [] and got(spark, [], 3) == []


def test_a_block_of_every_file_is_dealt_over_many_partitions(spark):
    files = [(f"/{k:04}", "txt", f"only {k}\nlicence\nlines\nhere") for k in range(300)]
    assert got(spark, files, 3) == plain(files, 3)
    engine = duplicate_blocks(3)
    rows = engine.shaped(spark.createDataFrame(files, FILES))
    assert rows.select("salt").distinct().count() > 40


def test_with_other_engines_in_one_run(spark):
    files = spark.createDataFrame([("/a", "txt", "TODO\nb\nc"), ("/b", "txt", "TODO\nb\nc")], FILES)
    registry = Registry([RegexEngine([RegexRule("todo", "TODO")]), duplicate_blocks(2)])
    out = api.run(spark, rule_selector="all", files=files, registry=registry, view="detail")
    assert sorted((r.engine, r.rule, r.location or tuple(r.locations)) for r in out.view.collect()) == [
        ("duplicates", "repeated_block", ("(main) /b (1:1-2:1)", "/a (1:1-2:1)")), ("duplicates", "repeated_block", ("(main) /b (2:1-3:1)", "/a (2:1-3:1)")), ("regex", "todo", "/a (1:1-1:5)"), ("regex", "todo", "/b (1:1-1:5)"),
    ]
    assert api.run(spark, rule_selector="regex", files=files, registry=registry).violations.count() == 2
