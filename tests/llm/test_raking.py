from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulegrain.llm import raking

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string"


def test_sums_meet_the_targets_within_what_the_cells_have(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = raking.described(docs)
    cells = rows.groupBy(*raking.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = raking.raked(cells, raking.tempered(cells)).cache()
    assert fitted.where("cell_weight > room * (1 + 1e-9) or cell_weight < 0").count() == 0
    got = raking.achieved(fitted, raking.bounded(cells, raking.tempered(cells))).collect()
    assert {r.dimension for r in got} == set(raking.DIMENSIONS)
    assert max(abs(r.share - r.target) for r in got) < raking.TOLERANCE
    kept = raking.mixed(docs).agg(F.sum(F.col("n_tokens") * F.col("keep_p")).alias("kept"), F.sum("n_tokens").alias("n")).first()
    assert kept.kept / kept.n == pytest.approx(raking.BUDGET, abs=1e-4)


def test_targets_beyond_what_a_value_has_are_filled_up_by_the_others(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "x", "t", 30), ("c", "x", "t", 60)], "source string, lang string, topic string, tokens long")
    asked = [("source", "a", 0.5), ("source", "b", 0.25), ("source", "c", 0.25), ("lang", "x", 1.0), ("topic", "t", 1.0), ("lang", "none", 1.0)]
    targets = raking.bounded(cells, spark.createDataFrame(asked, "dimension string, value string, share double"), 0.5)
    got = {(r.dimension, r.value): r.share for r in targets.collect()}
    assert got == pytest.approx({("source", "a"): 0.2, ("source", "b"): 0.4, ("source", "c"): 0.4, ("lang", "x"): 1.0, ("topic", "t"): 1.0})


def test_given_targets(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], "x") for i in range(2000)], SCHEMA)
    asked = [("source", "a", 0.8), ("source", "b", 0.2), ("lang", "x", 1.0), ("topic", raking.REST, 1.0)]
    out = raking.mixed(docs, spark.createDataFrame(asked, "dimension string, value string, share double"), budget=0.5)
    p = {r.source: r.keep_p for r in out.select("source", "keep_p").distinct().collect()}
    assert p == pytest.approx({"a": 0.8, "b": 0.2})
    kept = Counter(r.source for r in out.where("kept").collect())
    assert abs(kept["a"] - 800) < 80 and abs(kept["b"] - 200) < 60
    none = raking.mixed(docs, spark.createDataFrame([r for r in asked if r[1] != "b"], "dimension string, value string, share double"), budget=0.5)
    assert {r.source for r in none.where("kept").collect()} == {"a"}


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(1, None, None, None), (2, "", "a", "x"), (3, "one two", None, "x"), (3, "one two", None, "x"), (4, "b c d", "a", None)]
    out = raking.mixed(spark.createDataFrame(rows, SCHEMA), budget=1.0).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == [(1, 0), (2, 0), (3, 2), (3, 2), (4, 3)]
    assert all(r.keep_p == 1.0 and r.kept for r in out)
    assert len({r.kept for r in raking.mixed(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 3").collect()}) == 1
    assert raking.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.kept for r in raking.mixed(spark.createDataFrame(rows[:2], SCHEMA)).collect()} == {True}


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "l", 7, 8, "old", 9)], SCHEMA + ", __source int, __topic int, topic string, cell_source int")
    r = raking.mixed(docs, budget=1.0).first()
    assert (r["__source"], r["__topic"], r.topic, r.cell_source, r.n_tokens) == (7, 8, raking.REST, 9, 2)
