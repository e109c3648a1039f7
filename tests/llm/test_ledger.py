import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulegrain.llm import ledger, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    inside = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


CASES = ["", None, "one", "a b c", "a b c a b c", "a a a a a", "x\nx\n \n\nx", "wörter | # <b>\t%", "a b c d a b c d a b c d e", "a b c " * 200, " ".join(f"w{i % 300}" for i in range(2000)), "\U0001f600 a\x0bb\x0cc"]


def test_measurements_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[m] for m in ledger.MEASURES[:5]) for r in ledger.ledger(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(CASES)}


def test_whole_table_matches_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op3_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, chars, symbols, lines, repeats = brute(d.text)
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    words = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, words), (2, "short"), (3, words + " $$$$" * 9), (4, "ab ab ab " * 30), (4, "ab ab ab " * 30)], "doc_id long, text string")
    book = ledger.ledger(df)
    assert {(r.doc_id, r.kept) for r in ledger.judged(book).collect()} == {(1, True), (2, False), (3, False), (4, False)}
    assert {r.doc_id for r in ledger.judged(book, "v1").where("kept").collect()} == {1, 3}
    cost = {r.rule: (r.n_failed, r.n_only) for r in ledger.ablation(book).collect()}
    assert cost["too_few_words"] == (1, 1) and cost["symbols_per_word"] == (1, 1) and cost["repeated_windows"] == (2, 2)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ledger.ledger(empty).count() == 0 and ledger.ablation(ledger.ledger(empty)).count() == 0
    df = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id long, text string, n_words long, kept string")
    row = ledger.judged(ledger.ledger(df)).first()
    assert row.n_words == 2 and row.kept is False


def test_native(spark):
    plan = queries.op3_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_columns_named_like_helpers_pass_through(spark):
    r = ledger.ledger(spark.createDataFrame([(1, "a b", 5, 6, 7, 8)], "doc_id long, text string, __counts int, __lines int, counts_ int, lines_ int")).first()
    assert (r["__counts"], r["__lines"], r["counts_"], r["lines_"], r.n_words) == (5, 6, 7, 8, 2)
