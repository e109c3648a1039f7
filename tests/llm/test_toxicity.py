import numpy as np

from rulegrain.llm import queries, toxicity


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(got[x.doc_id], x.toxic) for x in labels if got[x.doc_id].held_out]
    caught = [r.predicted for r, y in held if y]
    wrong = [r.predicted for r, y in held if not y]
    assert np.mean(caught) > 0.75 and np.mean(wrong) < 0.01


def test_weights_are_sparse_and_nulls_score(spark):
    rows = [(i, ("you idiot" if i % 2 else "hello there") if i else None, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.fitted(df.drop("toxic"), df)
    assert 0 < len(weights) < 20
    score = {r.doc_id: r.score for r in toxicity.scored(df, weights).collect()}
    assert len(score) == 200 and score[1] > 0.7 > score[2] and 0 <= score[0] <= 1


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.fitted(df, df) == {} and toxicity.scored(df, {}).count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert toxicity.scored(one, {}).first().score == 0.5


def test_ties_nulls_and_clashing_names(spark):
    rows = [(i % 50 if i else None, ("you idiot" if i % 2 else "hello there") + f" {i % 7}", i % 2, 9) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score int")
    labels = df.select("doc_id", "toxic").distinct()
    one, other = (toxicity.fitted(d.drop("toxic"), labels) for d in (df.repartition(1), df.orderBy(df.text.desc()).repartition(5)))
    assert one == other
    got = toxicity.scored(df, one)
    assert got.columns == ["doc_id", "score"] and got.count() == 200 and got.where("doc_id is null and score between 0 and 1").count() == 1
