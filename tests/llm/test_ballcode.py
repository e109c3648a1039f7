import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulegrain.llm import ballcode
from rulegrain.llm.ballcode import BallTree, compressed, integers, squares


def plain(rows, parts=4, entries=256, rounds=4):
    """rows: (id, integer vector as a list) by id. Codes, errors and codebooks in whole numbers."""
    w = len(rows[0][1]) // parts
    books = [[v[k * w : k * w + w] for _, v in rows[:entries]] for k in range(parts)]

    def hit(k, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[k * w : k * w + w], e, strict=True)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        new = []
        for k in range(parts):
            mine = {}
            for _, v in rows:
                mine.setdefault(hit(k, v)[1], []).append(v[k * w : k * w + w])
            new.append([[sum(c) // len(mine[j]) for c in zip(*mine[j], strict=True)] if j in mine else e for j, e in enumerate(books[k])])
        books = new
    hits = [[hit(k, v) for k in range(parts)] for _, v in rows]
    return [[j for _, j in h] for h in hits], [sum(d for d, _ in h) for h in hits], books


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 1 << 20, 1 << 35, 1 << 61]), st.integers(1, 120), st.integers(1, 6))
def test_tree_gives_the_lowest_of_the_nearest(seed, spread, n, width):
    rng = np.random.default_rng(seed)
    entries, x = (rng.integers(-spread, spread, (k, width), endpoint=True) for k in (n, 50))
    entries[rng.integers(0, n, n // 3)] = entries[0]
    index, least = BallTree(entries).nearest(x)
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in x]
    assert least.tolist() == [min(r) for r in d] and index.tolist() == [r.index(min(r)) for r in d]
    assert squares(x, entries).tolist() == d


def test_integers_go_down_and_stay_exact():
    assert integers([[-0.0001, 0.9999, -1.0, 2.0**60]]).tolist() == [[-1, 1023, -1024, 1 << 62]]
    assert integers([[2.0**45 + 0.5]]).tolist() == [[(2**45) * 1024 + 512]]


def test_same_as_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 3, np.round(rng.normal(size=8) * (i % 7 + 1), 2).tolist(), int(i % 3) if i % 5 else None, "x") for i in range(300)]
    rows += [(1000 + i, rows[7][1], 1, "x") for i in range(120)]  # one vector often
    bad = [(5000, None, 1, ""), (5001, [], 1, ""), (-1, [1.0] * 7 + [None], 1, ""), (-2, [float("nan")] * 8, 1, ""), (-3, [float("-inf")] * 8, 1, ""), (5002, [1.0] * 4, 1, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int, entries string").repartition(7)
    codes, books = compressed(df, entries=32)
    want, errors, plain_books = plain([(i, integers([v])[0].tolist()) for i, v, _, _ in rows], entries=32)
    assert [b.tolist() for b in books.books] == plain_books
    got = {r.vec_id: r for r in codes.collect()}
    assert len(got) == len(rows)
    by = {}
    for (_, _, lab, _), e in zip(rows, errors, strict=True):
        by[lab] = by.get(lab, 0) + e
    for (i, _, lab, _), c, e in zip(rows, want, errors, strict=True):
        assert (got[i].entries, got[i].error, got[i].label_error) == (c, e, by[lab])


def test_far_vectors_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1e38, -1e38], 1), (1, [1e38, -1e38], 1), (None, [0.0, 0.0], None)], "vec_id long, embedding array<double>, label int")
    codes, _ = compressed(df, parts=2, entries=1, rounds=1)
    assert sorted((r.vec_id or 0, r.entries, r.error == ballcode.MOST, r.label_error == ballcode.MOST) for r in codes.collect()) == [(0, [0, 0], True, True), (1, [0, 0], True, True), (1, [0, 0], True, True)]
    for empty in (df.limit(0), df.withColumn("embedding", F.lit(None).cast("array<float>"))):
        codes, books = compressed(empty)
        assert codes.count() == 0 and books.books == [] and codes.columns == ["vec_id", "label", "entries", "error", "label_error"]


@pytest.mark.parametrize("dimension", [4, 6, 3])
def test_parts_cover_all_components(dimension):
    where = ballcode.parts_of(dimension)
    assert [k for w in where for k in range(dimension)[w]] == list(range(dimension))
