import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulegrain.llm import periodic, queries
from rulegrain.llm.periodic import Runs, distances, scale_of


def plain_runs(words, least=12):
    """Every stretch of every period, and every smaller period of it."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, 2 * q) and not any(all(words[k] == words[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out)


def numbered(words):
    numbers = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


@pytest.mark.parametrize("least", [5, 6, 7, 12, 13, 40])
def test_every_period_has_one_scale(least):
    for scale in (2, 4, 8, 16, 32):
        assert {q for a, b in distances(scale, least) for q in range(a, b + 1)} == {q for q in range(1, 300) if scale_of(q, least) == scale}


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_same_runs_as_plain_search(data):
    n, k = data.draw(st.integers(0, 90)), data.draw(st.sampled_from([1, 2, 3, 5, 20]))
    words = data.draw(st.lists(st.integers(0, k - 1), min_size=n, max_size=n))
    if n and data.draw(st.booleans()):
        a = data.draw(st.integers(0, n - 1))
        p = data.draw(st.integers(1, max(1, (n - a) // 2)))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    least = data.draw(st.sampled_from([5, 8, 12]))
    assert Runs(numbered(words), least).search() == plain_runs(words, least)


def test_runs_inside_runs_and_of_long_periods():
    rng = random.Random(3)
    inner = ["a"] * 30 + ["b"] * 17
    period = [rng.choice("wxyz") for _ in range(400)] + inner
    words = period * 3 + period[:5]
    assert Runs(numbered(words)).search() == plain_runs(words)


def test_one_word_often_is_linear():
    import time

    began = time.perf_counter()
    assert Runs(np.zeros(100_000, np.int64)).search() == [(0, 100_000, 1)]
    assert time.perf_counter() - began < 20


def test_query_equals_plain_search(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = (d.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 700:  # the plain search is cubic
            continue
        runs = plain_runs(words)
        some += bool(runs)
        r = got[d.doc_id]
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    assert some > 5


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "a " * 20, 0), (3, " \x0b\t ", 0), (4, "x y " * 6 + "é", 0), (5, "u v " * 200_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "id")
    got = periodic.detected(df).collect()
    assert sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in got) == [
        (0, [(0, 20, 1)], "a"), (1, [], ""), (2, [], ""), (2, [], ""), (3, [], " "), (4, [], "x y x y x y x y x y x y é"), (5, [(0, 400_000, 2)], "u v"),
    ]
    assert periodic.detected(df.limit(0)).count() == 0
    assert periodic.with_repeats(df).count() == 7
    with pytest.raises(ValueError, match="5 words"):
        periodic.detected(df, least=4)
