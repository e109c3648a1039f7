import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rulegrain.llm import brown, queries


def brute(rows):
    tok = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    c = Counter(w for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    return n, {i: (len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tok.items()}


@pytest.mark.parametrize("common", [brown.COMMON, 300])
def test_counts_base_and_gain(spark, monkeypatch, common):
    monkeypatch.setattr(brown, "COMMON", common)
    rows = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    n, want = brute(rows)
    got = {r.doc_id: r for r in queries.op1_class_ngram_scoring(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys()
    for i, (tokens, known, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r.held_out]
    score, base = sum(r.score for r in held), sum(r.base_score for r in held)
    print("log10 a token: model", score / sum(r.n_tokens for r in held), "base", base / sum(r.n_tokens for r in held))
    assert score > 0.97 * base


def test_probabilities_sum_to_one(spark):
    texts = [("a b a b a c",), ("b a b",), ("c d e f",), (None,)] * 5
    df = spark.createDataFrame(texts, "text string")
    model, vocabulary = brown.trained(df)
    words = vocabulary.collect()
    for context in (brown.STOP, 0, 5):
        known = sum(model.step[context, w["class"]] * float(model.emission(w.n, w["class"])) for w in words)
        assert abs(known + model.unseen[context] - 1) < 1e-9
    assert sum(w.n for w in words) == model.total == 20 * 1 + 5 * 13


def test_clusters_follow_neighbours(spark):
    """Words that alternate between two sets end in classes of one set each."""
    rng = np.random.default_rng(1)
    texts = [(" ".join(f"{'ab'[k % 2]}{rng.integers(40)}" for k in range(60)),) for _ in range(300)]
    df = spark.createDataFrame(texts, "text string")
    _, vocabulary = brown.trained(df)
    kinds = {}
    for w in vocabulary.collect():
        kinds.setdefault(w["class"], Counter())[bytes(w.word)[:1]] += w.n
    assert sum(max(k.values()) for k in kinds.values()) > 0.9 * sum(sum(k.values()) for k in kinds.values())


def test_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model, vocabulary = brown.trained(empty)
    assert brown.scored(empty, model, vocabulary).count() == 0
    rows = spark.createDataFrame([(1, None, 3), (1, None, 3), (2, "X y", 3)], "doc_id long, text string, n long")
    out = brown.scored(rows, model, vocabulary).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.score) for r in out] == [(1, 0, 0.0), (1, 0, 0.0), (3, 0, 0.0)]
    model, vocabulary = brown.trained(rows)
    assert sorted(r.n_tokens for r in brown.scored(rows, model, vocabulary).collect()) == [1, 1, 3]


@pytest.mark.parametrize("common", [60, 20])
def test_transitions_count_every_token(spark, monkeypatch, common):
    """Words beyond the head count too, as contexts and as what follows."""
    monkeypatch.setattr(brown, "HEAD", 10)
    monkeypatch.setattr(brown, "COMMON", common)
    seen = []
    monkeypatch.setattr(brown, "Model", lambda m, *rest: seen.append(m))
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(50 * rng.random() ** 2)}" for _ in range(30)) for _ in range(100)]
    _, vocabulary = brown.trained(spark.createDataFrame([(t,) for t in texts], "text string"))
    classes = {bytes(w.word): w["class"] for w in vocabulary.collect()}
    known = {bytes(w.word) for w in brown.top_words(vocabulary, common)}
    want = np.zeros((brown.WIDTH, brown.WIDTH))
    for t in texts:
        context = brown.STOP
        for w in [*t.encode().split(), b""]:
            want[context, classes[w]] += 1
            context = classes[w] if w in known else context
    assert want.sum() == 3100 and (seen[0] == want).all()


def test_scores_match_brute_force(spark, monkeypatch):
    """Every token's probability from the counts of all words, by plain loops."""
    monkeypatch.setattr(brown, "HEAD", 12)
    monkeypatch.setattr(brown, "COMMON", 25)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.integers(0, 25))) for _ in range(120)]
    train, held = texts[:90], [*texts[90:], "w1 unseen w2", None]
    model, vocabulary = brown.trained(spark.createDataFrame([(t,) for t in train], "text string"))
    n = Counter(w for t in train for w in [*t.encode().split(), b""])
    rows = {bytes(r.word): r["class"] for r in vocabulary.collect()}
    assert rows.keys() == n.keys() and rows[b""] == brown.STOP
    common = {w for w, _ in sorted(((w, k) for w, k in n.items() if w), key=lambda x: (-x[1], x[0]))[:25]}
    total, size, kinds, after = sum(n.values()), Counter(), Counter(), Counter()
    for w, c in rows.items():
        size[c] += n[w]
        kinds[c] += 1

    def walk(t):
        context = brown.STOP
        for w in [*(t or "").encode().split(), b""]:
            yield context, w
            context = rows[w] if w in common else context

    for t in train:
        after.update((c, rows[w]) for c, w in walk(t))
    ones, twos = (sum(v == k for v in n.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos) if ones else 0.5
    step = lambda c, k: (after[c, k] + brown.MU * size[k] / total) / (sum(after[c, x] for x in size) + brown.MU)

    def p(context, w):
        base = (n[w] + 0.1) / (total + 0.1 * (len(n) + 1))
        if w == b"":
            fit = step(context, brown.STOP)
        elif w in rows:
            fit = step(context, rows[w]) * (n[w] - discount) / size[rows[w]]
        else:
            fit = sum(step(context, k) * discount * kinds[k] / size[k] for k in size if k != brown.STOP)
        return (1 - brown.MIX) * fit + brown.MIX * base

    got = brown.scored(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), model, vocabulary).collect()
    for r in got:
        want = sum(math.log10(p(c, w)) for c, w in walk(held[r.doc_id]))
        assert abs(r.score - want) < 1e-9 * max(1, -want)
    assert len(got) == len(held)


def test_words_are_counted_in_shares_of_a_batch(spark, monkeypatch):
    """What Python makes of texts is a share's, not a whole Arrow batch's."""
    import tracemalloc

    import pyarrow as pa

    class Frame:
        def mapInArrow(self, run, kind):
            self.run = run
            return self

        groupBy = agg = lambda self, *a: self

    frame = Frame()
    brown.word_counts(frame)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5_000 + " " + "b" * 5_000] * 4_000)], ["text"])
    tracemalloc.start()
    try:
        counts = {w: n for b in frame.run(iter([batch])) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counts == {b"a" * 5_000: 4_000, b"b" * 5_000: 4_000, b"": 4_000} and peak < 15_000_000  # all texts at once are 40 MB


def test_texts_are_looked_up_together(monkeypatch):
    """Shares of texts hold about WORDS words; contexts don't cross the end of a text."""
    monkeypatch.setattr(brown, "WORDS", 5)
    texts = ["a b x", None, "x a", "b", ""]
    got = list(brown.shares(texts))
    assert got == [(0, [b"a", b"b", b"x", b"", b""], [4, 1]), (2, [b"x", b"a", b"", b"b", b""], [3, 2]), (4, [b""], [1])]
    c = brown.found({b"a": 1, b"b": 2, b"": brown.STOP}, got[0][1] + got[1][1], -1)
    assert brown.last_before(c, c >= 0).tolist() == [brown.STOP, 1, 2, 2, brown.STOP, brown.STOP, brown.STOP, 1, brown.STOP, 2]
