import random

import numpy as np
import pytest

from rulegrain.llm import components, partenum, queries


def sets_of(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute(rows, n, p, q):
    sets = sets_of(rows, n)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    having = {}
    for i, s in sets.items():
        for g in s:
            having.setdefault(g, []).append(i)
    pairs = {(i, j) for ids in having.values() for i in ids for j in ids if i < j}
    for i, j in pairs:
        if q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i, _ in rows)


def variants(seed, count):
    rng, rows = random.Random(seed), []
    for k in range(count):
        size = rng.choice([3, 5, 8, 9, 10, 12, 15, 20, 30, 60, 120, 300])
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        for _ in range(rng.choice([1, 2, 4])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + size // 20 + rng.randrange(3))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(1000)}"
            if rng.random() < 0.3:
                text += [f"y{rng.randrange(1000)}" for _ in range(rng.randrange(1 + size // 6))]
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("p,q", [(85, 100), (8, 10), (1, 2)])
def test_similar_sets_share_a_signature(p, q):
    rng = np.random.default_rng(3)
    for _ in range(1500):
        size = int(rng.integers(1, 200))
        s = rng.integers(1, 1 << 62, size).astype(np.uint64)
        drop, add = int(rng.integers(0, size // 5 + 2)), int(rng.integers(0, size // 5 + 2))
        a, b = np.unique(s), np.unique(np.concatenate([s[drop:], rng.integers(1, 1 << 62, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and q * both >= p * (len(a) + len(b) - both) and (len(a) != both or len(b) != both):
            assert np.intersect1d(partenum.signatures(a, p, q), partenum.signatures(b, p, q)).size, (len(a), len(b), both)


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.choice(2000, int(rng.integers(1, 600)), replace=False).astype(np.uint64) for _ in range(2))
        assert partenum.apart(partenum.sketch(np.sort(a)), partenum.sketch(np.sort(b))) <= len(np.setxor1d(a, b))


def test_small_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d e"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (9, " ".join(f"w{i}" for i in range(40))), (8, " ".join(f"w{i}" for i in range(41)))]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, node int, sig int")
    want = sorted({i: (i, n, c) for i, n, c in brute(rows, 4, 85, 100)}.values())
    assert sorted(set(got(partenum.near_groups(df, 4, 85, 100)))) == want


@pytest.mark.parametrize("n,p,q", [(4, 85, 100), (5, 8, 10)])
def test_random_variants(spark, n, p, q, monkeypatch):
    rows = variants(n, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(partenum.near_groups(df, n, p, q)) == brute(rows, n, p, q)


def test_open_buckets_are_resolved(spark, monkeypatch):
    """With buckets that hold unlike sets, small and large ones still lose no link."""
    monkeypatch.setattr(partenum, "BLOCK", 3)
    monkeypatch.setattr(partenum, "TASK_MEMBERS", 10)
    monkeypatch.setattr(partenum, "FIRST_ASKED", 1)
    monkeypatch.setattr(partenum, "ASKED_GROWTH", 4)
    plain = partenum.signatures
    monkeypatch.setattr(partenum, "signatures", lambda s, p, q, seed=0: np.append(plain(s, p, q, seed), len(s) // 40) if seed == 0 else plain(s, p, q, seed))
    rows = variants(9, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(partenum.near_groups(df, 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_buckets_with_the_same_members_are_looked_at_once(spark, monkeypatch):
    """And again only where a member has more pairs than it asked for."""
    monkeypatch.setattr(partenum, "FIRST_ASKED", 1)
    monkeypatch.setattr(partenum, "ASKED_GROWTH", 4)
    plain, crossing, seen = partenum.signatures, partenum._crossing, []
    monkeypatch.setattr(partenum, "signatures", lambda s, p, q, seed=0: np.append(plain(s, p, q, seed), [*range(8), 100 + len(s) // 60]))

    def counted(rows, *more):
        seen.append(rows.count())
        return crossing(rows, *more)

    monkeypatch.setattr(partenum, "_crossing", counted)
    rows = variants(3, 40)
    assert got(partenum.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)) == brute(rows, 4, 85, 100)
    assert seen[0] < 4 * len(rows) and all(n <= seen[0] for n in seen)  # eight times each set and more, otherwise


def test_empty_table(spark):
    assert partenum.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert got(queries.op10_ngram_jaccard_join(spark, "/root/testdata/sf0.01")) == brute([(d.doc_id, d.text) for d in docs], 4, 85, 100)


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    out = {r.node: r.component for r in components.components(links).collect()}
    assert out == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_sets_with_one_key_are_told_apart(spark, monkeypatch):
    """Different sets whose 64-bit keys are equal go by their second keys."""
    import hashlib

    plain = hashlib.blake2b

    class Clashing:
        def __init__(self, data, digest_size):
            self.data = plain(data, digest_size=digest_size).digest()

        def digest(self):
            return bytes([self.data[0] % 8]) + bytes(7) + self.data[8:]

    described, signed = partenum.described, partenum.signed

    def with_clashes(f):
        def call(docs, *args, **more):
            class Frame:
                def __init__(self, df):
                    self.df = df

                def select(self, *c):
                    return Frame(self.df.select(*c))

                def mapInArrow(self, run, kind):
                    def patched(batches):
                        import hashlib

                        hashlib.blake2b = Clashing
                        try:
                            yield from run(batches)
                        finally:
                            hashlib.blake2b = plain

                    return self.df.mapInArrow(patched, kind)

            return f(Frame(docs), *args, **more)

        return call

    monkeypatch.setattr(partenum, "described", with_clashes(described))
    monkeypatch.setattr(partenum, "signed", with_clashes(signed))
    rows = variants(11, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(partenum.near_groups(df, 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_blocks_are_compared_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (40, 256), dtype=np.uint8)
    block = lambda seed: (np.arange(partenum.BLOCK) + seed, np.full(partenum.BLOCK, 250), base[np.arange(partenum.BLOCK) % 40])
    x, y = block(0), block(1)
    tracemalloc.start()
    i, j, more = partenum._asked(x, y, 8, 10, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 79 MB where a whole block is compared at once
    assert more and (np.bincount(i, minlength=partenum.BLOCK) == 3).all()
    want = [k for k in range(partenum.BLOCK) if k % 40 == 7 and k + 1 != 7][:3]
    assert j[i == 7].tolist() == want
    some = x[0][:250], x[1][:250], x[2][:250]
    i, j, more = partenum._asked(some, some, 8, 10, 1000)
    assert not more and set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(250) for b in range(250) if a != b and a % 40 == b % 40}
