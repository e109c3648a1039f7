"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Largest inner product becomes smallest distance: with M the largest length, a
vector x gets a further component sqrt(M^2 - |x|^2), a query is brought to length M
and gets a 0. Each table hashes with k projections, floor((a . x + b) / W), a
normal. For a neighbour whose cosine to the query is c, a projection is normal
around c times the query's, with deviation M sqrt(1 - c^2): that gives each slot a
probability, a bucket the product. A query visits buckets from the likeliest
down, in every table, until the likelihoods add up to a share that the fit has
set; what the tables offer is merged and ranked by exact inner products.

Fit (bounded): SAMPLE queries, lowest in a hash of their id, get their true
neighbours by one scan of all vectors. These set c, and the share at which
RECALL of those neighbours have been visited; k falls where visits would be many.
Every vector is indexed. A query that found fewer vectors than asked for
is searched again in every bucket, so no bucket or probe is capped.

Rows meet in blocks: buckets are dealt into shards of about BLOCK vectors, and a
shard that holds more (a bucket of near copies) is split by a salt, to whose parts its
queries are repeated. A task holds one block, streams the queries that probe it,
and keeps the best of each query, handing on what it has when it holds many. Of
equal vectors only the k + 1 with the smallest ids are indexed: no other can be
among a query's k nearest. Equal queries are searched once.

On vectors without structure, neighbours hardly differ from chance, and any
such index visits a large part of all; on clustered ones it visits little.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do null ids or vectors of another length than the
vector with the smallest id; rows of one id and vector count once; a query's own row is
the one of its id and vector, so another vector of its id is a candidate; ties go
to the smaller id; fewer candidates than asked for are all returned; an empty
table, or one without queries, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.llm.ballcode import usable
from rulegrain.llm.common import dropped, written

K, TABLES, RECALL = 20, 2, 0.95
SAMPLE, BLOCK, CHUNK = 64, 4096, 256
PER_BUCKET, PROBES = 64, 512
WIDTH = 3.5
HELD = 1_000_000
SMALLEST = 1e-9
FOUND = "q bigint, id bigint, score double, same boolean"


def vectors_of(column):
    """An Arrow list column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass
class Hashing:
    """TABLES tables of k projections for vectors no longer than `top`."""

    k: int
    dimension: int
    top: float
    cosine: float = 0.0
    share: float = 1.0
    tables: int = TABLES

    def __post_init__(self) -> None:
        import numpy as np

        rng = np.random.default_rng(7)
        self.width = WIDTH
        self.a = rng.normal(size=(self.tables, self.k, self.dimension + 1))
        self.b = rng.uniform(0, self.width, (self.tables, self.k))
        self.mix = rng.integers(1, 1 << 62, self.k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def key(self, slots):
        """One 64-bit number for each row of slots; different buckets with one key are visited together."""
        import numpy as np

        mixed = (slots.astype(np.int64).astype(np.uint64) * self.mix).sum(axis=-1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(31)
        return (mixed * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)

    def slots(self, x, table: int):
        """The slots of vectors, lengthened to `top`, which counts as 1."""
        import numpy as np

        x = x / self.top
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", x, x)))
        return np.floor((x @ self.a[table, :, :-1].T + rest[:, None] * self.a[table, :, -1] + self.b[table]) / self.width)

    def chances(self, query, table: int) -> list[tuple]:
        """For each projection its slots and the probability of each, likeliest first."""
        import numpy as np

        at = self.a[table, :, :-1] @ (query / np.sqrt(query @ query)) * self.cosine
        spread = math.sqrt(1 - self.cosine**2)
        out = []
        for p, b in zip(at.tolist(), self.b[table].tolist(), strict=True):
            first, last = math.floor((p - 5 * spread + b) / self.width), math.floor((p + 5 * spread + b) / self.width)
            edges = [0.5 * math.erfc((b + p - self.width * s) / (spread * math.sqrt(2))) for s in range(first, last + 2)]
            inside = sorted(((hi - lo, s) for lo, hi, s in zip(edges, edges[1:], range(first, last + 1), strict=False)), reverse=True)
            out.append((np.array([s for _, s in inside]), np.array([c for c, _ in inside])))
        return out

    def ordered(self, query, table: int, least: float):
        """Buckets (slots, likelihood) whose likelihood is `least` or more, likeliest first."""
        import numpy as np

        chances = self.chances(query, table)
        after = np.cumprod([1.0] + [c[0] for _, c in chances[::-1]])[::-1][1:]  # the most that the later projections can give
        slots, likely = np.zeros((1, 0)), np.ones(1)
        for (s, c), most in zip(chances, after, strict=True):
            row, column = np.nonzero((likely[:, None] * c) * most >= least)
            likely, slots = likely[row] * c[column], np.concatenate([slots[row], s[column][:, None]], axis=1)
        order = np.argsort(-likely, kind="stable")
        return slots[order], likely[order]

    def probes(self, query, table: int):
        """The keys of the buckets to visit, in order; None for all."""
        import numpy as np

        least = 1e-2
        while least > SMALLEST:
            slots, likely = self.ordered(query, table, least)
            n = int(np.searchsorted(np.cumsum(likely), self.share)) + 1
            if n <= len(likely):
                return np.unique(self.key(slots[:n]))
            least /= 8
        return None


def visited_at(hashing: Hashing, query, neighbours):
    """For each neighbour the share of likelihood at which some table has visited its bucket, 1 where it comes late."""
    import numpy as np

    out = np.ones(len(neighbours))
    for table in range(hashing.tables):
        slots, likely = hashing.ordered(query, table, 1e-6)
        share = {tuple(s): c for s, c in zip(slots.tolist(), np.cumsum(likely).tolist(), strict=True)}
        out = np.minimum(out, [share.get(tuple(s), 1.0) for s in hashing.slots(neighbours, table).tolist()])
    return out


def fitted(n: int, top: float, sample: list[tuple]) -> Hashing:
    """sample: (query, its true neighbours as rows) pairs, one at least."""
    import numpy as np

    dimension = len(sample[0][0])
    sample = [(q, near) for q, near in sample if len(near)]
    cosines = [float((near[-1] @ q) / np.sqrt(q @ q) / top) for q, near in sample]
    cosine = min(0.995, max(-0.995, float(np.quantile(cosines, 0.25)))) if cosines else 0.0
    k = max(1, math.ceil(math.log2(max(2, n / PER_BUCKET))))
    while True:
        out = Hashing(k, dimension, top, cosine)
        if sample:
            at = np.concatenate([visited_at(out, q, near) for q, near in sample])
            out.share = float(np.quantile(at, RECALL, method="higher"))
        visits = [out.probes(q, 0) for q, _ in sample]
        if k == 1 or np.mean([PROBES + 1 if v is None else len(v) for v in visits] or [0]) <= PROBES:
            return out
        k = max(1, k - 2)


def _best(q, ids, score, same, k: int):
    """The k best rows of each query, those that two tables offer once."""
    import numpy as np

    order = np.lexsort((same, ids, -score, q))
    q, ids, score, same = q[order], ids[order], score[order], same[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1]) | (same[1:] != same[:-1])
    q, ids, score, same = q[new], ids[new], score[new], same[new]
    first = np.ones(len(q), bool)
    first[1:] = q[1:] != q[:-1]
    starts = np.flatnonzero(first)
    nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[nth < k], ids[nth < k], score[nth < k], same[nth < k]


def _ranked(queries, ids, vectors, allowed, k: int):
    """Of each query the rows that can be among its k best: (query's place, id, exact score, whether the vectors are equal).

    allowed: (query places, slice of vectors) pairs to compare.
    """
    import numpy as np

    rough = np.full((len(queries), len(ids)), -np.inf)
    for rows, where in allowed:
        rough[rows, where] = queries[rows] @ vectors[where].T
    if len(ids) > k:
        edge = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        edge = np.full(len(queries), -np.inf)
    # products of matrices round differently by shape: keep what may tie
    slack = 1e-11 * np.sqrt(np.einsum("ij,ij->i", queries, queries)) * np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0))
    row, column = np.nonzero((rough >= (edge - slack)[:, None]) & (rough > -np.inf))
    a, b = queries[row], vectors[column]
    return row, ids[column], (a * b).sum(axis=1), (a == b).all(axis=1)


def _batch(q, ids, score, same):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array(same, pa.bool_())], ["q", "id", "score", "same"])


class Held:
    """The best of each query that a task has met; hands them on when they are many."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, q, ids, score, same) -> Iterator:
        self.parts.append((q, ids, score, same))
        self.n += len(q)
        if self.n > HELD:
            self.parts = [self.merged()]
            self.n = len(self.parts[0][0])
            if self.n > HELD // 2:
                yield from self.rest()

    def merged(self):
        import numpy as np

        return _best(*(np.concatenate(c) for c in zip(*self.parts, strict=True)), self.k)

    def rest(self) -> Iterator:
        if self.n:
            yield _batch(*self.merged())
        self.parts, self.n = [], 0


def _scan(sample: list[tuple], k: int):
    """All vectors against a few queries (q, vector)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        queries, held = np.array([v for _, v in sample]), Held(k)
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), vectors_of(batch.column("vector"))
            for at in range(0, len(ids), BLOCK):
                row, *found = _ranked(queries, ids[at : at + BLOCK], x[at : at + BLOCK], [(np.arange(len(queries)), slice(None))], k)
                yield from held.add(np.array([q for q, _ in sample])[row], *found)
        yield from held.rest()

    return run


def _indexed(hashing: Hashing, shards: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = vectors_of(batch.column("vector")) if batch.num_rows else np.zeros((0, hashing.dimension))
            for table in range(hashing.tables):
                bucket = hashing.key(hashing.slots(x, table))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), table), pa.int32()), pa.array(shard_of(bucket, shards), pa.int64()), pa.array(bucket, pa.int64()), batch.column("id"), batch.column("vector")], ["tab", "shard", "bucket", "id", "vector"])

    return run


def shard_of(bucket, shards: int):
    import numpy as np

    return ((bucket.astype(np.uint64) >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def _probing(hashing: Hashing, shards: int, everything: bool):
    """A row for each query and shard that it visits, with the buckets' keys; none of them: all."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows(out: list) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["tab", "shard", "keys", "id", "vector"])

        for batch in batches:
            out = []
            for q, v in zip(batch.column("q").to_pylist(), vectors_of(batch.column("vector")) if batch.num_rows else [], strict=True):
                for table in range(1 if everything else hashing.tables):
                    keys = None if everything else hashing.probes(v, table)
                    if keys is None:
                        out += [(table, s, None, q, v) for s in range(shards)]
                    else:
                        at = shard_of(keys, shards)
                        out += [(table, s, keys[at == s], q, v) for s in np.unique(at).tolist()]
                if len(out) > 2000:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    return run


def _search(k: int):
    """Rows sorted by block: its vectors by bucket first, then the queries that visit it."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held, block, parts, ready = Held(k), None, [], None

        def opened():
            ids, buckets, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            keys, first = np.unique(buckets, return_index=True)
            return ids, x, keys, np.append(first, len(ids))

        def compare(q, vectors, keys) -> Iterator:
            ids, x, buckets, first = ready
            for at in range(0, len(q), CHUNK):
                some, mine = vectors[at : at + CHUNK], keys[at : at + CHUNK]
                everywhere = [n for n, m in enumerate(mine) if m is None]
                flat = np.concatenate([m for m in mine if m is not None] or [np.zeros(0, np.int64)])
                who = np.repeat([n for n, m in enumerate(mine) if m is not None], [len(m) for m in mine if m is not None]).astype(np.int64)
                place = np.minimum(np.searchsorted(buckets, flat), len(buckets) - 1)
                hit = buckets[place] == flat
                who, place = who[hit], place[hit]
                order = np.argsort(place, kind="stable")
                who, place = who[order], place[order]
                there, begin = np.unique(place, return_index=True)
                allowed = [(w, slice(first[b], first[b + 1])) for b, w in zip(there.tolist(), np.split(who, begin[1:]), strict=True)] if len(there) else []
                if everywhere:
                    allowed.append((np.array(everywhere), slice(None)))
                row, *found = _ranked(some, ids, x, allowed, k)
                yield from held.add(q[at : at + CHUNK][row], *found)

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "shard", "salt", "kind")]
            change = np.ones(batch.num_rows, bool)
            change[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            edges = np.append(np.flatnonzero(change), batch.num_rows)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key, kind, piece = tuple(int(c[a]) for c in cols[:3]), int(cols[3][a]), batch.slice(a, b - a)
                if key != block:
                    block, parts, ready = key, [], None
                ids, x = piece.column("id").to_numpy(), vectors_of(piece.column("vector"))
                if kind == 0:
                    parts.append((ids, piece.column("bucket").to_numpy(zero_copy_only=False), x))
                elif parts:
                    ready = ready or opened()
                    yield from compare(ids, x, [None if m is None else np.asarray(m, np.int64) for m in piece.column("keys").to_pylist()])
        yield from held.rest()

    return run


def _found(index: DataFrame, probes: DataFrame, salts: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query among the buckets that it visits."""
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    left = index.join(salts, ["tab", "shard"]).select("tab", "shard", salt.alias("salt"), F.lit(0).alias("kind"), "bucket", "id", "vector", F.lit(None).cast("array<bigint>").alias("keys"))
    right = probes.join(salts, ["tab", "shard"]).select("tab", "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "id", "vector", "keys")
    dealt = left.unionByName(right).repartition("tab", "shard", "salt").sortWithinPartitions("tab", "shard", "salt", "kind", "bucket")
    return _top(dealt.mapInArrow(_search(k), FOUND).distinct(), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "same"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def prepared(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """The vectors that take part, each id and vector once."""
    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    good = named.where(F.col("id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    first = good.orderBy("id", "vector").limit(1).select(F.size("vector").alias("n")).collect()
    return good.where(F.size("vector") == (first[0].n if first else 0)).dropDuplicates(["id", "vector"])


def longest(spots: DataFrame) -> tuple[int, float]:
    """How many vectors there are, and the greatest length."""
    most = F.array_max(F.transform("vector", F.abs))
    length = most * F.sqrt(F.aggregate(F.transform("vector", lambda x: x / most), F.lit(0.0), lambda a, x: a + x * x))
    r = spots.agg(F.count("*").alias("n"), F.max(length).alias("top")).first()
    return r.n, r.top or 0.0


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k vectors with the largest inner product, found by multiprobe hashing.

    is_query: over a column `id`.
    """
    spark = df.sparkSession
    good = prepared(df, id_col, vector)
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    spots = written(good.withColumn("__copy", copy).where(F.col("__copy") <= k + 1).drop("__copy"), "neighbour-spots")
    n, top = longest(spots)
    asked = good.where(is_query)
    queries = written(asked.select("vector").distinct().withColumn("q", F.monotonically_increasing_id()), "neighbour-queries")
    sample = [(r.q, list(r.vector)) for r in queries.orderBy(F.xxhash64("vector"), "q").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    hashing = fitted(n, top, _true_neighbours(spots, sample, k))
    shards = -(-n // BLOCK)
    index = written(spots.mapInArrow(_indexed(hashing, shards), "tab int, shard bigint, bucket bigint, id bigint, vector array<double>"), "neighbour-index")
    salts = written(index.groupBy("tab", "shard").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("salts")), "neighbour-salts")
    probe = lambda some, everything: some.select("q", "vector").mapInArrow(_probing(hashing, shards, everything), "tab int, shard bigint, keys array<bigint>, id bigint, vector array<double>")
    found = written(_found(index, probe(queries, False), salts, k + 1), "neighbours")
    per = found.groupBy("q").agg(F.count("*").alias("n"))
    short = written(queries.join(per, "q", "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, n)).select("q", "vector"), "neighbour-short")
    if not short.isEmpty():
        again = _found(index, probe(short, True), salts, k + 1)
        whole = written(found.join(short.select("q"), "q", "left_anti").unionByName(again), "neighbours")
        dropped(found)
        found = whole
    dropped(index)
    named = asked.join(queries, "vector").select(F.col("id").alias("query_id"), "q")
    out = named.join(found, "q").where(~(F.col("same") & (F.col("id") == F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _true_neighbours(spots: DataFrame, sample: list[tuple], k: int) -> list[tuple]:
    """(query, its k true neighbours, nearest first) of the sample, by one scan."""
    import numpy as np

    best = _top(spots.mapInArrow(_scan(sample, k + 1), FOUND).distinct(), k + 1).where("not same")
    rows = best.join(spots, "id").select("q", "score", "id", "vector").collect()  # SAMPLE times k
    near: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (-r.score, r.id)):
        near.setdefault(r.q, []).append(list(r.vector))
    return [(np.array(v), np.array(near.get(q, [])[:k])) for q, v in sample]
