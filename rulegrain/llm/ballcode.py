"""Vector codes: product quantization with integer codebooks, searched by ball trees.

A vector's components become integers floor(scale * x), its parts are the
equal stretches of consecutive components, and each part position has a codebook
that a fixed number of Lloyd rounds improves. The nearest entry is found by
metric branch and bound: a ball tree over the entries of a part position, whose
balls have an entry (the vantage point) as centre and a radius that is rounded
up. A ball is visited unless its bound, rounded down, is strictly beyond the
best squared distance so far, so ties are always met; distances that decide are
whole numbers, ties go to the lower index.

A round is one pass over the vectors: codebooks are broadcast (entries times
dimension, whatever the number of vectors), tasks send one sum for each part
and entry. Codebooks of a part position pass the driver, no vector does.

Integer arithmetic has three widths: sums below 2 ** 53 go through the floating
point matrix product, where they are exact, others below 2 ** 63 through 64-bit
integers, the rest through Python's.

Defined results: vectors that are null, empty or hold null or non-finite
components are dropped, as are those whose length is not that of the kept vector
with the smallest id; a length that the number of parts doesn't divide has its
last parts shorter by one; equal vectors have equal codes; repeated ids give a
row each, and of those the least vector opens the codebook first; a null id
comes first, as Spark sorts; with fewer vectors than entries, the codebook has
as many entries as there are vectors; integers are held within 2 ** 62, errors
within 2 ** 63 - 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 16
LIMIT = 1 << 62
MOST = (1 << 63) - 1
ROWS = 4096


def integers(vectors, scale: int = SCALE):
    """floor(scale * x) of each component, as int64."""
    import math

    import numpy as np

    x = np.asarray(vectors, np.float64)
    if x.size == 0 or np.abs(x).max() < 2.0**52 / scale:
        return np.floor(x * scale).astype(np.int64)
    # a component of 2 ** 52 or more is whole
    whole = [[int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale) for v in row] for row in x.tolist()]
    return np.array([[max(-LIMIT, min(LIMIT, v)) for v in row] for row in whole], np.int64)


def room(x, entries) -> int:
    """No squared distance between rows of the two is larger."""
    import numpy as np

    return x.shape[1] * (2 * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))) ** 2


def squares(x, entries):
    """Exact squared distances of rows x to entries, one column for each entry."""
    import numpy as np

    most = room(x, entries)
    if most < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    if most >= 1 << 63:
        x, entries = x.astype(object), entries.astype(object)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


@dataclass
class Ball:
    """Entries `members` within `radius` (rounded up) of entry `centre`; a leaf, or two halves."""

    members: list[int]
    centre: int
    radius: float
    halves: tuple[Ball, Ball] | None = None


class BallTree:
    """The nearest entry of many points at once."""

    def __init__(self, entries):
        self.entries = entries
        self.root = self.ball(list(range(len(entries))))

    def apart(self, x, centre: int):
        """Distances in floating point, and how far they can be off."""
        import numpy as np

        d = np.sqrt(squares(x, self.entries[centre : centre + 1])[:, 0].astype(np.float64))
        return d, 1e-12 * d

    def ball(self, members: list[int]) -> Ball:
        import numpy as np

        mean = self.entries[members].astype(np.float64).mean(axis=0)
        centre = members[int(((self.entries[members] - mean) ** 2).sum(axis=1).argmin())]
        d, off = self.apart(self.entries[members], centre)
        out = Ball(members, centre, float(np.nextafter((d + off).max(), np.inf)))
        if len(members) > LEAF and d.max() > 0:
            far = members[int(d.argmax())]  # the vantage point: nearer half, farther half
            order = np.argsort(self.apart(self.entries[members], far)[0], kind="stable")
            cut = len(members) // 2
            out.halves = self.ball(sorted(members[k] for k in order[:cut])), self.ball(sorted(members[k] for k in order[cut:]))
        return out

    def nearest(self, x):
        """(index, squared distance) of each row's nearest entry, the lower index of equals."""
        import numpy as np

        best = np.full(len(x), -1, np.int64)
        most = room(x, self.entries)
        least = np.full(len(x), most + 1, np.int64 if most < MOST else object)
        self.visit(self.root, x, np.arange(len(x)), best, least)
        return best, least

    def visit(self, ball: Ball, x, rows, best, least) -> None:
        import numpy as np

        if not len(rows):
            return
        if ball.halves is None:
            d = squares(x[rows], self.entries[ball.members])
            k = d.argmin(axis=1)  # members ascend: the first of equals is the lowest
            d, k = d[np.arange(len(rows)), k], np.asarray(ball.members)[k]
            better = (d < least[rows]) | (d == least[rows]) & (k < best[rows])
            least[rows[better]], best[rows[better]] = d[better], k[better]
            return
        bounds = []
        for half in ball.halves:
            d, off = self.apart(x[rows], half.centre)
            bounds.append(np.maximum(0.0, d - off - half.radius))
        left = bounds[0] <= bounds[1]
        for near, mine in ((0, left), (1, ~left)):
            for k in (near, 1 - near):
                # not strictly beyond the best: a ball at the same distance may hold a lower index
                open_ = mine & (bounds[k] * (1 - 1e-12) <= np.sqrt(least[rows].astype(np.float64)) * (1 + 1e-12))
                self.visit(ball.halves[k], x, rows[open_], best, least)


def parts_of(dimension: int, parts: int = PARTS) -> list[slice]:
    """Where each part lies."""
    small, more = divmod(dimension, parts)
    ends = [0]
    for k in range(parts):
        ends.append(ends[-1] + small + (k < more))
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def usable(vector: Column) -> Column:
    """Whether a vector has components, and all of them numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def rows_of(column, scale: int):
    """The integer vectors of an Arrow list column."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1)), scale)


def _sums(books: list, scale: int):
    """Partial sums of a task: for each part and entry how many parts it got, and their sum as decimals."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        trees = [BallTree(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        dimension = sum(b.shape[1] for b in books)
        for batch in batches:
            x = rows_of(batch.column("vector"), scale)
            for at in range(0, len(x), ROWS):
                block = x[at : at + ROWS]
                narrow = len(block) == 0 or int(np.abs(block).max()) < 1 << 48  # a block's sums fit 64 bits
                for k, where in enumerate(parts_of(dimension, len(books))):
                    index, _ = trees[k].nearest(block[:, where])
                    counts[k] += np.bincount(index, minlength=len(books[k]))
                    add = np.zeros(books[k].shape, np.int64 if narrow else object)
                    np.add.at(add, index, block[:, where] if narrow else block[:, where].astype(object))
                    totals[k] += add.astype(object)
        rows = [(k, e, int(counts[k][e]), [str(v) for v in totals[k][e]]) for k in range(len(books)) for e in np.flatnonzero(counts[k]).tolist()]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "entry", "n", "total"])

    return run


def _coded(books: list, scale: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        trees = [BallTree(b) for b in books]
        dimension = sum(b.shape[1] for b in books)
        for batch in batches:
            x = rows_of(batch.column("vector"), scale)
            codes, errors = np.zeros((len(x), len(books)), np.int64), [0] * len(x)
            for at in range(0, len(x), ROWS):
                block = x[at : at + ROWS]
                for k, where in enumerate(parts_of(dimension, len(books))):
                    index, least = trees[k].nearest(block[:, where])
                    codes[at : at + ROWS, k] = index
                    errors[at : at + ROWS] = [a + b for a, b in zip(errors[at : at + ROWS], least.tolist(), strict=True)]
            columns = [pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array([min(MOST, e) for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label")), *columns], ["id", "label", "entries", "error"])

    return run


@dataclass
class Codebooks:
    """The entries of each part position, and how vectors become integers."""

    books: list
    scale: int

    def sha256(self) -> str:
        """Of all entries' decimal integers by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books for row in b.tolist() for v in row).encode()).hexdigest()


def kept_vectors(df: DataFrame, id_col: str, vector: str, label: str | None) -> tuple[DataFrame, int]:
    """The vectors that take part (id, label, vector), and their dimension; 0 where there are none."""
    named = df.select(F.col(id_col).alias("id"), F.col(label).alias("label") if label else F.lit(None).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    good = named.where(usable(F.col("vector")))
    first = good.orderBy("id", "vector").limit(1).select(F.size("vector").alias("n")).collect()
    n = first[0].n if first else 0
    return good.where(F.size("vector") == n), n


def fitted(good: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks that open with the parts of the vectors of the smallest ids, after the rounds."""
    import numpy as np

    first = good.orderBy("id", "vector").limit(entries).select("vector").collect()
    start = integers([list(r.vector) for r in first], scale)
    where = parts_of(dimension, parts)
    books = [start[:, w].copy() for w in where]
    for _ in range(rounds):
        partial = good.select("vector").mapInArrow(_sums(books, scale), "part int, entry int, n bigint, total array<string>")
        width = max(b.shape[1] for b in books)
        sums = [F.sum(F.get("total", F.lit(j)).cast("decimal(38,0)")).alias(f"t{j}") for j in range(width)]
        books = [b.copy() for b in books]
        # a row for each part and entry
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            b = books[r.part]
            b[r.entry] = np.array([int(r[f"t{j}"]) // r.n for j in range(b.shape[1])], np.int64)
    return Codebooks(books, scale)


def coded(good: DataFrame, codebooks: Codebooks) -> DataFrame:
    """id, label, entries (an index for each part) and error of each vector."""
    fields = {f.name: f.dataType.simpleString() for f in good.schema}
    schema = f"id {fields['id']}, label {fields['label']}, entries array<int>, error bigint"
    return good.select("id", "label", "vector").mapInArrow(_coded(codebooks.books, codebooks.scale), schema)


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: the errors of equal labels summed, nulls together.

    A sum for each label leaves every task; Spark broadcasts the sums where they
    are small and splits a hot label's rows where they aren't.
    """
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    other = sums.select(F.col("label").alias("__label"), "label_error")
    return codes.join(other, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def compressed(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """id, label, entries, error, label_error of each vector that takes part, and the codebooks.

    entries may be 256 at most where codes are to be bytes.
    """
    good, dimension = kept_vectors(df, id_col, vector, label)
    if not dimension:
        codebooks, empty = Codebooks([], scale), good.select("id", "label", F.array().cast("array<int>").alias("entries"), F.lit(0).cast("long").alias("error"))
        return with_label_error(empty).withColumnRenamed("id", id_col), codebooks
    codebooks = fitted(good, dimension, parts, entries, rounds, scale)
    codes = written(coded(good, codebooks), "vector-codes")  # read twice: for its rows and for the labels' sums
    return with_label_error(codes).withColumnRenamed("id", id_col), codebooks


def hex_code(entries: Column) -> Column:
    """Two lowercase hex digits for each entry."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")


def oracle(table: str = "embeddings", parts: int = PARTS, dimension: int = 64, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The whole method in DuckDB SQL: every part against every entry."""
    w = dimension // parts
    distance = " + ".join(f"(p.x[{j}] - b.c[{j}]) * (p.x[{j}] - b.c[{j}])" for j in range(1, w + 1))
    mean = ", ".join(f"((sum(x[{j}]) - (((sum(x[{j}]) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT" for j in range(1, w + 1))
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, x, unnest(min_by({{'e': entry, 'd': d}}, (d, entry), 1)) AS hit FROM (SELECT p.vec_id, p.part, p.x, b.entry, ({distance}) AS d FROM parts p JOIN b{k} b USING (part)) GROUP BY vec_id, part, x)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT part, hit.e AS entry, [{mean}] AS c FROM a{k} GROUP BY ALL), b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))")
    return f"""
WITH good AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, x[part * {w} + 1 : part * {w} + {w}] AS x FROM good, (SELECT unnest(range({parts})) AS part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM good QUALIFY entry < {entries}),
b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM parts JOIN first USING (vec_id)),
{", ".join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(hit.e)), 2, '0'), '' ORDER BY part) AS code, sum(hit.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN good USING (vec_id), sha"""
