"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are its lower-cased words (edges stripped of punctuation),
their stems (first letters), word pairs and skip-grams (two words with one
between), hashed to a fixed number of coordinates; each counts once, and is
learnt if enough sampled texts have it. FTRL keeps a learning rate for each
coordinate and L1 makes the weights sparse; those that remain are broadcast
(their number is bounded by the hash space) to score every text.

The model is fitted on a bounded sample: the `max_rows` labelled rows lowest in
a hash of their id. Scores use the text alone.

Defined results: null text is the empty text, whose score is the bias's;
rows with a null label are not learnt from; repeated rows count each, those of
one id in order of text and label; a null id is scored, but has no label;
without labelled rows every score is 0.5; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
STEM = 5
MAX_ROWS = 20_000
EPOCHS = 12
MIN_DOCS = 3
ALPHA, BETA, L1, L2 = 5.0, 1.0, 8.0, 0.0
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
BUCKETS = 64


class Hashes(dict):
    """The hashes of each word met and of its stem; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        import zlib

        if len(self) > 500_000:
            self.clear()
        bare = EDGE.sub("", word)
        self[word] = h = zlib.crc32(bare.encode()) << 32 | zlib.crc32(bare[:STEM].encode())
        return h


def features(text: str, hashes: Hashes):
    """The distinct coordinates of a text: words, stems, pairs and skip-grams."""
    import numpy as np

    both = np.fromiter(map(hashes.__getitem__, text.lower().split()), np.uint64)
    w, stem = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    mix = np.uint64(0x9E3779B97F4A7C15)

    def joined(a, b, kind):
        return ((a * mix) ^ (b + np.uint64(kind)) * np.uint64(0xC2B2AE3D27D4EB4F)) * mix

    parts = [joined(w, w, 1), joined(stem, stem, 4), joined(w[:-1], w[1:], 2), joined(w[:-2], w[2:], 3)] if len(w) else []
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64) if parts else np.zeros(0, np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal state; coordinate 2 ** BITS is the bias."""

    def __init__(self) -> None:
        import numpy as np

        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at):
        import numpy as np

        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at, label: float) -> None:
        import numpy as np

        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()))))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sample(labels: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """The max_rows rows lowest in a hash of their id; each task keeps its lowest only."""
    return labels.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> dict[int, float]:
    """Sparse weights by coordinate. The sample is learnt by one task, in order of ids, texts and labels, EPOCHS times.

    The sampled labels are broadcast (max_rows of them), so texts without a
    sampled label are never shuffled.
    """
    chosen = sample(labels.where(F.col(label).isNotNull()).select(id_col, F.col(label).cast("double").alias("label")), id_col, max_rows)
    rows = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    rows = rows.repartition(1).sortWithinPartitions(id_col, "text", "label").select("text", "label")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes, seen = Hashes(), []
        for batch in batches:
            seen += [(np.append(features(t, hashes), 1 << BITS), y) for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True)]
        often = np.bincount(np.concatenate([f for f, _ in seen]), minlength=(1 << BITS) + 1) >= MIN_DOCS if seen else None
        seen = [(f[often[f] | (f == 1 << BITS)], y) for f, y in seen]
        model, rng = Ftrl(), np.random.default_rng(7)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(seen)):
                model.learn(*seen[k])
        at = np.arange((1 << BITS) + 1)
        w = model.weights(at)
        at = at[w != 0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "weight"])

    return {r["at"]: r["weight"] for r in rows.mapInArrow(run, "at long, weight double").collect()}


def scored(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        dense, hashes = np.zeros((1 << BITS) + 1), Hashes()
        for at, w in shared.value.items():
            dense[at] = w
        for batch in batches:
            sums = np.array([dense[features(t or "", hashes)].sum() for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(1 / (1 + np.exp(-np.clip(sums + dense[-1], -30, 30))))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double")


def remainder(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod
