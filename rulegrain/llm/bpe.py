"""Byte-level BPE encoding and decoding with a public vocabulary.

A text is cut at special tokens and by the pre-tokenizer's pattern; each piece
becomes a doubly linked list of byte symbols, and a priority queue of merge
ranks joins neighbours, lowest rank first and leftmost among equals. Entries
whose pair is gone are skipped. Pieces repeat, so each task keeps the ids of
those it has met in two generations of a bounded cache. Decoding concatenates
vocabulary strings and turns them back to bytes.

The vocabulary goes to the executors as one broadcast: a file of fixed size.

Defined results: null text is the empty text and has no ids; repeated rows are
encoded each; an empty table gives no rows; other columns pass through, and
those named ids, n_tokens or decoded are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pattern of the byte-level pre-tokenizer; white space as Unicode defines it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CACHED = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + sum(c not in plain for c in range(b))) for b in range(256)]


class Pieces(dict):
    """The ids (little-endian unsigned 32-bit) of pieces met so far; a miss runs the merges."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece) or self.codec.merged(piece.encode())
        self[piece] = ids
        return ids


class Codec:
    def __init__(self, spec: str) -> None:
        import regex

        model = json.loads(spec)
        vocab, letters = model["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.byte_ids = [vocab[c] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in reversed([*enumerate(pairs)])}
        self.made = [vocab[a + b] for a, b in pairs]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Pieces(self)

    def merged(self, piece: bytes) -> bytes:
        ids, n, rank = [self.byte_ids[b] for b in piece], len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 20 | ids[j]) != r:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = self.made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(ids[i] << 20 | ids[k])) is not None:
                    heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 20 | ids[i])) is not None:
                heappush(queue, r << 32 | h)
        return b"".join(i.to_bytes(4, "little") for i in ids if i >= 0)

    def encode(self, text: str) -> bytes:
        ids, find = self.pieces.__getitem__, self.pattern.findall
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(ids, find(text)))
        return b"".join(self.special[part].to_bytes(4, "little") if k % 2 else b"".join(map(ids, find(part))) for k, part in enumerate(self.cut.split(text)))

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _table(docs: DataFrame, spec_path: str, make, column: str, kind: T.DataType) -> DataFrame:
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(open(spec_path, encoding="utf-8").read())

    def run(batches: Iterator) -> Iterator:
        codec = Codec(spec.value)
        for batch in batches:
            yield make(codec, batch)

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField(column, kind)])
    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, spec_path: str, text: str = "text") -> DataFrame:
    """docs with `ids` (binary: little-endian unsigned 32-bit) and `n_tokens`."""

    def make(codec, batch):
        import pyarrow as pa

        ids = [codec.encode(t or "") for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], [*batch.schema.names, "n_tokens", "ids"])

    return _table(docs.drop("ids", "n_tokens"), spec_path, make, "ids", T.BinaryType())


def decoded(tokens: DataFrame, spec_path: str, ids: str = "ids") -> DataFrame:
    """tokens with `decoded`: the vocabulary strings of the ids, concatenated; n_tokens is theirs."""

    def make(codec, batch):
        import pyarrow as pa

        rows = [i or b"" for i in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(i) // 4 for i in rows], pa.int64()), pa.array([codec.decode(i) for i in rows], pa.string())], [*batch.schema.names, "n_tokens", "decoded"])

    return _table(tokens.drop("decoded", "n_tokens"), spec_path, make, "decoded", T.StringType())


def digests(tokens: DataFrame) -> DataFrame:
    """tokens (with ids and decoded) with ids_sha256 and decoded_sha256."""
    return tokens.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)})
