"""Exact deduplication with an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text. A directory maps the leading
bits of a key to a bucket; a bucket with more bytes of text than its capacity
splits and, where its depth is the directory's, the directory doubles. Entries
go to the task that owns their bucket's key range; owners read their entries in
key order, chain texts whose keys collide and compare bytes. The directory and
the index (one row for each distinct text) are written to the shared folder.

Copies are merged inside each map task first, so a group of copies sends one
row from each task. A document finds its bucket in the directory and its group
among the bucket's rows, by a join where Spark splits a hot key's rows.

Defined results: null text is the empty text; all empty texts are one group;
repeated rows (same id and text) count each and keep the same id; a null id
stays only where its group has no other; an empty table gives no rows; extra
columns are ignored. Ids are of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import WHITE, slices, written

ENTRY = "bucket int, h long, norm string, keep_id {id}, n long"
INDEX = "bucket int, h long, chain int, text_sha256 string, keep_id {id}, group_size long"
CAPACITY = 32 << 20  # bytes of distinct texts in a bucket
ROW_BYTES = 100  # that a row takes beside its text
BROADCAST_SLOTS = 1 << 20
HELD_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def build_directory(slots: dict[int, int], fine: int, capacity: int) -> list[int]:
    """slots: bytes for each value of the `fine` leading bits. Returns the bucket of each
    directory entry; the list has 2 ** depth entries."""
    depth, buckets, done = 0, [(0, 0)], []
    sums = {fine: slots}
    for d in range(fine - 1, -1, -1):
        up: dict[int, int] = {}
        for s, n in sums[d + 1].items():
            up[s >> 1] = up.get(s >> 1, 0) + n
        sums[d] = up
    while buckets:
        prefix, local = buckets.pop()
        if sums[local].get(prefix, 0) <= capacity or local == fine:
            done.append((prefix, local))
            continue
        depth = max(depth, local + 1)  # the directory doubles when the split bucket is as deep as it is
        buckets += [(prefix << 1 | 1, local + 1), (prefix << 1, local + 1)]
    directory = [0] * (1 << depth)
    for bucket, (prefix, local) in enumerate(sorted(done, key=lambda b: b[0] << (fine - b[1]))):
        first = prefix << (depth - local)
        directory[first : first + (1 << (depth - local))] = [bucket] * (1 << (depth - local))
    return directory


def directory_of(keys: DataFrame, capacity: int) -> list[int]:
    """The directory for a table with columns h, text_sha256, size. What is collected is the
    bytes of each slot, of which there are 8 at most for each bucket's worth of bytes."""
    distinct = written(keys.groupBy("h", "text_sha256").agg((F.max("size") + ROW_BYTES).alias("size")), "exact-sizes")
    total = distinct.agg(F.sum("size").alias("n")).first().n or 0
    fine = (total // max(1, capacity)).bit_length() + 2
    sums = distinct.groupBy(F.shiftrightunsigned("h", 64 - fine).alias("slot")).agg(F.sum("size").alias("n"))
    return build_directory({r.slot: r.n for r in sums.collect()}, fine, capacity)


def depth_of(directory: list[int]) -> int:
    return (len(directory) - 1).bit_length()


def slot_of(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def stored_directory(directory: list[int], keys: DataFrame) -> DataFrame:
    """The directory as a table (slot, bucket) in the shared folder."""
    rows = list(enumerate(directory))
    return written(keys.sparkSession.createDataFrame(rows, "slot long, bucket int"), "exact-directory")


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _combine(directory: list[int]):
    """Merge a task's copies: one entry for each distinct text held, flushed by size."""
    depth = depth_of(directory)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, list] = {}
        size, id_type = 0, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*((directory[(h & (1 << 64) - 1) >> (64 - depth)] if depth else 0, h, t, i, n) for t, (h, i, n) in held.items()), strict=True))
            types = (pa.int32(), pa.int64(), pa.string(), id_type, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["bucket", "h", "norm", "keep_id", "n"])

        for batch in slices(batches):
            id_type = batch.column("id").type
            for i, h, t in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(), batch.column("norm").to_pylist(), strict=True):
                if (e := held.get(t)) is None:
                    held[t] = [h, i, 1]
                    size += len(t) + 200
                    if size > HELD_BYTES:
                        yield flush()
                        held, size = {}, 0
                else:
                    e[1], e[2] = _least(e[1], i), e[2] + 1
        if held:
            yield flush()

    return run


def _own(batches: Iterator) -> Iterator:
    """Entries in order of (bucket, h): chain the texts of a key, compare bytes, emit index rows."""
    import hashlib

    import pyarrow as pa

    names = ["bucket", "h", "chain", "text_sha256", "keep_id", "group_size"]
    id_type = None
    at, chain, out = None, [], []

    def close() -> None:
        seen = set()
        for place, (text, keep, n) in enumerate(chain):
            sha = hashlib.sha256(text.encode()).hexdigest()
            if sha in seen:
                raise ValueError(f"two texts with key {at[1]} have the same SHA-256")
            seen.add(sha)
            out.append((*at, place, sha, keep, n))

    def rows() -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int32(), pa.string(), id_type, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names)

    for batch in slices(batches):
        id_type = batch.column("keep_id").type
        for b, h, t, i, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "norm", "keep_id", "n")), strict=True):
            if at != (b, h):
                close()
                at, chain = (b, h), []
                if len(out) >= 10_000:
                    yield rows()
                    out = []
            for link in chain:
                if link[0] == t:
                    link[1], link[2] = _least(link[1], i), link[2] + n
                    break
            else:
                chain.append([t, i, n])
    close()
    if out:
        yield rows()


def build_index(docs: DataFrame, directory: list[int], id_col: str = "doc_id", text: str = "text", key=F.xxhash64) -> DataFrame:
    """The index over docs, written to the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    norm = normalised(F.col(text))
    entries = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", key(F.col("norm"))).mapInArrow(_combine(directory), ENTRY.format(id=kind))
    owned = entries.repartition("bucket").sortWithinPartitions("bucket", "h")
    return written(owned.mapInArrow(_own, INDEX.format(id=kind)), "exact-index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, key=F.xxhash64) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(F.col(text))
    keys = docs.select(F.col(id_col), norm.alias("norm")).select(id_col, key(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("size"))
    keys = written(keys, "exact-keys")
    directory = directory_of(keys, capacity)
    index = build_index(docs, directory, id_col, text, key)
    slots = stored_directory(directory, keys)
    slots = F.broadcast(slots) if len(directory) <= BROADCAST_SLOTS else slots
    placed = keys.withColumn("slot", slot_of(F.col("h"), depth_of(directory))).join(slots, "slot")
    found = placed.join(index.select("bucket", "h", "text_sha256", "keep_id", "group_size"), ["bucket", "h", "text_sha256"])
    return found.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
