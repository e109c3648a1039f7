"""Jaccard join of word n-gram sets by PartEnum signatures.

A document's set holds the distinct n-word shingles of its text. Sets fall into
bands of sizes that can be similar; similar sets differ in at most k shingles,
k known for each band. The domain of shingles is cut into parts and each part
into sub-parts: with few enough parts, similar sets agree in all but k2
sub-parts of some part, so the signatures made of each choice of n2 - k2
sub-parts hold one that both sets have. A set signs for its own band and the
next. Signatures of nothing are left out: a set signs parts until enough of
them have no empty choice, and where parts run out it signs again with another
seed, so no link is lost.

Equal sets share a key and sign as one. Sets that share a signature are first
compared with the bucket's smallest only, and the links found make components.
Buckets that still hold more than one component are looked at again: within a
task, sketches of the members are compared across components in blocks, and
each member asks for the nearest pairs that the sketches allow. Those are
compared and their links join components, until no member has asked for less
than all its pairs with other components. Very large buckets are dealt out by
blocks. So rows follow members, not pairs, and every link between different
texts counts.

Shingles and sets are told apart by 64-bit and 128-bit hashes.

Defined results: null and empty texts have no shingles and link with nothing;
a text with fewer words is one shingle; repeated rows count as equal
documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import slices, written
from rulegrain.llm.components import components

BLOCK = 2_000  # members whose sketches are compared at once
STRIP = 100  # members of a block that are compared with another block at once
TASK_MEMBERS = 8_000
PAIRS_A_TASK = 500
BROADCAST_IDS = 500_000
SEEDS = 4
MOST_CLASHING = 1_000
FIRST_ASKED, ASKED_GROWTH = 2, 16  # pairs that a member of an open bucket asks for, and their growth each round


def hashed_words(text: str | None):
    """The hashes (uint64) of a text's words, in order."""
    import numpy as np
    from xxhash import xxh3_64_digest

    return np.frombuffer(b"".join(map(xxh3_64_digest, (text or "").encode().lower().split())), np.uint64)


def mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None, n: int):
    """The sorted distinct hashes of a text's n-word shingles (uint64)."""
    import numpy as np

    w = hashed_words(text)
    if not len(w):
        return w
    size = min(n, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
    out.sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    return out[first]


def band_of(size: int, p: int, q: int) -> tuple[int, int, int]:
    """(number, lowest, highest size) of the band that holds `size`; similarity p / q."""
    at, low = 0, 1
    while (high := low * q // p) < size:
        at, low = at + 1, high + 1
    return at, low, high


def shape(high: int, p: int, q: int) -> tuple[int, int, int]:
    """(parts, sub-parts, k2) for a band whose largest size is `high`."""
    k = 2 * high * (q - p) // (q + p)
    k2, n2 = (1, 3) if k >= 3 else (0, 1)
    need = -(-(k + 1) // (k2 + 1))
    return need + 2 + need // 8, n2, k2


def spaces(size: int, p: int, q: int) -> list[tuple[int, int, int, int, int]]:
    """For its own band and the next: (band, parts, sub-parts, k2, parts that a set of this size must sign)."""
    at, _, high = band_of(size, p, q)
    most = size * q // p
    out = []
    for band, top, partner in ((at, high, min(high, most)), (at + 1, (high + 1) * q // p, most if most > high else 0)):
        if partner and (k := (size + partner) * (q - p) // (q + p)):
            parts, n2, k2 = shape(top, p, q)
            out.append((band, parts, n2, k2, -(-(k + 1) // (k2 + 1))))
    return out


def signatures(s, p: int, q: int, seed: int = 0):
    """The signatures (int64) of a set of shingle hashes."""
    import numpy as np

    out = []
    for band, parts, n2, k2, need in spaces(len(s), p, q):
        for again in range(SEEDS):
            salt = np.array([(seed * SEEDS + again) << 32 | band], np.uint64)
            g = mixed(s ^ mixed(salt + np.uint64(1)))
            cell = ((g >> np.uint64(33)) % np.uint64(parts * n2)).astype(np.int64)
            sums = np.zeros(parts * n2, np.uint64)
            np.add.at(sums, cell, mixed(g))
            filled = np.zeros(parts * n2, bool)
            filled[cell] = True
            sums, filled = mixed(sums + np.arange(parts * n2, dtype=np.uint64)).reshape(parts, n2), filled.reshape(parts, n2)
            if k2:  # each choice of n2 - 1 sub-parts leaves one out
                sums, some = sums.sum(axis=1, dtype=np.uint64, keepdims=True) - sums, filled.sum(axis=1, keepdims=True) > filled
            else:
                some = filled
            sig = mixed(sums ^ mixed(salt + np.arange(7, 7 + n2, dtype=np.uint64)))
            full = np.cumsum(some.all(axis=1))
            last = int(np.searchsorted(full, need)) + 1
            some[last:] = False
            out.append(sig[some])
            if full[-1] >= need:
                break
        else:
            out.append(np.array([mixed(np.array([(1 << 60) + seed * 1_000_003 + band], np.uint64))[0]]))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def sketch(s) -> bytes:
    """Parities of a set over a power of two of cells, eight for each shingle at least. Where two
    sketches differ, the sets differ: in no fewer shingles than cells."""
    import numpy as np

    cells = max(64, 8 << (len(s) - 1).bit_length())
    at = (mixed(s) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The cells in which two sketches differ, the larger folded to the smaller."""
    import numpy as np

    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    few = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, few), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def described(docs: DataFrame, n: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (a key of the set, null without shingles), check (a second key), sketch."""

    def run(batches: Iterator) -> Iterator:
        from hashlib import blake2b

        import pyarrow as pa

        for batch in slices(batches):
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            part = lambda a, b: pa.array([k and int.from_bytes(k[a:b], "little", signed=True) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), part(0, 8), part(8, 16), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "node", "check", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, node long, check long, sketch binary")


def signed(texts: DataFrame, n: int, p: int, q: int, seed: int = 0, clashing: frozenset = frozenset()) -> DataFrame:
    """texts (doc_id, text) to (sig, node); a task signs equal sets once while it remembers them.

    Sets whose key is in `clashing` have their second key instead.
    """

    def run(batches: Iterator) -> Iterator:
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        seen: set[int] = set()
        for batch in slices(batches):
            sigs, nodes = [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, n)
                digest = blake2b(s.tobytes(), digest_size=16).digest()
                node, check = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
                node = check if node in clashing else node
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                mine = signatures(s, p, q, seed)
                sigs.append(mine)
                nodes.append(np.full(len(mine), node))
            if len(seen) > 1_000_000:
                seen.clear()
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], ["sig", "node"])

    return texts.select("text").mapInArrow(run, "sig long, node long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(sig, node) to (sig, node, first): the buckets of two sets or more, read as a stream in sorted order."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, first, written_first = None, None, False  # the last row, its bucket's first node, whether that is out
        for batch in batches:
            sig, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
            if last is not None:
                sig, node = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], node])
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            begins = np.ones(len(sig), bool)
            begins[1:] = sig[1:] != sig[:-1]
            firsts = node[np.maximum.accumulate(np.where(begins, np.arange(len(sig)), 0))]
            if last is not None:
                firsts[: (np.flatnonzero(begins[1:])[0] + 1) if begins[1:].any() else len(sig)] = first
            member = fresh & (node != firsts)
            if last is not None:
                member[0] = False  # it was the last row of the batch before
            ids = np.cumsum(begins) - 1
            has = np.zeros(ids[-1] + 1, bool)
            has[ids[member]] = True
            lead = np.zeros(len(sig), bool)
            lead[np.flatnonzero(begins)[has]] = True
            if last is not None and lead[0]:
                lead[0] = not written_first
            out = member | lead
            carried = ids[-1] == 0 and last is not None
            written_first = bool(has[-1]) or (carried and written_first)
            heads = np.where(lead, firsts, node)
            first, last = firsts[-1], (sig[-1], node[-1])
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(heads[out]), pa.array(firsts[out])], ["sig", "node", "first"])

    return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "sig long, node long, first long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents; ids are broadcast only where they are few."""
    ids = written(ids, "near-need")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id")


def _possible(pairs: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b, sizes and sketches) less those whose sketches differ in more cells than similar sets do."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "size", "x_sketch", "y_sketch")), strict=True)
            keep = [(a, b) for a, b, size, x, y in rows if apart(x, y) <= size * (q - p) // (q + p)]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _asked(x, y, p: int, q: int, most: int):
    """The places in blocks x and y (components, sizes, sketches) of the pairs asked for, and whether a member has more.

    A strip of x at a time, so that what is held follows STRIP and not the square of a block.
    """
    import numpy as np

    (ca, na, ka), (cb, nb, kb) = x, y
    few = min(ka.shape[1], kb.shape[1])
    fold = lambda k, to: np.bitwise_xor.reduce(k.reshape(len(k), -1, to), axis=1)
    ka, kb = fold(ka, few), fold(kb, few)
    coarse = max(8, few // 8)
    la, lb = fold(ka, coarse), fold(kb, coarse)  # most pairs differ enough in these
    out, cut = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], False
    for start in range(0, len(ca), STRIP):
        here = slice(start, start + STRIP)
        near = (ca[here, None] != cb[None, :]) & (q * np.minimum(na[here, None], nb[None, :]) >= p * np.maximum(na[here, None], nb[None, :]))
        i, j = np.nonzero(near)
        i += start
        some = [(i[:0], j[:0], i[:0])]
        at_once = max(1, 4_000_000 // few)
        for s in range(0, len(i), at_once):
            ii, jj = i[s : s + at_once], j[s : s + at_once]
            most_apart = (na[ii] + nb[jj]) * (q - p) // (q + p)
            ok = np.bitwise_count(la[ii] ^ lb[jj]).sum(axis=1, dtype=np.int64) <= most_apart
            ii, jj, most_apart = ii[ok], jj[ok], most_apart[ok]
            differ = np.bitwise_count(ka[ii] ^ kb[jj]).sum(axis=1, dtype=np.int64)
            ok = differ <= most_apart
            some.append((ii[ok], jj[ok], differ[ok]))
        i, j, differ = (np.concatenate(c) for c in zip(*some, strict=True))
        order = np.lexsort((j, differ, i))
        i, j = i[order], j[order]
        begins = np.ones(len(i), bool)
        begins[1:] = i[1:] != i[:-1]
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(begins, np.arange(len(i)), 0))
        out.append((i[place < most], j[place < most]))
        cut |= bool((place >= most).any())
    i, j = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, j, cut


def _crossing(rows: DataFrame, p: int, q: int, most: int) -> DataFrame:
    """Members of open buckets (part, sig, component, rep, size, sketch) to pairs (a, b) of different
    components that sizes and sketches allow. A part is a bucket or a block of one.

    A member asks for its `most` nearest pairs in each block, by sketches; where it has
    more, its part and sig stand beside the pairs, else nulls.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def compare(group: list) -> pa.RecordBatch | None:
            """group: rows of one part; those with sketches of one length form blocks."""
            by: dict[int, list] = {}
            for r in group:
                by.setdefault(len(r[5]), []).append(r)
            blocks = []
            for rows in by.values():
                for s in range(0, len(rows), BLOCK):
                    _, _, c, rep, n, k = zip(*rows[s : s + BLOCK], strict=True)
                    blocks.append((np.array(rep), (np.array(c), np.array(n), np.frombuffer(b"".join(k), np.uint8).reshape(len(k), -1))))
            pairs, cut = set(), False
            for s, (reps, x) in enumerate(blocks):
                for others, y in blocks[s:]:
                    i, j, more = _asked(x, y, p, q, most)
                    cut |= more
                    pairs.update(zip(np.minimum(reps[i], others[j]).tolist(), np.maximum(reps[i], others[j]).tolist(), strict=True))
            again = group[0][:2] if cut else (None, None)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*zip(*pairs, strict=True), *([x] * len(pairs) for x in again))], ["a", "b", "part", "sig"]) if pairs else None

        group: list = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("part", "sig", "component", "rep", "size", "sketch")), strict=True):
                if group and group[0][0] != r[0]:
                    if (out := compare(group)) is not None:
                        yield out
                    group = []
                group.append(r)
        if group and (out := compare(group)) is not None:
            yield out

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long, part long, sig long")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids, those whose sets are similar.

    Texts travel once for each pair, and that of `a` once for each task's share
    of its pairs: an `a` with many pairs is split.
    """
    texts = _texts(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).alias("shares"))
    dealt = pairs.join(share, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")))
    heads = dealt.select("a", "share").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    tails = dealt.select("a", "share", "b").join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "share", "b", "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        head = None
        for batch in slices(batches):
            found = []
            for a, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                s = shingles(t, n)
                if b is None:
                    head = s
                    continue
                both = len(np.intersect1d(head, s, assume_unique=True))
                if q * both >= p * (len(head) + len(s) - both):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    rows = heads.unionByName(tails).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def _one_of_each(buckets: DataFrame) -> DataFrame:
    """buckets (sig, node) less those of two sets, which their first has met, and of buckets with the same members all but one.

    Similar sets share many signatures, mostly with the same others. Members are told apart by a 128-bit hash.
    """
    both = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    kinds = buckets.groupBy("sig").agg(F.count("*").alias("members"), *both).where("members > 2")
    return buckets.join(kinds.groupBy("members", "h0", "h1").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def _open_members(buckets: DataFrame, classes: DataFrame, labels: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(part, sig, component, rep, size, sketch): the members of buckets that hold several components.

    A member of a bucket of several blocks goes to each part that pairs its block with another.
    again: the parts (part, sig) to look at, where not all. In others every pair between components was asked for.
    """
    if again is not None:
        buckets = buckets.join(again.select("sig").distinct(), "sig", "left_semi")
    label = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("component"))
    members = buckets.select("sig", "node").join(label, "node")
    several = members.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi and members > 2")
    rest = members.join(several.select("sig", F.ceil(F.col("members") / TASK_MEMBERS).alias("blocks")), "sig").join(classes.select("node", "size", "sketch"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.xxhash64("sig", F.least(k, block), F.greatest(k, block)))
    dealt = rest.select(F.explode(parts).alias("part"), "sig", "component", "rep", "size", "sketch")
    return dealt if again is None else dealt.join(again.select("part").distinct(), "part", "left_semi")


def linked(docs: DataFrame, n: int = 5, p: int = 8, q: int = 10, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, components): sets has doc_id, n_shingles, node and rep (the smallest doc_id with
    that set); components has node (a rep) and component, for sets linked with another.

    Two sets link when q * intersection >= p * union.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    plain = written(described(docs, n), "near-sets")
    classes_of = lambda sets: written(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch"), (F.min("check") != F.max("check")).alias("clash")), "near-classes")
    classes = classes_of(plain)
    # different sets with one 64-bit key, about one in 6e9 sets: they go by the digest's second half
    clashing = frozenset(r.node for r in classes.where("clash").select("node").limit(MOST_CLASHING + 1).collect())
    if clashing:
        plain = plain.withColumn("node", F.when(F.col("node").isin(*clashing), F.col("check")).otherwise(F.col("node")))
        classes = classes_of(plain)
        if len(clashing) > MOST_CLASHING or classes.where("clash").limit(1).count():
            raise ValueError("too many different sets with one 64-bit key")
    names = classes.select("node", "rep")
    by = lambda c: classes.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep"), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))

    def candidates(keys: DataFrame) -> DataFrame:
        """keys (x, y: nodes) to pairs (a, b) of doc_ids that sizes and sketches don't rule out."""
        sized = keys.distinct().join(by("x"), "x").join(by("y"), "y")
        sized = sized.where(q * F.least("x_size", "y_size") >= p * F.greatest("x_size", "y_size"))
        return _possible(sized.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"), (F.col("x_size") + F.col("y_size")).alias("size"), "x_sketch", "y_sketch"), p, q)

    buckets = written(shared_buckets(signed(docs, n, p, q, clashing=clashing)), "near-buckets")
    tested = written(candidates(buckets.where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))), "near-pairs")
    links = written(_verified(tested, docs, n, p, q), "near-links")
    labels = written(components(links), "near-components")
    # buckets of several components: their other pairs between components, nearest first, until none is left
    canon = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tested, most, again = canon(tested), FIRST_ASKED, None
    buckets = written(_one_of_each(buckets.select("sig", "node")), "near-buckets")
    while True:
        asked = written(_crossing(_open_members(buckets, classes, labels, again), p, q, most), "near-pairs")
        again = written(asked.where("part is not null").select("part", "sig").distinct(), "near-again")
        fresh = written(asked.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
        if fresh.limit(1).count():
            links = links.unionByName(written(_verified(fresh, docs, n, p, q), "near-links"))
            labels = written(components(links), "near-components")
            tested = tested.unionByName(fresh)
        if not again.limit(1).count():
            break
        most *= ASKED_GROWTH
    sets = plain.join(names.select("node", "rep"), "node", "left").select("doc_id", "n_shingles", "node", "rep")
    return sets, labels


def near_groups(docs: DataFrame, n: int = 5, p: int = 8, q: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    sets, labels = linked(docs, n, p, q, id_col, text)
    out = sets.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
