"""Brown class-based n-gram model: exchange clustering, then class bigrams.

Training, each step over all training texts:

1. Words are counted.
2. The HEAD most frequent words are clustered by exchange. In each round tasks
   count every head word's neighbours by class, and a group of the words moves,
   each to the class that raises the class-bigram likelihood most, its own
   counts taken out first; a round that lowered it is undone. The counts are bounded (words x classes), so are the classes.
3. Every other word goes to the class that fits its neighbours' classes best:
   one exchange step against the fixed classes.
4. Transitions between classes are counted again over all words, contexts as in
   scoring. These counts and discounted emission counts make
   p(word | class of the last common word before it)
     = (1 - MIX) * p(class | class before) * p(word | class) + MIX * p_base(word).
   The discounts of a class are its probability of an unknown word, which is
   one event, as in the base model. A common word is one of the COMMON most
   frequent; only those serve as context.

Scoring looks the common words up in a broadcast of bounded size (COMMON words
of MAX_BYTES at most); rarer ones are joined with the whole vocabulary.

Tokens: A-Z lower-cased, words between ASCII white space, then one end.

Defined results: null text is the empty text (one token, the end); repeated
rows count and are scored each; an empty table gives no rows; without training
texts every token has the base model's probability; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import dropped, slices, written

HEAD, COMMON, MAX_BYTES = 32_768, 200_000, 64
CLASSES = 48
TAIL, STOP = CLASSES, CLASSES + 1  # the classes of other words, and of the end
WIDTH = CLASSES + 2
ROUNDS = 8
BLOCK = 256
MIX = 0.02
MU = 5.0
HELD = 150_000  # counts that a task holds before it hands them on
TEXTS = 500  # coded texts that are counted at once
WORDS = 100_000  # words that are looked up at once
END = b""


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; the end is not among them."""
    return (text or "").encode().lower().split()


def shares(texts: list[str | None]) -> Iterator:
    """(place of the first, words, tokens of each) of neighbouring texts, about WORDS words together; an end follows each text's words."""
    first, words, many = 0, [], []
    for k, t in enumerate(texts):
        before = len(words)
        words += tokens(t)
        words.append(END)
        many.append(len(words) - before)
        if len(words) >= WORDS:
            yield first, words, many
            first, words, many = k + 1, [], []
    if many:
        yield first, words, many


def found(places: dict[bytes, int], words: list[bytes], other: int):
    """What places has for each word; `other` for those not in it."""
    import numpy as np

    return np.fromiter(map(places.get, words, repeat(other)), np.int64, len(words))


def last_before(c, common):
    """Of c (one value for each token), the one of the last common token before each; STOP before the first. An end is common."""
    import numpy as np

    seen = np.where(common, np.arange(1, len(c) + 1), 0)
    return np.concatenate([[STOP], c])[np.concatenate([[0], np.maximum.accumulate(seen)[:-1]])]


def word_counts(texts: DataFrame) -> DataFrame:
    """texts (text) to (word, n); the end is the empty word."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                seen.update(tokens(t))
                seen[END] += 1
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def top_words(vocabulary: DataFrame, many: int) -> list:
    """The most frequent words of bounded length; each task sends its best only."""
    return vocabulary.where((F.col("word") != F.lit(b"")) & (F.octet_length("word") <= MAX_BYTES)).orderBy(F.desc("n"), "word").limit(many).collect()


def coded(texts: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """ids (binary, little-endian uint16) of each text: places in the head; the size of the head for other words."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        places, other = shared.value, len(shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([found(places, tokens(t), other).astype("<u2").tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["ids"])

    return texts.mapInArrow(run, "ids binary")


def neighbour_counts(ids: DataFrame, classes) -> DataFrame:
    """(block, before, after): for each word of a block, its neighbours by class, as int64 matrices.

    Tasks send the cells that they counted, so what travels follows their texts
    and not the size of the matrices.
    """
    import numpy as np

    many = len(classes)
    shared = ids.sparkSession.sparkContext.broadcast(np.append(classes, [TAIL, STOP]))
    cells = 2 * BLOCK * WIDTH  # of a block: before and after in turn for each word

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        of = shared.value.astype(np.int32)
        counts = np.zeros(-(-many // BLOCK) * cells, np.int64)
        stop = np.array([many + 1], np.int32)
        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS):
                parts = [stop]
                for i in batch.column("ids").slice(s, TEXTS):
                    parts += [np.frombuffer(i.as_py(), "<u2"), stop]
                w = np.concatenate(parts)
                c = of[w]
                at = np.flatnonzero(w < many)
                cell = np.concatenate([2 * w[at] * WIDTH + c[at - 1], (2 * w[at] + 1) * WIDTH + c[at + 1]])
                np.add.at(counts, cell, 1)
        (at,) = np.nonzero(counts)
        cuts = np.searchsorted(at, np.arange(0, len(counts) + 1, cells))
        for b in range(len(cuts) - 1):
            if len(mine := at[cuts[b] : cuts[b + 1]]):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([(mine - b * cells).astype("<u2").tobytes()], pa.binary()), pa.array([counts[mine].astype("<i8").tobytes()], pa.binary())], ["block", "cells", "n"])

    def total(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, sums = None, np.zeros(cells, np.int64)

        def out() -> pa.RecordBatch:
            both = sums.reshape(BLOCK, 2, WIDTH)[: many - at * BLOCK]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([np.ascontiguousarray(both[:, k]).tobytes()], pa.binary()) for k in (0, 1))], ["block", "before", "after"])

        for batch in batches:
            for b, x, n in zip(*(batch.column(k) for k in range(3)), strict=True):
                b = b.as_py()
                if b != at:
                    if at is not None:
                        yield out()
                    at = b
                    sums[:] = 0
                sums[np.frombuffer(x.as_py(), "<u2")] += np.frombuffer(n.as_py(), "<i8")
        if at is not None:
            yield out()

    mine = ids.mapInArrow(run, "block int, cells binary, n binary")
    return mine.repartition("block").sortWithinPartitions("block").mapInArrow(total, "block int, before binary, after binary")


def transitions(counts: DataFrame, classes):
    """The class bigram counts; one partial matrix for each block comes to the driver."""
    import numpy as np

    shared = counts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for b, x, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                before, after = (np.frombuffer(v, "<i8").reshape(-1, WIDTH) for v in (x, y))
                m, mine = np.zeros((WIDTH, WIDTH), np.int64), shared.value[b * BLOCK : b * BLOCK + len(before)]
                np.add.at(m.T, mine, before)
                for c in (TAIL, STOP):
                    np.add.at(m[:, c], mine, after[:, c])
                out.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["m"])

    sums = np.zeros((WIDTH, WIDTH), np.int64)
    for r in counts.mapInArrow(run, "m binary").toLocalIterator():
        sums += np.frombuffer(r.m, "<i8").reshape(WIDTH, WIDTH)
    return sums


def likelihood(m) -> float:
    """The part of the class-bigram likelihood that depends on the classes."""
    return float(_h(m).sum() - _h(m.sum(0)).sum() - _h(m.sum(1)).sum())


def _h(x):
    import numpy as np

    return x * np.log(np.maximum(x, 1.0))


def exchanged(counts: DataFrame, classes, m, turn: int, groups: int):
    """The classes after one group of words moved, each to its best class.

    Words of a block move one after another; blocks don't see each other's moves.
    """
    shared = counts.sparkSession.sparkContext.broadcast((classes, m))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        old, sums = shared.value
        for batch in batches:
            words, best = [], []
            for b, x, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                before, after = (np.frombuffer(v, "<i8").reshape(-1, WIDTH).astype(float) for v in (x, y))
                now = sums.astype(float)
                for k in range(len(before)):
                    w = b * BLOCK + k
                    if (w * 2_654_435_761 >> 16) % groups != turn % groups:
                        continue
                    a, l, r = old[w], before[k], after[k]
                    mine = now.copy()
                    mine[:, a] -= l
                    mine[a, :] -= r
                    np.maximum(mine, 0, out=mine)
                    rows, cols = mine.sum(1), mine.sum(0)
                    gain = (_h(mine + l[:, None]) - _h(mine)).sum(0) + (_h(mine + r[None, :]) - _h(mine)).sum(1)
                    gain -= _h(cols + l.sum()) - _h(cols) + _h(rows + r.sum()) - _h(rows)
                    to = int(gain[:CLASSES].argmax())
                    if gain[to] > gain[a] + 1e-9:
                        mine[:, to] += l
                        mine[to, :] += r
                        now = mine
                        words.append(w)
                        best.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(best, pa.int32())], ["word", "class"])

    out = classes.copy()
    for r in counts.mapInArrow(run, "word int, class int").collect():  # the moved part of the head
        out[r["word"]] = r["class"]
    return out


def clustered(texts: DataFrame, head: dict[bytes, int], rounds: int = ROUNDS):
    """Classes of the head words, and the class bigram counts."""
    import numpy as np

    ids = written(coded(texts, head), "brown-ids")
    places = np.arange(len(head))
    classes = np.where(places < CLASSES, places, (places * 2_654_435_761 >> 8) % CLASSES).astype(np.int64)
    best, groups = None, 2
    for turn in range(rounds + 1):
        counts = written(neighbour_counts(ids, classes), "brown-neighbours")
        m = transitions(counts, classes)
        if best is None or likelihood(m) > likelihood(best[1]):
            if best:
                dropped(best[2])
            best = classes, m, counts
        else:  # moves at the same time worked against each other: go back, move fewer
            dropped(counts)
            groups *= 2
        if turn < rounds:
            classes = exchanged(best[2], best[0], best[1], turn, groups)
    dropped(best[2])
    dropped(ids)
    return best[0], best[1]


def placed(texts: DataFrame, head: dict[bytes, int], classes, m) -> DataFrame:
    """(word, n, class) of all other words."""
    import numpy as np

    shared = texts.sparkSession.sparkContext.broadcast((head, classes, m))

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places, of, _ = shared.value
        known = dict(zip(places, of.tolist(), strict=True)) | {END: STOP}
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.binary()), pa.array([c for _, c in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "pair", "n"])
        for batch in slices(batches):
            for _, w, _ in shares(batch.column("text").to_pylist()):
                c = np.concatenate([[STOP], found(known, w, TAIL), [STOP]])
                (at,) = np.nonzero(c[1:-1] == TAIL)
                seen.update(zip((w[k] for k in at.tolist()), (c[at] * WIDTH + c[at + 2]).tolist(), strict=True))
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def decide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        _, _, sums = shared.value
        soft = sums + 0.5
        into = np.log(soft[:, :CLASSES] / soft[:, :CLASSES].sum(0))  # given the class, the one before
        outof = np.log(soft[:CLASSES] / soft[:CLASSES].sum(1, keepdims=True)).T
        into[TAIL] = outof[TAIL] = 0  # a neighbour of the tail says nothing
        held: list = []  # the rows of the last word, which may go on

        def settle(words, pairs, n):
            starts = np.flatnonzero(np.concatenate([[True], [a != b for a, b in zip(words[1:], words[:-1], strict=True)]]))
            fit = np.add.reduceat((into[pairs // WIDTH] + outof[pairs % WIDTH]) * n[:, None], starts)
            best, many = fit.argmax(1), np.add.reduceat(n, starts)
            return pa.RecordBatch.from_arrays([pa.array([words[s] for s in starts], pa.binary()), pa.array(many, pa.int64()), pa.array(best.astype(np.int32))], ["word", "n", "class"])

        for batch in batches:
            rows = held + list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            cut = len(rows) - 1
            while cut and rows[cut - 1][0] == rows[-1][0]:
                cut -= 1
            held = rows[cut:]
            if cut:
                w, p, n = zip(*rows[:cut], strict=True)
                yield settle(w, np.array(p), np.array(n))
        if held:
            w, p, n = zip(*held, strict=True)
            yield settle(w, np.array(p), np.array(n))

    rows = texts.mapInArrow(gather, "word binary, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n")).select("word", "pair", "n")
    return written(rows.repartition("word").sortWithinPartitions("word").mapInArrow(decide, "word binary, n long, class int"), "brown-placed")


def followed(texts: DataFrame, vocabulary: DataFrame):
    """Counts of each word's class by its context, the class of the last common word before it, over all tokens."""
    import numpy as np

    shared = texts.sparkSession.sparkContext.broadcast({bytes(r.word): r["class"] for r in top_words(vocabulary, COMMON)} | {END: STOP})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = shared.value
        sums, rare = np.zeros(WIDTH * WIDTH, np.int64), Counter()
        kinds = pa.binary(), pa.int32(), pa.int64()
        batch_of = lambda *c: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["word", "pair", "n"])
        out = lambda: batch_of([w for w, _ in rare], [c * WIDTH for _, c in rare], list(rare.values()))
        for batch in slices(batches):
            for _, w, _ in shares(batch.column("text").to_pylist()):
                c = found(of, w, -1)
                context = last_before(c, c >= 0)
                sums += np.bincount((context * WIDTH + c)[c >= 0], minlength=WIDTH * WIDTH)
                (at,) = np.nonzero(c < 0)
                rare.update(zip((w[k] for k in at.tolist()), context[at].tolist(), strict=True))
                if len(rare) > HELD:
                    yield out()
                    rare.clear()
        if rare:
            yield out()
        (at,) = np.nonzero(sums)
        yield batch_of([None] * len(at), at.astype(np.int32), sums[at])

    rows = written(texts.mapInArrow(run, "word binary, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n")), "brown-followed")
    rare = rows.where("word is not null").join(vocabulary.select("word", "class"), "word").select((F.col("pair") + F.col("class")).alias("pair"), "n")
    m = np.zeros((WIDTH, WIDTH), np.int64)
    for r in rows.where("word is null").select("pair", "n").unionByName(rare).groupBy("pair").agg(F.sum("n").alias("n")).collect():  # WIDTH ** 2 rows at most
        m[divmod(r.pair, WIDTH)] = r.n
    dropped(rows)
    return m


class Model:
    """What scoring needs besides the words: bounded by the number of classes."""

    def __init__(self, m, stats: dict[int, tuple[int, int]], total: int, distinct: int, once: int, twice: int) -> None:
        import numpy as np

        self.total, self.distinct = total, distinct
        self.discount = once / (once + 2 * twice) if once else 0.5
        keep = [*range(CLASSES), STOP]
        self.size, self.kinds = np.zeros(WIDTH), np.zeros(WIDTH)
        for c, (n, v) in stats.items():
            self.size[c], self.kinds[c] = n, v
        counts = np.zeros((WIDTH, WIDTH))
        counts[np.ix_(keep, keep)] = m[np.ix_(keep, keep)]
        prior = self.size / max(1.0, self.size.sum())
        self.step = (counts + MU * prior) / (counts.sum(1, keepdims=True) + MU)
        # the end's class has one word and no unknown ones
        self.unknown = np.where(self.size > 0, self.discount * self.kinds / np.maximum(self.size, 1), 0.0)
        self.unknown[STOP] = 0.0
        self.unseen = self.step @ self.unknown

    def base(self, n):
        return (n + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def emission(self, n, c):
        import numpy as np

        return np.where(c == STOP, 1.0, (n - self.discount) / np.maximum(self.size[c], 1))


def training(id_col: str, parts: int = 10) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts != 0


def trained(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model and its vocabulary (word, n, class), written to the shared folder."""
    spark = texts.sparkSession
    texts = texts.select("text")
    counts = written(word_counts(texts), "brown-words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    top = top_words(counts, HEAD)
    head = {bytes(r.word): k for k, r in enumerate(top)}
    classes, m = clustered(texts, head)
    rest = placed(texts, head, classes, m)
    ends = counts.where(F.col("word") == F.lit(b"")).select("word", "n", F.lit(STOP).alias("class"))
    mine = spark.createDataFrame([(r.word, r.n, int(classes[k])) for k, r in enumerate(top)], "word binary, n long, class int")
    vocabulary = written(rest.unionByName(mine).unionByName(ends), "brown-vocabulary")
    stats = {r["class"]: (r.n, r.v) for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    return Model(followed(texts, vocabulary), stats, sums.n, sums.v, sums.once, sums.twice), vocabulary


def scored(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score and score (log10 probabilities) of every document."""
    spark = docs.sparkSession
    common = top_words(vocabulary, COMMON)
    stop = vocabulary.where(F.col("word") == F.lit(b"")).select("n").first()
    # plain arrays: broadcasts are pickled by reference, and executors may lack this package
    import numpy as np

    ends = stop.n if stop else 0
    n, c = np.array([*(r.n for r in common), 0, ends], float), np.array([*(r["class"] for r in common), TAIL, STOP], np.int64)
    shared = spark.sparkContext.broadcast(({bytes(r.word): k for k, r in enumerate(common)} | {END: len(common) + 1}, c, model.base(n), model.emission(n, c), model.step, ends))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        places, c, raw, fits, step, ends = shared.value
        other = len(c) - 2
        base = np.log10(raw)
        row = TaskContext.get().partitionId() << 40
        names = ["id", "row", "word", "context", "many", "n_tokens", "n_known", "base_score", "score"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in slices(batches):
            for first, words, many in shares(batch.column("text").to_pylist()):
                ids, rows = batch.column("id").slice(first, len(many)), row + np.arange(len(many))
                row += len(many)
                doc = np.repeat(np.arange(len(many)), many)
                at = found(places, words, other)
                context = last_before(c[at], at != other)
                (known,) = np.nonzero(at != other)
                of = at[known]
                p = (1 - MIX) * step[context[known], c[of]] * fits[of] + MIX * raw[of] if ends else raw[of]  # without ends nothing was learnt
                sums = [np.bincount(doc[known], x, len(many)) for x in (base[of], np.log10(p))]
                n_known = np.bincount(doc[known], minlength=len(many)) if ends else np.zeros(len(many), np.int64)
                whole = [pa.array(rows), *(pa.nulls(len(many), k) for k in kinds[1:4]), pa.array(np.array(many, np.int64)), pa.array(n_known), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays([ids, *whole], names)
                (at,) = np.nonzero(at == other)
                if len(at):
                    rare = Counter(zip(doc[at].tolist(), (words[k] for k in at.tolist()), context[at].tolist(), strict=True))
                    d, w, k = zip(*rare, strict=True)
                    mine = np.array(d, np.int64)
                    cells = [pa.array(rows[mine]), pa.array(w, pa.binary()), pa.array(k, pa.int32()), pa.array(list(rare.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), *cells, *(pa.nulls(len(mine), k) for k in kinds[4:])], names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = f"id {kind}, row long, word binary, context int, many long, n_tokens long, n_known long, base_score double, score double"
    parts = written(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, names), "brown-scores")
    # rare words: their class and count by a join with the whole vocabulary
    steps = spark.createDataFrame([(a, b, float(model.step[a, b])) for a in range(WIDTH) for b in range(WIDTH)], "context int, class int, step double")
    sizes = spark.createDataFrame([(c, float(model.size[c])) for c in range(WIDTH)], "class int, size double")
    unseen = spark.createDataFrame([(c, float(model.unseen[c])) for c in range(WIDTH)], "context int, unseen double")
    rare = parts.where("word is not null").select("id", "row", "word", "context", "many").join(vocabulary, "word", "left")
    rare = rare.join(F.broadcast(steps), ["context", "class"], "left").join(F.broadcast(sizes), "class", "left").join(F.broadcast(unseen), "context", "left")
    base = (F.coalesce("n", F.lit(0)) + 0.1) / F.lit(model.total + 0.1 * (model.distinct + 1))
    fit = F.coalesce(F.col("step") * (F.col("n") - model.discount) / F.col("size"), F.col("unseen"))
    learnt = F.lit(model.total > 0)
    p = F.when(learnt, (1 - MIX) * fit + MIX * base).otherwise(base)
    extra = rare.groupBy("id", "row").agg(
        F.lit(0).cast("long").alias("n_tokens"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("many")).otherwise(0)).alias("n_known"),
        F.sum(F.col("many") * F.log10(base)).alias("base_score"),
        F.sum(F.col("many") * F.log10(p)).alias("score"),
    )
    whole = parts.where("word is null").select("id", "row", "n_tokens", "n_known", "base_score", "score").unionByName(extra)
    out = whole.groupBy("id", "row").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return out.drop("row").withColumnRenamed("id", id_col)
