"""Periodic runs in texts, by matching aligned blocks.

A run is a longest stretch of words that repeats with smallest period q: words q
apart are equal, and it is at least `least` words and two periods long. The
words i for which i and i + q both lie in it are then max(q, least - q) in a row
at least, so they hold a whole aligned block of B words, B being the largest
power of two with 2 B - 1 of them. At each scale B the aligned blocks become
the integer-sequence keys of one Aho-Corasick automaton (a block's numbers are
the names of its halves, found at the scale before), which is searched across
the document; an occurrence whose distance belongs to the scale seeds an exact
extension to both sides. A block is a key only if both of its halves occur
elsewhere, so ordinary text drops out after the first scales.

A seed that lies in a known run whose period divides its distance is skipped:
its extension stays inside that run. So a document that repeats one word costs
what its length does, not the square.

A document is one row; nothing is shuffled. Work and memory in a task follow
the longest text, by its length times the logarithm of its longest period.

Defined results: null and empty texts, and texts without words, have no run and
an empty collapsed text; repeated rows and null ids give a row each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import words

LEAST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def scale_of(period: int, least: int = LEAST) -> int:
    """The block length for a period: the largest power of two B with 2 B - 1 <= max(period, least - period)."""
    return 1 << (((max(period, least - period) + 1) // 2).bit_length() - 1)


def distances(scale: int, least: int = LEAST) -> list[tuple[int, int]]:
    """The periods that belong to a scale, as ranges: those short against `least`, and the others."""
    short = max(1, least - 4 * scale + 2), min((least - 1) // 2, least - 2 * scale + 1)
    others = max((least + 1) // 2, 2 * scale - 1), 4 * scale - 2
    return [(low, high) for low, high in (short, others) if low <= high]


class Runs:
    """The runs of one document: `code` holds a number for each word, equal for equal words."""

    def __init__(self, code, least: int = LEAST):
        import numpy as np

        self.code, self.n, self.least = code, len(code), least
        self.found: list[tuple[int, int, int]] = []
        # of each word: the end and the period of the known run that covers it and reaches furthest
        self.reach, self.by = np.zeros(self.n, np.int64), np.ones(self.n, np.int64)

    def search(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        import numpy as np

        if self.n < self.least:
            return []
        often = np.bincount(self.code) > 1
        half, names = 1, np.where(often[self.code], self.code, -1)
        alive = names >= 0  # of each aligned block: whether it occurs elsewhere
        while True:
            alive = alive[: len(alive) // 2 * 2]
            alive = alive[0::2] & alive[1::2]
            scale = 2 * half
            if 2 * scale - 1 > self.n or not alive.any():
                break
            starts = np.flatnonzero(alive) * scale
            names = self.matched(names, half, starts)
            for low, high in distances(scale, self.least):
                self.seeded(names, scale, low, high)
            alive[alive] = np.bincount(names[names >= 0])[names[starts]] > 1
            half = scale
        return sorted((s, e - s, q) for s, e, q in self.found)

    def matched(self, names, half: int, starts):
        """For each place the number of the aligned block of two halves that occurs there, or -1.

        names: the same for the halves. A block's key is its halves' names, so keys
        stay two numbers long; the document is read at steps of `half`, once for
        each first place below it, with a 0 between.
        """
        import ahocorasick
        import numpy as np

        rows = -(-self.n // half)
        grid = np.zeros(rows * half, np.int64)
        grid[: self.n] = names + 1
        grid = np.concatenate([grid.reshape(rows, half).T, np.zeros((half, 1), np.int64)], axis=1).ravel()
        said = grid > 0
        said[1:] |= grid[:-1] > 0
        kept = np.flatnonzero(said)  # one 0 stands for many
        keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for at, first, second in zip(starts.tolist(), (names[starts] + 1).tolist(), (names[starts + half] + 1).tolist(), strict=True):
            keys.add_word((first, second), at // (2 * half))
        keys.make_automaton()
        hits = np.array(list(keys.iter(tuple(grid[kept].tolist()))), np.int64).reshape(-1, 2)
        first, step = np.divmod(kept[hits[:, 0]], rows + 1)
        occurs = np.full(self.n, -1, np.int64)
        occurs[first + (step - 1) * half] = hits[:, 1]
        return occurs

    def seeded(self, occurs, scale: int, low: int, high: int) -> None:
        """Extend where an aligned block p occurs again at p + q, low <= q <= high."""
        import numpy as np

        code, n = self.code, self.n
        there = np.flatnonzero(occurs >= 0)
        pairs = []
        for t in range((high - low) // scale + 1):
            p = ((there - low) // scale - t) * scale
            ok = (p >= 0) & (there - p <= high)
            p, i = p[ok], there[ok]
            same = occurs[p] == occurs[i]
            pairs.append((p[same], i[same] - p[same]))
        p, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
        known = (self.reach[p] >= p + q + scale) & (q % self.by[p] == 0)
        after = p + q + scale
        # a run's stretch is longer than the block, so a neighbour matches too
        longer = (p > 0) & (code[p - 1] == code[p + q - 1]) | (after < n) & (code[p + scale] == code[np.minimum(after, n - 1)])
        keep = ~known & longer
        p, q = p[keep], q[keep]
        order = np.lexsort((p, q))
        done, of = -1, -1
        for p, q in zip(p[order].tolist(), q[order].tolist(), strict=True):
            if q != of:
                done, of = -1, q
            if p < done or self.reach[p] >= p + q + scale and q % self.by[p] == 0:
                continue
            begin, done = self.extended(p, q)
            if done - begin >= max(q, self.least - q) and self.smallest(begin, done + q, q):
                end = done + q
                self.found.append((begin, end, q))
                less = np.flatnonzero(self.reach[begin:end] < end) + begin
                self.reach[less], self.by[less] = end, q

    def extended(self, p: int, q: int) -> tuple[int, int]:
        """The longest stretch around p whose words equal those q later."""
        code, n = self.code, self.n
        end, step = p, 32
        while (m := min(step, n - q - end)) > 0:
            differ = code[end : end + m] != code[end + q : end + q + m]
            k = int(differ.argmax())
            if differ[k]:
                end += k
                break
            end, step = end + m, step * 2
        begin, step = p, 32
        while (m := min(step, begin)) > 0:
            differ = (code[begin - m : begin] != code[begin - m + q : begin + q])[::-1]
            k = int(differ.argmax())
            if differ[k]:
                begin -= k
                break
            begin, step = begin - m, step * 2
        return begin, end

    def smallest(self, begin: int, end: int, q: int) -> bool:
        """Whether no smaller period holds; one would divide q, as the stretch is two periods long."""
        rest, f = q, 2
        while rest > 1:
            f = rest if f * f > rest else f
            if rest % f:
                f += 1
                continue
            d = q // f
            if bool((self.code[begin : end - d] == self.code[begin + d : end]).all()):
                return False
            while rest % f == 0:
                rest //= f
        return True


def collapsed_words(found: list[tuple[int, int, int]], tokens: list[bytes]) -> list[bytes]:
    """The words less those that a run contains after its first period."""
    if not found:
        return tokens
    import numpy as np

    step = np.zeros(len(tokens) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return [tokens[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def _detect(least: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        place = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            runs, texts = [], []
            for text in batch.column("text").to_pylist():
                tokens = text.split() if text else []  # of bytes: at \x20 and \x09 to \x0D only
                numbers: dict[bytes, int] = {}
                code = np.array([numbers.setdefault(w, len(numbers)) for w in tokens], np.int64)
                found = Runs(code, least).search() if len(numbers) < len(tokens) else []
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed_words(found, tokens)))
            columns = [batch.column("id"), pa.array(runs, place), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "runs", "collapsed"])

    return run


def detected(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each document: its id, its runs by start and period, and the text with each run cut to its first period.

    least: the fewest words of a run, 5 or more.
    """
    if least < 5:
        raise ValueError("a run has 5 words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(_detect(least), f"id {kind}, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (id, text) with periods put into one text in ten, as the query asks.

    h is the CRC-32 of the id's decimals; where h % 10 = 0, the words from
    a = (h // 10) % n on repeat the p = 1 + (n - a) // (3 + (h // 10) % 8) words from there.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    split = docs.select(id_col, text, F.floor(h / 10).alias("__g"), F.when(h % 10 == 0, words(F.col(text))).alias("__w"))
    sized = split.withColumn("__n", F.size("__w"))
    placed = sized.withColumn("__a", F.when(F.col("__n") > 0, (F.col("__g") % F.col("__n")).cast("int")))
    placed = placed.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    rest: Column = F.col("__n") - F.col("__a")
    again = F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(rest / F.col("__p")).cast("int")))
    whole = F.concat(F.slice("__w", F.lit(1), F.col("__a")), F.slice(again, F.lit(1), rest))
    return placed.select(id_col, F.when(F.col("__a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col(text)).alias(text))
