"""Rules from a table, of any number: a trigram index narrows the files for each rule.

A rule's required literals become trigrams of lower-case UTF-8 bytes; a file
can match only if some alternative's trigrams all occur in it. One pass counts in how
many files each wanted trigram occurs, and each alternative keeps its RAREST; a
second pass makes the posting lists (trigram, file) of those, which meet the
rules by an equi-join. Only the pairs of file and rule that remain see a regular
expression. What is wanted travels as a bitmap of all trigrams, 2 MB whatever the
number of rules.

A rule without a literal of three bytes has every file for a candidate, by a
posting that every file has: there is nothing to narrow it by.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.sources.engines import as_violations, places
from rulegrain.sources.factors import required

RAREST = 3
#: Larger than any trigram: the posting of every file.
EVERY = 1 << 24


def grams(text: str):
    """The distinct trigrams of a text."""
    import numpy as np

    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


def _of_rules(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = []
        for key, pattern in zip(batch.column("key").to_pylist(), batch.column("pattern").to_pylist(), strict=True):
            for k, text in enumerate(required(pattern or "") or [""]):
                mine = grams(text).tolist() or [EVERY]
                rows += [(key, k, g) for g in mine]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "alternative", "gram"])


def _wanted(df: DataFrame) -> bytes:
    """The trigrams of a column `gram` as a bitmap."""
    import numpy as np

    bits = np.zeros(EVERY + 8, bool)
    bits[[r.gram for r in df.select("gram").distinct().toLocalIterator()]] = True
    return np.packbits(bits).tobytes()


def _grams_of_files(bitmap: bytes, counted: bool):
    """(gram, n) of a task's files, or (gram, file)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        wanted = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
        for batch in batches:
            each = (np.append(grams(c.as_py() or ""), EVERY) for c in batch.column("content"))  # one content at a time
            each = [g[wanted[g]] for g in each]
            flat = np.concatenate(each).astype(np.int32) if each else np.zeros(0, np.int32)
            if counted:
                gram, n = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(n, pa.int64())], ["gram", "n"])
            else:
                at = np.repeat(np.arange(len(each)), [len(g) for g in each])
                yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int32()), batch.column("file").take(pa.array(at))], ["gram", "file"])

    return run


def rarest(rules: DataFrame, files: DataFrame, n: int = RAREST) -> DataFrame:
    """(key, alternative, gram, need): of each alternative the trigrams in the fewest files, and how many those are.

    rules: key and pattern.
    """
    mine = rules.select("key", "pattern").mapInArrow(_of_rules, "key bigint, alternative int, gram int").persist()  # rules, not files: read for the bitmap and for the join
    counts = files.select("content").mapInArrow(_grams_of_files(_wanted(mine), True), "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("key", "alternative")
    known = mine.join(counts, "gram", "left").withColumn("nth", F.row_number().over(by.orderBy(F.coalesce("n", F.lit(0)), "gram")))
    return known.where(F.col("nth") <= n).withColumn("need", F.count("*").over(by)).select("key", "alternative", "gram", "need")


def candidates(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(key, file): the files that may match each rule (key, pattern)."""
    chosen = rarest(rules, files).persist()
    postings = files.select("file", "content").mapInArrow(_grams_of_files(_wanted(chosen), False), "gram int, file string")
    hits = postings.join(chosen, "gram").groupBy("key", "alternative", "file").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return hits.where(F.col("n") == F.col("need")).select("key", "file").distinct()


def matched(rules: DataFrame, files: DataFrame) -> DataFrame:
    """Violations, without violation_ord, of rules (engine, rule, pattern, message; extensions, where there is such a column) in files (file, ext, content).

    Every match of a line counts. Rows of one engine and rule are one rule each. Null
    patterns match nothing; files have distinct names.
    """
    keyed = rules.where("pattern is not null").withColumn("key", F.xxhash64("engine", "rule", "pattern"))
    extensions = F.col("extensions") if "extensions" in rules.columns else F.lit(None).cast("array<string>")
    keyed = keyed.select("key", "engine", "rule", "pattern", "message", extensions.alias("extensions")).dropDuplicates(["key"])
    pairs = candidates(keyed, files).join(keyed, "key").join(files.select("file", "ext", "content"), "file")
    anywhere = F.coalesce(F.size("extensions"), F.lit(0)) <= 0
    pairs = pairs.where(anywhere | F.array_contains("extensions", F.col("ext")))
    lines = pairs.select("engine", "rule", "message", "pattern", "file", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return as_violations(places(lines, F.col("pattern"), F.lit(True)), F.col("engine"), F.col("rule"), F.coalesce("message", "rule"))
