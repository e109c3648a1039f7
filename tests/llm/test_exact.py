import hashlib
import re

from pyspark.sql import functions as F

from rulegrain.llm import exact, queries

WS = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault(WS.sub(" ", t or ""), []).append(i)
    return sorted((i, min(g), len(g), i == min(g)) for g in by.values() for i in g)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, "x" * 100_000), (8, "x" * 100_000), (4, "A b"), (5, "a  b")]


def got(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_small_cases(spark):
    df = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "doc_id long, text string, h int, norm string")
    assert got(exact.exact_groups(df)) == brute(ROWS)


def test_colliding_keys_are_chained(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    same = lambda norm: F.length(norm).cast("long") * 0 + 7
    assert got(exact.exact_groups(df, key=same)) == brute(ROWS)
    assert got(exact.exact_groups(df, key=lambda n: F.length(n).cast("long") - 3, capacity=1)) == brute(ROWS)


def test_directory_doubles_only_where_buckets_are_overfull():
    assert exact.build_directory({0: 5, 1: 5, 2: 1, 3: 0}, 2, 6) == [0, 1, 2, 2]
    assert exact.build_directory({}, 3, 10) == [0]
    assert len(exact.build_directory({i: 10 for i in range(16)}, 4, 10)) == 16


def test_empty_table(spark):
    assert exact.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got(queries.op8_exact_dedup(spark, "/root/testdata/sf0.001")) == brute([(d.doc_id, d.text) for d in docs])


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (7, "b"), (3, "b")], "doc_id long, text string")
    got = sorted((r.text_sha256, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect())
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in "ab"}
    assert got == sorted([(sha["a"], 0, None, 2, True)] * 2 + [(sha["b"], 0, 3, 3, False), (sha["b"], 3, 3, 3, True), (sha["b"], 7, 3, 3, False)], key=lambda r: r[:2])


def test_ids_of_other_types(spark):
    rows = [("b", "x y"), ("a", "x  y"), (None, "z"), ("c", None)]
    for kind, ids in (("string", {}), ("int", {"a": 1, "b": 2, "c": 3})):
        df = spark.createDataFrame([(ids.get(i, i), t) for i, t in rows], f"doc_id {kind}, text string")
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect()}
        a, b, c = (ids.get(i, i) for i in "abc")
        assert got == {a: (a, 2, True), b: (a, 2, False), None: (None, 1, True), c: (c, 1, True)}


def test_buckets_split_by_bytes(spark):
    df = spark.createDataFrame([(i, f"{i} " * 200) for i in range(400)], "doc_id long, text string")
    norm = exact.normalised(F.col("text"))
    keys = df.select(F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256"), F.octet_length(norm).cast("long").alias("size"))
    directory = exact.directory_of(keys, 20_000)
    held = keys.withColumn("slot", exact.slot_of(F.col("h"), exact.depth_of(directory))).join(exact.stored_directory(directory, keys), "slot")
    sizes = [r.n for r in held.groupBy("bucket").agg(F.sum(F.col("size") + exact.ROW_BYTES).alias("n")).collect()]
    assert len(sizes) > 16 and max(sizes) <= 20_000
    assert exact.exact_groups(df, capacity=20_000).where("kept").count() == 400
