import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rulegrain.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())
THEIRS = Tokenizer.from_file(PATH)


def check(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    mine = CODEC.encode(text)
    assert np.frombuffer(mine, "<u4").tolist() == ids
    assert CODEC.decode(mine) == THEIRS.decode(ids, skip_special_tokens=False) == text


def test_hard_texts():
    for t in ["", " ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|", "it's  we'll\n\n x", "\x1c\x1d \x85\xa0 a", "日本語 текст é́ ½ ²", "a" * 5000, "\U0001f600" * 30, "\x00\x7f�"]:
        check(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn")), max_size=60))
def test_random_texts(text):
    check(text)


def test_query_matches_the_library(spark):
    rows = {r.doc_id: r for r in queries.op5_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = THEIRS.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "hi", 6)], "doc_id long, text string, ids int")
    out = bpe.decoded(bpe.encoded(df, PATH), PATH).orderBy("text").collect()
    assert [(r.n_tokens, r.decoded) for r in out] == [(0, ""), (1, "hi")]
    assert bpe.encoded(df.limit(0), PATH).count() == 0
