import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rulegrain.llm import raking
from tests.llm import test_ledger, test_partenum

SF = "/root/testdata/sf0.001"


def keeps(text):
    n, chars, symbols, _, repeats = test_ledger.brute(text)
    upper = sum("A" <= c <= "Z" for c in text or "")
    return not (n < 50 or 100 * repeats > 50 * n or 10 * symbols > 3 * n or chars < 2 * n or chars > 15 * n or 2 * upper > chars)


def test_run_matches_brute_force(spark):
    docs = [d for d in spark.read.parquet(f"{SF}/documents.parquet").collect() if keeps(d.text)]
    first = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d.text), d.doc_id)
    docs = [d for d in docs if d.doc_id in set(first.values())]
    near = {i for i, _, c in test_partenum.brute([(d.doc_id, d.text) for d in docs], 5, 8, 10) if i == c}
    docs = [d for d in docs if d.doc_id in near]
    # raking with plain loops
    def topic(t):
        for name, strings, pattern in raking.TOPICS:
            if (not strings or any(s in t for s in strings)) and (not pattern or re.search(pattern, t)):
                return name
        return raking.REST
    keys = {d.doc_id: (d.source, d.lang, topic(d.text)) for d in docs}
    tokens = Counter()
    for d in docs:
        tokens[keys[d.doc_id]] += len(d.text.encode().split())
    everything = sum(tokens.values())
    room = {c: n / (raking.BUDGET * everything) for c, n in tokens.items()}
    share = []
    for k in range(3):
        s, most = Counter(), Counter()
        for cell, n in tokens.items():
            s[cell[k]] += n
            most[cell[k]] += room[cell]
        s = {v: n**raking.ALPHA for v, n in s.items()}
        full = set()
        while True:  # values that have less than their share of what is left get all they have
            rest = (1 - sum(most[v] for v in full)) / sum(x for v, x in s.items() if v not in full)
            more = {v for v in s if v not in full and most[v] <= s[v] * rest}
            if not more:
                break
            full |= more
        share.append({v: most[v] if v in full else x * rest for v, x in s.items()})
    w = {c: n / everything for c, n in tokens.items()}
    sums = lambda k: {v: sum(x for c, x in w.items() if c[k] == v) for v in share[k]}
    while True:
        for _ in range(raking.PASSES):
            for k in range(3):
                total = sums(k)
                w = {c: min(room[c], x * share[k][c[k]] / total[c[k]]) for c, x in w.items()}
        if max(abs(n - share[k][v]) for k in range(3) for v, n in sums(k).items()) < raking.TOLERANCE:
            break
    u = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    want = [d for d in docs if u(d.doc_id) < min(1, w[keys[d.doc_id]] / room[keys[d.doc_id]])]
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d.doc_id: theirs.encode(d.text, add_special_tokens=False).ids for d in want}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == ids and len(got) > 20


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name
