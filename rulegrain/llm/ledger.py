"""Quality rules as a ledger of bits (native Spark).

Every rule is evaluated once for each document; the ledger keeps one bit for
each failed rule beside the measurements. A policy is a versioned mask: which
bits reject. Changing a policy, or asking what a rule costs (its ablation),
reads the ledger only and never the texts again.

Defined results: a null text has no words and every measurement is 0; repeated
rows are measured each on its own; an empty table gives an empty ledger; extra
columns pass through, and one named like a ledger column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import WHITE, unused, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")


@dataclass(frozen=True)
class Rule:
    """failed: a SQL condition over the measurements that is true for bad documents."""

    name: str
    bit: int
    failed: str


#: Bits are never reused: a ledger written under an older list stays readable.
RULES = (
    Rule("too_few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols_per_word", 2, "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", 3, "n_dup_lines >= 10"),
    Rule("mean_word_length", 4, "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("shouting", 5, "2 * n_upper > word_chars"),
)
#: Versioned policies: the rules whose bits reject a document.
POLICIES = {
    "v1": ("too_few_words", "repeated_windows"),
    "v2": ("too_few_words", "repeated_windows", "symbols_per_word", "mean_word_length", "shouting"),
}
BASE_POLICY, POLICY = "v1", "v2"


def mask_of(policy: str) -> int:
    return reduce(or_, (1 << r.bit for r in RULES if r.name in POLICIES[policy]), 0)


def _once(value: Column, use) -> Column:
    """use(value) with value computed once: lambdas would compute it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Window hashes are sorted as plain longs, which shows the repeated ones. With
    few of them the windows are looked up in that list; with many, (hash, place)
    pairs are sorted, so equal windows are neighbours. Every place then adds the
    words up to the next place, 3 at most.
    """
    few = 64

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")))["n"]

    def sorted_places(h: Column) -> Column:
        same = lambda g, i, j: F.get(g, i)["h"].eqNullSafe(F.get(g, j)["h"])
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _once(pairs, lambda g: F.array_sort(F.transform(F.filter(g, lambda x, k: same(g, k, k + 1) | ((k > 0) & same(g, k, F.greatest(k - 1, F.lit(0))))), lambda x: x["i"])))

    def places(h: Column, repeated: Column) -> Column:
        found = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull())
        return F.when(F.size(repeated) <= few, found).otherwise(sorted_places(h))

    def windows(v: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
        twice = lambda h: _once(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
        repeats = lambda h: _once(twice(h), lambda r: F.when(F.size(r) == 0, F.lit(0)).otherwise(covered(places(h, r))))
        return _once(hashes, repeats)

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(windows(w))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements; no shuffle, one pass over the texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
    counts = _once(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeats")))
    held, split = unused(docs.columns, "counts_", "lines_")
    out = docs.withColumns({held: counts, split: lines})
    return out.withColumns({
        "n_words": F.col(f"{held}.n").cast("long"),
        "word_chars": F.length(F.regexp_replace(body, WHITE, "")).cast("long"),
        "n_symbols": without(r"[#*$%&|<>]").cast("long"),
        "n_dup_lines": (F.size(split) - F.size(F.array_distinct(split))).cast("long"),
        "n_repeat_words": F.col(f"{held}.repeats").cast("long"),
        "n_upper": without("[A-Z]+").cast("long"),
    }).drop(held, split)


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    return reduce(lambda a, r: a.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")), rules, F.lit(0).cast("long"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `fail_bits` (long): every rule, evaluated once."""
    return measured(docs, text).withColumn("fail_bits", fail_bits())


def judged(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """Apply a versioned policy to a ledger: base_failed, kept, policy."""
    hit = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask_of(p)).cast("long")) != 0
    return entries.withColumns({"base_failed": hit(BASE_POLICY), "kept": ~hit(BASE_POLICY) & ~hit(policy), "policy": F.lit(policy)})


def ablation(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """What each rule of a policy does, from one aggregation over the distinct masks.

    Per rule: documents it fails, documents that only it rejects (kept if the
    rule were dropped), and the bits that ever fail together with it.
    """
    mask = mask_of(policy)
    masks = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    mine = [r for r in RULES if r.name in POLICIES[policy]]
    per = masks.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in mine])).alias("r"))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return per.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.coalesce(F.bit_or(F.when(has, F.col("bits"))), F.lit(0).cast("long")).alias("together_bits"),
    )
