"""Rule selectors as Column predicates.

A list of selectors is a union; `a:b:c` is an intersection of tokens. A token is
`all`, or names an engine, a rule, a tag or a severity (number or name), in any
case. A list matches by one predicate, so a rule appears once and Catalyst sees
an ordinary filter. No match is an empty result, not an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.schema import DEFAULT_TAG, SEVERITIES


def flat(selectors: str | Iterable[str]) -> list[str]:
    """Repeated and comma-separated values, in order; blanks don't count."""
    given = [selectors] if isinstance(selectors, str) else list(selectors)
    return [part.strip() for s in given for part in s.split(",") if part.strip()]


def token(text: str) -> Column:
    low = text.strip().lower()
    if low == "all":
        return F.lit(True)
    hit = (F.lower("engine") == low) | (F.lower("rule") == low) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t) == low)
    levels = [n for n, name in SEVERITIES.items() if low in (str(n), name.lower())]
    return hit | F.col("severity").isin(levels) if levels else hit


def predicate(selectors: str | Iterable[str] = DEFAULT_TAG) -> Column:
    # an intersection of no tokens, such as `:`, names nothing
    tokens = [[token(t) for t in s.split(":") if t.strip()] for s in flat(selectors)]
    alternatives = [reduce(lambda a, b: a & b, ts) for ts in tokens if ts]
    return F.coalesce(reduce(lambda a, b: a | b, alternatives, F.lit(False)), F.lit(False))


def select(rules: DataFrame, selectors: str | Iterable[str] = DEFAULT_TAG) -> DataFrame:
    return rules.where(predicate(selectors))
