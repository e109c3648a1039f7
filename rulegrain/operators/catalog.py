"""The rule catalogue: overrides, disabled engines, engine sets, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overridden(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective rules: an override's severity and tags replace the defaults; an empty list of
    tags counts, null doesn't. Names match exactly; overrides without a rule are ignored."""
    own = overrides.select("engine", "rule", F.col("severity").alias("__severity"), F.col("tags").alias("__tags"))
    joined = rules.join(own, ["engine", "rule"], "left")
    return joined.withColumns({"severity": F.coalesce("__severity", "severity"), "tags": F.coalesce("__tags", "tags")}).select(rules.columns)


def enabled(rules: DataFrame, disabled: DataFrame) -> DataFrame:
    """rules less those of engines in `disabled` (engine)."""
    return rules.join(disabled.select("engine").distinct(), "engine", "left_anti").select(rules.columns)


def disabled_engines(engines: DataFrame, active: DataFrame) -> DataFrame:
    """Engines that the plug-ins offer and that aren't active."""
    return engines.join(active.select("engine").distinct(), "engine", "left_anti").select(engines.columns)


def relevant_engines(*parts: DataFrame) -> DataFrame:
    """The distinct engines of several rule or engine tables, in order of the first table that has them."""
    out = None
    for k, part in enumerate(parts):
        mine = part.select("engine", F.lit(k).alias("ord"))
        out = mine if out is None else out.unionByName(mine)
    return out.groupBy("engine").agg(F.min("ord").alias("ord"))


def ordered(rules: DataFrame) -> DataFrame:
    """By engine, in the engines' order, then by rule name."""
    return rules.orderBy("engine_ord", "engine", "rule")


def per_engine(rules: DataFrame) -> DataFrame:
    return rules.groupBy("engine").agg(F.count("*").alias("n_rules"))


def totals(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("n_rules"), F.count_distinct("engine").alias("n_engines"))


def selected_for(engines: DataFrame, rules: DataFrame) -> DataFrame:
    """Engines with a selected rule: the others aren't run."""
    return engines.join(rules.select("engine").distinct(), "engine", "left_semi").select(engines.columns)
