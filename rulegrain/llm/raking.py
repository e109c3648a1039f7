"""Mixing sources to target weights by iterative proportional fitting (native Spark).

Tokens are counted for each cell (source, language, topic). The cells' weights
are raked: each pass scales them so that the sums by source, then by language,
then by topic equal the targets, and holds every weight at what its cell has at most
(all its tokens), so weight that a full cell can't take goes to the others of
its source, language and topic. Passes go on until every sum is within
TOLERANCE of its target. A document is kept with its cell's calibrated
probability, by a hash of its id, so a rerun keeps the same documents.

Targets are a table (dimension, value, share); by default each dimension is
tempered: shares follow tokens ** alpha. A value that has less than its share of
the budget gets all it has, and the others of its dimension share the rest in
their proportions. Passes run on the cells alone, whose number does not grow
with the documents; sums use windows over the cells. Targets that no weights
within the cells' bounds meet together end after MOST_PASSES, with the last
sums by topic; `achieved` tells what came of each target.

Defined results: a null text has no tokens; null source or language is a value
of its own; values without a target get none of the weight and are not kept;
targets of values without tokens count for nothing; without any tokens all is kept;
a document without tokens is kept with its cell's probability; repeated rows
share their id's decision; an empty table gives no rows; extra columns pass
through, and those named like the added columns are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.llm.common import WHITE, unused, written

#: Topics by what a text holds, tried in order; the last is the rest: (name, strings of
#: which it holds one, pattern it must match too). Plain string search comes first because
#: it is many times cheaper than a pattern over every text.
TOPICS = (
    ("legal", ("icense", "icence", "opyright", "ICENSE", "ICENCE", "OPYRIGHT"), None),
    ("contact", ("@",), r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("tabular", (" | ",), None),
    ("numeric", (), r"[0-9]{3}"),
)
REST = "prose"
DIMENSIONS = ("source", "lang", "topic")
ALPHA = 0.7
BUDGET = 0.6
#: The sums are compared with their targets after every PASSES passes, MOST_PASSES at most.
PASSES, MOST_PASSES = 8, 400
TOLERANCE = 1e-4
ADDED = ("topic", "n_tokens", "cell_weight", "keep_p", "kept")


def topic(text: Column) -> Column:
    out = F.lit(REST)
    for name, strings, pattern in reversed(TOPICS):
        tests = [reduce(or_, [text.contains(x) for x in strings])] if strings else []
        tests += [text.rlike(pattern)] if pattern else []
        out = F.when(reduce(and_, tests), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(REST))


def token_count(text: Column) -> Column:
    """Words between ASCII white space: spaces left between them, and one."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))
    return F.when(one == "", 0).otherwise(F.octet_length(one) - F.octet_length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("long")


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(id_col.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.drop(*ADDED).withColumns({"topic": topic(F.col(text)), "n_tokens": token_count(F.col(text))})


def _sums(cells: DataFrame, weight: str) -> DataFrame:
    """(dimension, value, weight): the sum of a column of the cells for each value of each dimension."""
    values = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])).alias("d")
    return cells.select(values, weight).groupBy("d.dimension", "d.value").agg(F.sum(weight).alias(weight))


def tempered(cells: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Targets (dimension, value, share) that follow tokens ** alpha, for each dimension."""
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(0.0)
    total = F.sum(share).over(Window.partitionBy("dimension"))
    return _sums(cells, "tokens").select("dimension", "value", F.when(total > 0, share / total).otherwise(0.0).alias("share"))


def bounded(cells: DataFrame, targets: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Targets (dimension, value, share) that the values' tokens can fill.

    In order of room (what a value has, as a share of the budget) for its share, values
    are full as long as they have no more than what the rest would give them.
    """
    t = targets.select(F.col("dimension").alias("d"), F.col("value").alias("v"), "share")
    both = _sums(cells, "tokens").join(t, (F.col("dimension") == F.col("d")) & F.col("value").eqNullSafe(F.col("v"))).where("share > 0 and tokens > 0").drop("d", "v")
    mine = Window.partitionBy("dimension")
    # room for all values of the dimension, those without a target too
    everything = cells.agg(F.sum("tokens").alias("everything"))
    both = both.join(F.broadcast(everything)).withColumn("room", F.col("tokens") / (budget * F.col("everything")))
    ordered = mine.orderBy(F.col("room") / F.col("share"), "value")
    before = F.coalesce(F.sum("room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("share").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumn("full", F.col("room") * left <= (1 - before) * F.col("share"))
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(mine), F.lit(0.0))
    rest = F.sum(F.when(~F.col("full"), F.col("share"))).over(mine)
    return both.select("dimension", "value", F.when(F.col("full"), F.col("room")).otherwise(F.col("share") * (1 - taken) / rest).alias("share"))


def raked(cells: DataFrame, targets: DataFrame, budget: float = BUDGET, most_passes: int = MOST_PASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with `cell_weight`, whose sums meet the targets, and `room`, the most it can be."""
    targets = written(bounded(cells, targets, budget), "raking-targets")
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    full = lambda x: F.when(everything > 0, x).otherwise(0.0)
    cells = cells.withColumns({"room": full(F.col("tokens") / (budget * everything)), "cell_weight": full(F.col("tokens") / everything)})
    for d in DIMENSIONS:
        mine = targets.where(F.col("dimension") == d).select(F.col("value").alias("__value"), F.col("share").alias(f"__{d}"))
        cells = cells.join(mine, F.col(d).eqNullSafe(F.col("__value")), "left").drop("__value").withColumn(f"__{d}", F.coalesce(F.col(f"__{d}"), F.lit(0.0)))
    cells = written(cells.withColumn("cell_weight", F.least("cell_weight", "room")), "raking-cells")
    done, missed = 0, None
    while done < most_passes and (missed is None or missed >= tolerance):
        for _ in range(PASSES):
            for d in DIMENSIONS:
                total = F.sum("cell_weight").over(Window.partitionBy(d))
                cells = cells.withColumn("cell_weight", F.when(total > 0, F.least("room", F.col("cell_weight") * F.col(f"__{d}") / total)).otherwise(0.0))
        apart = [F.abs(F.sum("cell_weight").over(Window.partitionBy(d)) - F.col(f"__{d}")) for d in DIMENSIONS]
        cells = written(cells.withColumn("missed", F.greatest(*apart)), "raking-cells")
        done, missed = done + PASSES, cells.agg(F.max("missed").alias("m")).first().m or 0.0
        cells = cells.drop("missed")
    return cells.drop(*(f"__{d}" for d in DIMENSIONS))


def achieved(fitted: DataFrame, targets: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(dimension, value, share, target): what the fitted cells give each value beside what was asked for."""
    asked = targets.select(F.col("dimension").alias("d"), F.col("value").alias("v"), F.col("share").alias("target"))
    got = _sums(fitted, "cell_weight").withColumnRenamed("cell_weight", "share")
    return got.join(asked, (F.col("dimension") == F.col("d")) & F.col("value").eqNullSafe(F.col("v")), "left").drop("d", "v")


def mixed(docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", budget: float = BUDGET, alpha: float = ALPHA) -> DataFrame:
    """docs with topic, n_tokens, cell_weight, keep_p and kept.

    keep_p is budget * all tokens * cell_weight / the cell's tokens.
    """
    rows = described(docs, text)
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "raking-tokens")
    fitted = raked(cells, tempered(cells, alpha) if targets is None else targets, budget)
    p = F.when(F.col("room") > 0, F.least(F.lit(1.0), F.col("cell_weight") / F.col("room"))).otherwise(F.lit(1.0))
    fitted = fitted.withColumn("keep_p", F.round(p, 9)).withColumn("cell_weight", F.round("cell_weight", 9))
    theirs = unused(rows.columns, *(f"cell_{d}" for d in DIMENSIONS))
    table = written(fitted.select(*(F.col(d).alias(n) for d, n in zip(DIMENSIONS, theirs, strict=True)), "cell_weight", "keep_p"), "raking-weights")
    same = [F.col(d).eqNullSafe(F.col(n)) for d, n in zip(DIMENSIONS, theirs, strict=True)]
    out = rows.join(table, same, "left").drop(*theirs)
    return out.withColumn("kept", uniform(F.col(id_col)) < F.col("keep_p"))


def oracle(source: str = "documents", columns: str = "doc_id, source, lang, topic, n_tokens, cell_weight, keep_p, kept", budget: float = BUDGET, alpha: float = ALPHA) -> str:
    """The same in DuckDB SQL: a recursive common table expression for the passes."""
    held = lambda strings, p: " AND ".join(["(" + " OR ".join(f"contains(text, '{x}')" for x in strings) + ")"] * bool(strings) + [f"regexp_matches(text, '{p}')"] * bool(p))
    cases = " ".join(f"WHEN {held(strings, p)} THEN '{n}'" for n, strings, p in TOPICS)
    white = r"[\x20\x09-\x0D]+"
    inner = f"regexp_replace(coalesce(text, ''), '^{white}|{white}$', '', 'g')"
    steps = [
        f"r AS (SELECT *, CASE {cases} ELSE '{REST}' END AS topic, CASE WHEN {inner} = '' THEN 0 ELSE len(string_split_regex({inner}, '{white}')) END::BIGINT AS n_tokens FROM {source})",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL)",
    ]
    steps.append("e AS (SELECT sum(tokens) AS everything FROM c)")
    for d in DIMENSIONS:
        steps += [
            f"t_{d} AS (SELECT {d}, sum(tokens) AS tokens, pow(sum(tokens)::DOUBLE, {alpha}) AS s, sum(tokens) / ({budget} * any_value(everything)) AS room FROM c, e GROUP BY {d} HAVING sum(tokens) > 0)",
            f"o_{d} AS (SELECT {d}, s, room, room * sum(s) OVER (ORDER BY room / s, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= s * (1 - coalesce(sum(room) OVER (ORDER BY room / s, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM t_{d})",
            f"s_{d} AS (SELECT {d}, CASE WHEN is_full THEN room ELSE s * (1 - coalesce(sum(room) FILTER (is_full) OVER (), 0)) / sum(s) FILTER (NOT is_full) OVER () END AS share FROM o_{d})",
        ]
    room = f"CASE WHEN everything > 0 THEN tokens / ({budget} * everything) ELSE 0 END"
    steps.append(f"w0 AS (SELECT 0 AS k, c.*, {room} AS room, " + ", ".join(f"coalesce(s_{d}.share, 0) AS sh_{d}" for d in DIMENSIONS) + f", CASE WHEN everything > 0 THEN least(tokens / everything, {room}) ELSE 0 END AS w, 1.0::DOUBLE AS missed FROM c CROSS JOIN e " + " ".join(f"LEFT JOIN s_{d} ON c.{d} IS NOT DISTINCT FROM s_{d}.{d}" for d in DIMENSIONS) + ")")
    inner = f"(SELECT * FROM rake WHERE k < {MOST_PASSES} AND (k % {PASSES} <> 0 OR missed >= {TOLERANCE}))"
    for d in DIMENSIONS:
        inner = f"(SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN least(room, w * sh_{d} / sum(w) OVER (PARTITION BY {d})) ELSE 0 END AS w) FROM {inner})"
    apart = ", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) - sh_{d})" for d in DIMENSIONS)
    steps.append(f"rake AS (SELECT * FROM w0 UNION ALL SELECT * REPLACE (k + 1 AS k, max(missed) OVER () AS missed) FROM (SELECT * REPLACE (greatest({apart}) AS missed) FROM {inner}))")
    steps.append("p AS (SELECT source, lang, topic, round(w, 9) AS cell_weight, round(CASE WHEN room > 0 THEN least(1.0, w / room) ELSE 1.0 END, 9) AS keep_p FROM rake WHERE k = (SELECT max(k) FROM rake))")
    steps.append("m AS (SELECT r.*, p.cell_weight, p.keep_p, ('0x' || substr(md5(r.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < p.keep_p AS kept FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic = p.topic)")
    return f"WITH RECURSIVE {', '.join(steps)} SELECT {columns} FROM m"
