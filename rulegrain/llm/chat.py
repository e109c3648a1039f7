"""Chat formatting from an event log (native Spark).

A conversation is a log of events (conv_id, seq, kind, turn, role, text):

* `message`    starts a turn (or replaces one that is there);
* `delta`      adds text to the turn, in order of seq;
* `edit`       replaces the turn's text;
* `regenerate` restarts the turn and removes every later turn written before it.

The log is partitioned by conversation, sorted by seq and folded into final
messages; messages are rendered into one string for each conversation together
with the spans of its loss mask (assistant texts, in code points).

Rendered form of a turn: START role \\n text END \\n. Control strings inside a
text or a role get one backslash after their first character (one more if they
have some already), so no control string survives in a text and unescaping
restores every text.

Defined results: null text or role is empty; a null conv_id is a conversation
of its own; ties in seq are ordered by kind, role and text; repeated rows of
`message` kind with one turn and seq keep the last in that order, rows of
from_rows() keep every row; an empty log gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]"
_ESCAPE = rf"([<\[])(\\*)({CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    # \\ and \n are read from the left: between two double backslashes there are none
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def from_rows(rows: DataFrame) -> DataFrame:
    """Final rows (conv_id, turn, role, text) as an event log: one message each."""
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(at).cast("long").alias("seq"), F.lit("message").alias("kind"), F.row_number().over(at).cast("long").alias("turn"), "role", "text")


def folded(events: DataFrame) -> DataFrame:
    """The log's final messages: conv_id, turn, role, text.

    Each turn's last message, edit or regenerate event holds its base text, and
    the deltas after it are appended. Windows by conversation and by turn of a
    conversation share one shuffle.
    """
    # from the end of the log: frames that only grow are not summed afresh for each row
    order = [F.col(c).desc_nulls_last() for c in ("seq", "kind", "role", "text")]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    after = conv.rowsBetween(Window.unboundedPreceding, -1)
    # the lowest turn that any later event regenerates: all beyond it goes
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(after)
    turn = Window.partitionBy("conv_id", "turn").orderBy(*order)
    base = F.col("kind").isin("message", "edit", "regenerate")
    live = events.withColumn("__cut", cut).where(F.col("__cut").isNull() | (F.col("turn") <= F.col("__cut")))
    live = live.withColumn("__left", F.sum(F.when(base, 1).otherwise(0)).over(turn.rowsBetween(Window.unboundedPreceding, -1)))
    live = live.withColumn("__nth", -F.row_number().over(turn))
    live = live.where(F.coalesce(F.col("__left"), F.lit(0)) == 0)
    return live.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("__nth"))).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__nth", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"),
    )


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask (array of start, length in code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _role_out(role), F.lit("\n"))
    parts = messages.select("conv_id", "turn", head.alias("head"), escaped(text).alias("body"), (role == "assistant").alias("loss"))
    # a turn's place is the running sum of the sizes before it: each turn is touched once
    close = F.lit(END + "\n")
    before = Window.partitionBy("conv_id").orderBy("turn", "head", "body").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END) + 1
    placed = parts.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "head", "body", "loss"))).alias("turns"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], close)), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct((t["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        body = F.substring(p, cut + 1, F.length(p) - cut - len(END) - 1)
        return F.struct(_role_in(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


#: Code points of a block, in which a span's place is looked for.
BLOCK = 4096


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between.

    The text is cut into blocks once, so a span is read from the blocks that it
    lies in, not from the text's beginning.
    """
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(b: Column, m: Column) -> Column:
        first, last = F.floor(m["start"] / BLOCK).cast("int"), F.floor((m["start"] + m["length"]) / BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(b, first + 1, last - first + 1), ""), m["start"] - first * BLOCK + 1, m["length"])

    # an array of one: what its lambda sees is computed once
    return F.get(F.transform(F.array(blocks), lambda b: F.array_join(F.transform(mask, lambda m: unescaped(cut(b, m))), "")), 0)


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask of every conversation of an event log."""
    return rendered(folded(events))
