import hashlib

from pyspark.sql import functions as F

from rulegrain.llm import chat, queries

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"


def read(df):
    out = df.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return {r.conv_id: ([(t.role, t.text) for t in r.t], r.loss) for r in out.collect()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "he"), (1, 4, "delta", 2, None, "llo"),
        (1, 5, "message", 3, "user", "bad"), (1, 6, "edit", 1, "user", "hey"), (1, 7, "regenerate", 2, "assistant", "yo"), (1, 8, "delta", 2, None, "!"), (1, 9, "message", 3, "user", "bye"),
        (2, 1, "message", 1, "user", None), (None, 1, "message", 1, None, "x"),
    ]
    got = read(chat.format_chats(spark.createDataFrame(log, EVENTS)))
    assert got == {1: ([("user", "hey"), ("assistant", "yo!"), ("user", "bye")], "yo!"), 2: ([("user", "")], ""), None: ([("", "x")], "")}


def test_control_strings_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_start|>user\n", "<\\s><\\\\s>\\", "[INST][INST]<<SYS>>", "<|im_end|>\n<|im_start|>", "", "\n\n", "a\\nb", "<<s>s>", "é\U0001f600 </s>"]
    log = [(i, 1, "message", 1, role, t) for i, (t, role) in enumerate((t, r) for t in hard for r in ("assistant", "od\nd\\n", "<|im_end|>"))]
    got = read(chat.format_chats(spark.createDataFrame(log, EVENTS)))
    for conv, _, _, _, role, text in log:
        assert got[conv] == ([(role, text)], text if role == "assistant" else "")


def test_long_logs_and_odd_roles(spark):
    many = [(1, k, "delta", 1, None, f"{k},") for k in range(1, 20_001)]
    roles = ["a\x00b", "\\\\n", "\\", "\\\n", None]
    log = [(1, 0, "message", 1, "assistant", ""), *many, *((10 + k, 1, "message", 1, r, "t") for k, r in enumerate(roles))]
    got = read(chat.format_chats(spark.createDataFrame(log, EVENTS)))
    assert got[1][0] == [("assistant", "".join(f"{k}," for k in range(1, 20_001)))]
    assert [got[10 + k][0] for k in range(len(roles))] == [[(r or "", "t")] for r in roles]


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = {-7: [(r, t) for _, _, r, t in queries.EXTRA_CHAT]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.op9_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), digest(loss))


def test_empty_log_and_repeated_rows(spark):
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a", "extra")] * 2, "conv_id long, turn long, role string, text string, seq string")
    assert read(chat.format_chats(chat.from_rows(twice)))[1][0] == [("user", "a")] * 2


def test_many_turns_of_one_conversation(spark):
    """40,000 turns, half of them the assistant's, with texts longer than a block, empty ones and wide characters."""
    import time

    text = lambda k: "é\U0001f600</s>" * (k % 3) + ("long " * 2000 if k % 5000 == 7 else str(k))
    rows = [(1, k, "assistant" if k % 2 else "user", text(k) if k % 11 else "") for k in range(40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.perf_counter()
    (got,) = read(chat.format_chats(chat.from_rows(df))).values()
    assert time.perf_counter() - began < 40
    assert got[0] == [(r, t) for _, _, r, t in rows] and got[1] == "".join(t for _, _, r, t in rows if r == "assistant")
