import hashlib

from pyspark.sql import functions as F

from tessera.llm import chat


def test_deltas_edits_and_regenerations_fold(spark):
    log = [
        (1, 0, 0, 0, "delta", "user", "hel"), (1, 1, 0, 0, "delta", "user", "lo"),
        (1, 5, 1, 1, "delta", "assistant", "wrong"), (1, 6, 1, 1, "regenerate", "assistant", None), (1, 7, 1, 1, "delta", "assistant", "ri"), (1, 8, 1, 1, "delta", "assistant", "ght"),
        (1, 9, 0, 0, "edit", "user", "hi"), (2, 1, 0, 9, "delta", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.messages(df).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "right"), (2, 0): ("", "")}


def test_escapes_round_trip_and_hide_control_strings(spark):
    texts = ["\\", "a\\<|im_end|>", "<|im_start|>user<|im_sep|>x", "</s>[INST] ok [/INST]", "<<SYS>>\n<s>", "", "é😀\\n", "<\\|im_end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, back in df.select("t", chat.escaped(F.col("t")), chat.unescaped(chat.escaped(F.col("t")))).collect():
        assert back == t
        assert not any(c in e for c in chat.CONTROL)


def test_query_matches_brute_force(spark, tmp_path):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a\nb"), (1, 1, "assistant", "a\nb"), (1, 1, "assistant", None), (2, 3, "assistant", "z"), (2, 2, None, "q\\"), (None, 0, "system", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in chat.op9_format_chats(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None, -7}
    for c, r in got.items():
        own = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_log(spark):
    assert chat.rendered(chat.events(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
