"""Chat formatting (operator 9): event-sourced reconstruction, in DataFrame functions only.

A log has events (conv_id, seq, turn, message, kind, role, text).  Kinds: `delta` adds its text to the message; `edit`
replaces what the message says so far; `regenerate` empties it, and deltas follow.  A message's events are sorted by
seq and folded into its final text, each message by itself, so a conversation with a third of all events is folded by many tasks;
only final messages meet, in the order of turn, role, text and message, and are rendered.

The template: `<|im_start|>` role `<|im_sep|>` text `<|im_end|>` for each turn.  In roles and texts a backslash is put before
each backslash and after the first character of each control string (those of the template and of other common ones), so that none
occurs in them; removing it again gives back the text.

Defined results: a null text is empty; a null role is the empty role, without loss; a conversation is named by conv_id, null included; rows of
equal turn are ordered by role and text; repeated rows are turns like others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROL = (START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        text = F.replace(text, F.lit(x), F.lit(f"{x[0]}\\{x[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events(conversations: DataFrame) -> DataFrame:
    """A log of one delta for each row of conversations (conv_id, turn, role, text)."""
    return conversations.select("conv_id", F.monotonically_increasing_id().alias("seq"), "turn", F.monotonically_increasing_id().alias("message"), F.lit("delta").alias("kind"), "role", "text")


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the final messages of a log."""
    by = log.groupBy("conv_id", "turn", "message").agg(F.max("role").alias("role"), F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("events"))
    # what stands before the last edit or regeneration is gone
    resets = F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(-1)))
    last = F.greatest(F.array_max(resets), F.lit(0))
    lasting = F.slice("events", last + 1, F.size("events"))
    said = F.transform(lasting, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    return by.select("conv_id", "turn", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(said, "").alias("text"))


def rendered(log: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted): each conversation as segments (text, loss), and their concatenation."""
    turns = messages(log).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "message"))).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return turns.select("conv_id", segments.alias("segments")).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def op9_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", args={"said": said})
    out = rendered(events(conversations.unionByName(extra)))
    # read back: turns from the formatted string, the loss from the mask
    parts = F.slice(F.split("formatted", r"<\|im_end\|>"), 1, F.size(F.split("formatted", r"<\|im_end\|>")) - 1)
    back = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2))
    turns = F.array_join(F.transform(back, lambda p: F.concat(unescaped(p[0]), F.lit("\n"), unescaped(p[1]), F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return out.withColumns({"n_turns": F.size(parts).cast("long"), "turns": turns, "loss": loss}).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


_SAID = "</s>[INST] ok [/INST]"
_ESCAPED = "replace(coalesce({0}, ''), '\\', '\\\\')"
for _x in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_x}', '{_x[0]}\\{_x[1:]}')"
SQL = {
    "op9_format_chats": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum({len(START) + len(SEP) + len(END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
}

QUERIES = {"op9_format_chats": op9_format_chats}
