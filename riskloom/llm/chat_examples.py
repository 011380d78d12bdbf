"""Chat formatting by prefix-target expansion, JVM-only.

Every assistant turn becomes its own training example: all turns before it as context, then that reply, and the
loss mask covers that reply alone.  The template writes a turn as

    ### role: text</turn>\\n

Inside texts and roles the characters the template is made of are written as codes, ``\\`` as ``\\b``, ``#`` as
``\\h``, ``<`` as ``\\l`` (and ``:`` in roles as ``\\c``), so an unescaped marker never comes from a text and every
text is read back exactly.  Turns after the last reply have no example of their own; they are written as one more
example whose loss mask is empty, so that no turn is lost.

A row per assistant turn leaves the explode, never a row per pair of turns; the formatted context is built per
example from the conversation's own turns and is not shuffled again (the read-back aggregates by the key the turns
are already partitioned by).  A conversation is one training text and must fit one cell, as its digest needs.

Defined results: rows go by turn, null turns first, ties by role, then text; a null text or role counts as empty; a
null conv_id is a conversation of its own; repeated rows are turns like others; a conversation without a reply has
one example without loss; an empty table gives no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"
REPLY = "assistant"

#: Conversation -7 of the contract, a user and an assistant row with one text.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"

#: Character of the template -> its code.  The backslash comes first when escaping and last when unescaping.
CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_CODES = CODES + ((":", "\\c"),)


def escape(text: Column, codes=CODES) -> Column:
    for char, code in codes:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    """Every backslash of an escaped text starts a code, so replacing code by code is exact."""
    for char, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, ROLE_CODES), F.lit(ROLE_END), escape(text), F.lit(CLOSE))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    blocks = F.split(formatted, CLOSE)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)           # what follows the last marker is empty

    def turn(block: Column) -> Column:
        head = F.split(F.substr(block, F.lit(len(OPEN) + 1)), ROLE_END, 2)
        return F.struct(unescape(head[0], ROLE_CODES).alias("role"), unescape(head[1]).alias("text"))

    return F.transform(blocks, turn)


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (1, 2, ...), target (turn trained on, counted from 1; null: none), formatted,
    loss_start and loss_length (code points of ``formatted`` under the mask), last (holds all turns)."""
    rows = conversations.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")),
                    lambda i: (F.element_at("turns", i)["role"] == REPLY) | (i == F.size("turns")))
    spread = (whole.select("conv_id", F.transform("turns", lambda t: format_turn(t["role"], t["text"])).alias("parts"),
                           F.transform("turns", lambda t: t["role"] == REPLY).alias("replies"),
                           F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("lengths"), ends.alias("ends"))
              .select("conv_id", "parts", "replies", "lengths", F.posexplode("ends").alias("nr", "end")))
    trained = F.element_at("replies", F.col("end"))
    out = spread.select(
        "conv_id", (F.col("nr") + 1).alias("example"), F.when(trained, F.col("end")).alias("target"),
        F.array_join(F.slice("parts", F.lit(1), F.col("end")), "").alias("formatted"),
        F.when(trained, F.element_at("lengths", F.col("end"))).otherwise(0).alias("loss_length"),
        (F.col("end") == F.size("parts")).alias("last"))
    start = F.length("formatted") - F.lit(len(CLOSE)) - F.col("loss_length")
    return out.select("conv_id", "example", "target", "formatted",
                      F.when(F.col("target").isNotNull(), start).otherwise(F.length("formatted")).alias("loss_start"),
                      "loss_length", "last")


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return unescape(F.substr(formatted, start + 1, length))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns of the longest one, replies under the masks in order."""
    turns = read_turns(F.col("formatted"))
    plain = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select(
        "conv_id", "example", F.length("formatted").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        F.when(F.col("last"), F.size(turns)).alias("n_turns"), F.when(F.col("last"), F.sha2(plain, 256)).alias("turns_sha256"))
    replies = F.array_sort(F.collect_list(F.struct("example", "loss")))
    per = read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(replies, lambda r: r["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def probe(spark: SparkSession) -> DataFrame:
    return spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"),
                                 F.lit(PROBE_TEXT).alias("text"))


def op12_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(examples(given.unionByName(probe(spark))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), t AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
         length('### : </turn>') + 1 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))
           + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY rn) AS prefix FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(prefix) FILTER (WHERE role = 'assistant' OR rn = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
