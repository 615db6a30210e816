"""Relational chat formatting: turns are collected and sorted as structs, adjacent turns of one role merge, and the text is concatenated, all in Spark expressions.

Template. A block of turns with one role is `<|turn:ROLE|>TEXT<|/turn|>`; the texts of turns that were merged are kept apart by `<|next|>`.
In a text, a backslash is doubled and `<|` becomes `<\\|`, so no text holds a control string, and one regular expression undoes it.
In a role, `&` becomes `&amp;` and `|` becomes `&#124;`.

Edge cases: a null or empty text is an empty turn and is kept; a null role is the empty role; turns tie on (turn, role, text), nulls first, and repeated rows stay; a null conv_id is a conversation of its own; further columns are ignored; no rows give no rows.
One conversation is one output row, so its turns meet in one task by definition; every step over them is linear in their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import let, table

OPEN, CLOSE, NEXT, END = "<|turn:", "|>", "<|next|>", "<|/turn|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("&"), F.lit("&amp;")), F.lit("|"), F.lit("&#124;"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("&#124;"), F.lit("|")), F.lit("&amp;"), F.lit("&"))


def merged(turns: Column) -> Column:
    """array<struct<role, texts>>: sorted turns with adjacent ones of one role merged, each run of them sliced off once."""

    def fold(heads: Column) -> Column:
        def block(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1), F.size(turns))
            return F.struct(F.get(turns, at)["role"].alias("role"), F.transform(F.slice(turns, at + 1, end - at), lambda t: t["text"]).alias("texts"))

        return F.transform(heads, block)

    changes = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return let(changes, fold)


def _segments(blocks: Column, loss_role: str) -> Column:
    """array<struct<text, loss>>: the pieces of merged turns in order, with the mask."""
    of = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        head = of(F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit(CLOSE)), F.lit(False))
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(of(F.when(i > 0, NEXT).otherwise(""), F.lit(False)), of(escape(t), b["role"] == loss_role))))
        return F.concat(F.array(head), texts, F.array(of(F.lit(END), F.lit(False))))

    return F.flatten(F.transform(blocks, pieces))


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, segments array<struct<text, loss>> whose texts concatenate to formatted; loss marks what a model is trained on."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    cut = grouped.select("conv_id", _segments(let(F.col("turns"), merged), loss_role).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that format_chats put into the string, unmerged and unescaped."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, CLOSE, 1)
        role = unescape_role(F.substr(head, F.lit(len(OPEN) + 1)))
        texts = F.split(F.substr(block, F.length(head) + len(CLOSE) + 1), r"<\|next\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.filter(F.split(formatted, r"<\|/turn\|>", -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: let(b, turns)))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_chats(rows.unionByName(probe))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = out.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The formatted length follows from the template: each block of one role costs its marks, each text its escapes.
OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), r AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(text, '\', '\\'), '<|', '<\|'))
    + CASE WHEN before = role THEN 8 ELSE 18 + length(replace(replace(role, '&', '&amp;'), '|', '&#124;')) END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
