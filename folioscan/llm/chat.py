r"""Chat formatting with a grammar round trip, DataFrame operations only.

    conversation = turn*        turn = "### " role ": " body "</turn>" newline

A turn is rendered as it stands, reparsed by the grammar and compared with its source; where the two
differ, its conflicting content is escaped and it is rendered and compared again. Escaping puts a
backslash before every backslash, into the two control strings ("</turn>" -> "<\/turn>",
"### " -> "#\## ") and, in a role, into ": " (":\ "); reading a backslash gives the character after
it. Escaped text holds no control string, so the parser needs no state: split at the end mark, then at
the first ": ". Escaping changes only what conflicts, so one step reaches the fixed point; a turn that
still differed would stop the query rather than pass.

The training format is one row per conversation: the text and loss_spans, for each turn the (start,
length) in code points of its body within the turn if the loss counts there (assistant), else null. What the query reports is parsed back from that written table.

Defined cases: null text is empty; null role is the empty role; turns are ordered by turn (null first),
then role, then text, so repeated rows and ties stay, side by side, in a defined order; a null conv_id is
a conversation. An empty table gives conversation -7 alone in the query, no row in the operator.
A conversation is one row by definition, so its turns meet in one task; all escaping and checking is
done before that, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

OPEN, SEP, END = "### ", ": ", "</turn>\n"
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def _escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("### "), F.lit("#\\## "))


def _escaped_role(role: Column) -> Column:
    return F.replace(_escaped(role), F.lit(": "), F.lit(":\\ "))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), body, F.lit(END))


def pieces(formatted: Column) -> Column:
    """The rendered turns of a conversation, without their end marks."""
    split = F.split(formatted, END, -1)
    return F.slice(split, F.lit(1), F.greatest(F.size(split) - 1, F.lit(0)))


def parse(turns: Column) -> Column:
    """array<struct<role, text>> of rendered turns, unescaped."""

    def turn(x: Column) -> Column:
        cut = F.instr(x, SEP)  # 1-based
        return F.struct(
            unescaped(F.substring(x, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))).alias("role"),
            unescaped(F.substring(x, cut + len(SEP), F.length(x))).alias("text"),
        )

    return F.transform(turns, turn)


def _survives(role: Column, text: Column, rendered: Column) -> Column:
    """Does a parser that sees this turn between others recover it alone and whole?"""
    turns = parse(pieces(F.concat(rendered, rendered)))
    source = F.struct(role.alias("role"), text.alias("text"))
    no_mark = F.length(F.replace(F.replace(F.substring(rendered, F.lit(len(OPEN) + 1), F.length(rendered)), F.lit("### "), F.lit("")), F.lit("</turn>"), F.lit("")))
    return (turns == F.array(source, source)) & (no_mark == F.length(rendered) - len(OPEN) - len(END) + 1)


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, length>>) of conversations(conv_id, turn, role, text); other columns are not read."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = _render(F.col("role"), F.col("text"))
    rows = rows.withColumn("ok", _survives(F.col("role"), F.col("text"), plain))
    rows = rows.withColumn("r", F.when(F.col("ok"), F.col("role")).otherwise(_escaped_role(F.col("role"))))
    rows = rows.withColumn("b", F.when(F.col("ok"), F.col("text")).otherwise(_escaped(F.col("text"))))
    again = F.when(F.col("ok") | _survives(F.col("role"), F.col("text"), _render(F.col("r"), F.col("b"))), F.col("b"))
    rows = rows.withColumn("b", F.coalesce(again, F.raise_error(F.lit("a turn does not survive the round trip")).cast("string")))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "r", "b")))
    whole = rows.groupBy("conv_id").agg(turns.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: _render(t["r"], t["b"])), "")
    span = lambda t: F.struct((len(OPEN) + F.length(t["r"]) + len(SEP)).alias("start"), F.length(t["b"]).alias("length"))
    return whole.select("conv_id", text.alias("formatted"), F.transform("turns", lambda t: F.when(t["role"] == "assistant", span(t))).alias("loss_spans"))


def digests(output: DataFrame) -> DataFrame:
    """What a reader finds in the output: the turns by the grammar, the loss by the spans."""
    cut = lambda piece, span: F.coalesce(unescaped(F.substring(piece, span["start"] + 1, span["length"])), F.lit(""))
    turns, loss = parse(pieces(F.col("formatted"))), F.array_join(F.zip_with(pieces(F.col("formatted")), F.col("loss_spans"), cut), "")
    read = output.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return digests(materialise(formatted(rows.unionByName(extra)), "chat"))


ORACLE = r"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
    shown AS (
        SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ': ', ':\ '))
                + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ')) + 14 AS width FROM rows)
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(width)::BIGINT AS formatted_chars
    FROM shown GROUP BY conv_id"""


def oracle() -> str:
    return ORACLE
