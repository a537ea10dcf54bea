"""Operator 8, chat formatting: relational, by Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one message; the
pieces are concatenated. A message is ``<|im_start|>role\\n text <|im_end|>\\n``; merged turns are set apart by
``<|im_sep|>``, which the loss mask leaves out, so every turn can be read back.

Control strings inside roles and texts are escaped reversibly: every ``<|`` gets a second bar, so no control string
(none of which has two) can appear in an escaped text, and taking the second bar away gives the text again.

Defined results: null roles and texts count as empty; a row without a conversation id is a conversation by itself; turns sort by
number (null first), then role, then text, so ties and repeated rows give the same result in any order; a text or
role may be empty or very long (a conversation is one value, so it must fit into one row, which is 2 GB); an empty table gives an
empty table. Only the four named columns are read, and the output has names of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
_END, _SEP = r"<\|im_end\|>\n", r"<\|im_sep\|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    """As a text; a line break, which ends the role in the template, is written ``<|n|>``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def format_chat(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: (conv, segments, formatted).

    ``segments``: array of (text, loss), whose texts make up ``formatted``; ``loss`` is the loss mask.
    """
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    got = rows.filter(F.col(conv).isNotNull()).groupBy(F.col(conv)).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    got = got.unionByName(rows.filter(F.col(conv).isNull()).select(F.col(conv), F.array(one).alias("turns")))

    def segments(turns: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(turns, lambda t: t["role"]))
        pairs = F.zip_with(turns, F.slice(before, 1, F.size(turns)), lambda t, b: F.struct(t.alias("t"), b.alias("b")))

        def pieces(p: Column) -> Column:
            head = F.concat(F.when(p["b"].isNull(), "").otherwise(END), F.lit(START), escape_role(p["t"]["role"]), F.lit("\n"))
            lead = F.when(p["b"].eqNullSafe(p["t"]["role"]), SEP).otherwise(head)
            body = F.struct(escape(p["t"]["text"]).alias("text"), (p["t"]["role"] == loss_role).alias("loss"))
            return F.array(F.struct(lead.alias("text"), F.lit(False).alias("loss")), body)

        return F.concat(F.flatten(F.transform(pairs, pieces)), F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))

    cut = got.select(F.col(conv), let(F.col("turns"), segments).alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), as they were before formatting."""
    messages = F.split(formatted, _END)

    def turns(message: Column) -> Column:
        def of(head: Column) -> Column:
            role = unescape_role(F.substring(head, len(START) + 1, F.length(head)))
            body = F.substring(message, F.length(head) + 2, F.length(message))
            return F.transform(F.split(body, _SEP), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

        return let(F.substring_index(message, "\n", 1), of)

    return F.flatten(F.transform(F.slice(messages, 1, F.size(messages) - 1), turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
