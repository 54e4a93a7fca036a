"""Conversations as training text, in Spark expressions.

The turns of a conversation are collected as structs and sorted by turn, role and text (null turns first). Adjacent turns of
one role become one block: `<turn ROLE>text<next/>text</turn>` and a line break. Inside texts and roles `\\` is written
`\\b` and `<` is written `\\l` (in roles also `>` as `\\g`), so a control string never occurs in a text, and both are undone
without loss. Loss spans mark the texts of the assistant, start (from 1) and length in code points, nothing of the
template. Null texts and roles are empty. Repeated rows are turns of their own. A null conv_id is a conversation.
A conversation is one row; it is as large as its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED = "assistant"
NEXT, END = "<next/>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """After `\\l` and `\\g` are gone, every `\\` left opens a `\\b`."""
    plain = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def running_sums(values: Column) -> Column:
    """Sums of an array's numbers from the first to each. A round adds what stands 2^k places before, so n numbers take n log n steps."""
    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"), F.lit(0)))

    def add(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.when(i >= back, F.get(sums, i - back)), F.lit(0).cast("long")))

    return F.aggregate(rounds, values, add)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, chars) for the rows conv_id, turn, role, text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    t = F.col("turns")

    def part(x: Column, i: Column) -> Column:
        opens = ~F.coalesce(F.get(t, i - 1)["role"] == x["role"], F.lit(False))
        closes = ~F.coalesce(F.get(t, i + 1)["role"] == x["role"], F.lit(False))
        head = F.when(opens, F.concat(F.lit("<turn "), _escape_role(x["role"]), F.lit(">"))).otherwise(F.lit(NEXT))
        return F.struct(head.alias("head"), escape(x["text"]).alias("text"), F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
                        (x["role"] == LEARNED).alias("learned"))

    parts = each.select("conv_id", F.transform(t, part).alias("parts"))
    p = F.col("parts")
    ends = running_sums(F.transform(p, lambda x: F.length(F.concat(x["head"], x["text"], x["tail"])).cast("long")))

    def span(x: Column, end: Column) -> Column:
        chars = F.length(x["text"]).cast("long")
        return F.struct(x["learned"].alias("learned"), (end - F.length(x["tail"]) - chars + 1).alias("start"), chars.alias("chars"))

    learned = F.filter(F.zip_with(p, ends, span), lambda s: s["learned"])
    spans = F.transform(learned, lambda s: F.struct(s["start"].alias("start"), s["chars"].alias("chars")))
    text = F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["text"], x["tail"])), "")
    return parts.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    def block(x: Column) -> Column:
        close = F.instr(x, ">")
        role = unescape(x.substr(F.lit(7), close - 7))
        texts = F.split(x.substr(close + 1, F.length(x)), NEXT, -1)
        return F.transform(texts, lambda y: F.struct(role.alias("role"), unescape(y).alias("text")))

    return F.flatten(F.transform(F.array_remove(F.split(formatted, END, -1), ""), block))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int"), s["chars"].cast("int")))), "")
