"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, then its text, which alone is
trainable. Where turns follow the last assistant turn, one more example holds the whole conversation and trains nothing,
so that no turn is lost.

A turn is written `<s>[ROLE]role[/ROLE]text</s>`. Inside roles and texts `&`, `<` and `[` are written `&amp;`, `&lt;`
and `&#91;`, so no control string can occur there, and unescape() gives the exact text back.

A conversation's turns are gathered in one row (its examples repeat its beginning, so it has to fit a row in any case);
the examples are cut from the conversation's formatted text one at a time, and never held together.

Defined cases: null text or role is empty; turns are ordered by turn (nulls first), then role, then text, so repeated
turns stay, in a fixed order; a null conv_id is a conversation of its own; a conversation without turns does not occur,
as it has no rows; an empty table gives an empty result. Columns but conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[ROLE]", "[/ROLE]", "</s>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, mask_start, mask_end (code points of text that train, end excluded), is_whole.

    is_whole marks the example that holds all turns of its conversation.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit(BEGIN + OPEN), escape(role), F.lit(CLOSE))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = F.concat_ws("", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    # where each turn's text starts and ends, as running sums; the last one's end and END are the whole length
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,trained:boolean>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.concat(
                acc["spans"],
                F.array(F.struct((acc["at"] + F.length(t["head"])).alias("a"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("b"), (t["role"] == TRAINED).alias("trained"))),
            ).alias("spans"),
        ),
    )["spans"]
    convs = convs.select("conv_id", whole.alias("whole"), spans.alias("spans"))
    ends = F.filter("spans", lambda x: x["trained"])
    rest = F.when(F.element_at("spans", -1)["trained"], F.array().cast("array<struct<a:int,b:int,trained:boolean>>")).otherwise(F.slice("spans", -1, 1))
    out = convs.select("conv_id", "whole", F.posexplode(F.concat(ends, rest)).alias("example", "x"))
    stop = F.col("x.b") + len(END)
    return out.select(
        "conv_id",
        "example",
        F.substring("whole", F.lit(1), stop).alias("text"),
        F.when(F.col("x.trained"), F.col("x.a")).otherwise(stop).alias("mask_start"),
        F.when(F.col("x.trained"), F.col("x.b")).otherwise(stop).alias("mask_end"),
        (stop == F.length("whole")).alias("is_whole"),
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted text, array<struct<role, text>>."""
    pieces = F.filter(F.split(text, F.lit(END)), lambda x: x != "")
    head = len(BEGIN + OPEN)
    cut = lambda x: F.instr(x, F.lit(CLOSE))
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring(x, F.lit(head + 1), cut(x) - 1 - head)).alias("role"), unescape(F.substring(x, cut(x) + len(CLOSE), F.length(x))).alias("text")
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the examples."""
    loss = unescape(F.substring("text", F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start")))
    rows = formatted.select(
        "conv_id",
        F.when(F.col("is_whole"), parsed(F.col("text"))).alias("turns"),
        F.struct("example", loss.alias("loss")).alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    convs = rows.groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss_text = F.concat_ws("", F.transform("loss", lambda x: x["loss"]))
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
