"""Preference formatting of chosen and rejected conversations.

A pair is two conversations over the same prompt.  Their longest common prefix
of turns (equal role and text, position by position) is rendered once as the
prompt; what follows on either side is the completion, with a mask: the
character spans of assistant turns, on which a loss is taken.

A turn is rendered as ``<|role|>\\n`` + text + ``<|end|>\\n``; the opening ``<|``
of a marker inside a text becomes ``< |``, so a text cannot forge a turn.

Defined cases: turns are ordered by number, null first, then role and text; an
exactly repeated row of a conversation counts once; a null text is empty; a null
role is ``unknown`` and never trained on; a pair without a rejected side has an
empty rejected completion; two equal sides have the whole conversation as
prompt and empty completions; no turn at all gives empty strings; a null
conversation id is a conversation without a partner; an empty table gives no pairs;
very long turns are rendered whole.  Columns other than conv_id, turn, role and text
are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
SPAN = "struct<start:bigint,end:bigint>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ordered ``turns``: array of (role, text).  A group is one
    conversation, the unit that is rendered."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    return turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_set("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(turn["role"], F.lit("|"), F.lit("")), F.lit("|>\n"),
                    F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def _completion(turns: Column) -> tuple[Column, Column]:
    """Rendered text of ``turns`` and the spans of its assistant turns (text and
    end marker, in characters of that text)."""
    text = F.array_join(F.transform(turns, rendered), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        end = acc["at"] + F.length(rendered(turn))
        begin = acc["at"] + F.length(F.replace(turn["role"], F.lit("|"), F.lit(""))) + 5
        span = F.array(F.struct(begin.cast("long").alias("start"), (end - 1).cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(
            turn["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return text, F.aggregate(turns, start, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: arrays of turns) to pair_id,
    prefix_turns, prompt, chosen, rejected and the masks of both completions."""
    empty = F.array().cast(f"array<{TURN}>")
    a, b = F.coalesce("chosen", empty), F.coalesce("rejected", empty)
    shared = F.least(F.size(a), F.size(b))
    both = pairs.select("pair_id", a.alias("a"), b.alias("b"), shared.alias("shared"))
    differ = F.zip_with(F.slice("a", F.lit(1), F.col("shared")), F.slice("b", F.lit(1), F.col("shared")),
                        lambda x, y: x != y)
    first = F.array_position(differ, True)
    prefix = F.when(first > 0, first - 1).otherwise(F.col("shared")).cast("int")
    cut = both.select("pair_id", "a", "b", prefix.alias("n")).select(
        "pair_id", F.col("n").cast("long").alias("prefix_turns"), F.slice("a", F.lit(1), F.col("n")).alias("p"),
        F.filter("a", lambda x, i: i >= F.col("n")).alias("c"), F.filter("b", lambda x, i: i >= F.col("n")).alias("r"))
    chosen, chosen_mask = _completion(F.col("c"))
    rejected, rejected_mask = _completion(F.col("r"))
    return cut.select(
        "pair_id", "prefix_turns", F.array_join(F.transform("p", rendered), "").alias("prompt"),
        chosen.alias("chosen"), chosen_mask.alias("chosen_mask"),
        rejected.alias("rejected"), rejected_mask.alias("rejected_mask"))


def mismatched_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: the conversation itself is
    chosen; in the rejected one its last assistant turn, and all after it, gives
    way to the last assistant turn of the conversation whose id is one higher.
    Without such a partner or turn there is no rejected side."""
    convs = conversations(turns)
    last = F.array_size("turns") - F.array_position(
        F.transform(F.reverse("turns"), lambda t: t["role"] == "assistant"), True)
    marked = convs.withColumn("last", F.when(F.exists("turns", lambda t: t["role"] == "assistant"), last).cast("int"))
    partner = marked.where("last is not null and conv_id is not null").select(
        (F.col("conv_id") - 1).alias("of"), F.get("turns", F.col("last")).alias("other"))
    joined = marked.join(partner, F.col("conv_id") == F.col("of"), "left")
    rejected = F.when(F.col("last").isNotNull() & F.col("other").isNotNull(), F.concat(
        F.filter("turns", lambda t, i: i < F.col("last")), F.array("other")))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))
