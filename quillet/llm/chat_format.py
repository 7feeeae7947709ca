"""Preference formatting: one prompt for the longest common turn prefix, and a pair of
masked completions.

Only DataFrame functions are used. The only shuffle brings the turns of a conversation
together; pairs are formatted row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def render(turn: Column) -> Column:
    """One turn as text; a null role is ``unknown`` and a null text is empty."""
    return F.concat(
        F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"),
        F.coalesce(turn["text"], F.lit("")), F.lit("\n<|end|>\n"),
    )


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text (nulls are equal)."""
    differs = F.zip_with(a, b, lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    first = F.array_position(differs, True).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)))


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order of turn, role and text.

    Repeated rows stay, null turns come first, other columns are ignored.
    """
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` without chosen and rejected, and with the formatted texts and masks (which
    replace columns of the same names).

    ``chosen`` and ``rejected`` are arrays of (role, text); null counts as empty.
    prompt_turns: turns of the longest common prefix; prompt: their text, rendered once;
    chosen_text and rejected_text: the turns after it; chosen_mask and rejected_mask: for
    each of these turns 1 if it is trained on (assistant turns), else 0; usable: both
    completions have a trained turn. Equal conversations have empty completions.
    """
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    made = ("prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask", "usable")
    carried = [c for c in pairs.columns if c not in ("chosen", "rejected", *made)]
    cols = [F.col(f"`{c}`") for c in carried] or [F.lit(None).alias("_none")]
    work = pairs.select(F.struct(*cols).alias("_row"), F.coalesce("chosen", nothing).alias("_a"), F.coalesce("rejected", nothing).alias("_b"))
    work = work.withColumn("_n", common_turns(F.col("_a"), F.col("_b")))
    rest = lambda x: F.slice(x, F.col("_n") + 1, F.size(x))
    work = work.select("_row", "_n", F.slice("_a", F.lit(1), F.col("_n")).alias("_p"), rest("_a").alias("_a"), rest("_b").alias("_b"))
    text = lambda x: F.array_join(F.transform(x, render), "")
    mask = lambda x: F.transform(x, lambda t: t["role"].eqNullSafe(TRAINED_ROLE).cast("int"))
    return work.select(
        *[F.col(f"_row.`{c}`") for c in carried],
        F.col("_n").alias("prompt_turns"), text("_p").alias("prompt"),
        text("_a").alias("chosen_text"), mask("_a").alias("chosen_mask"),
        text("_b").alias("rejected_text"), mask("_b").alias("rejected_mask"),
        (F.array_contains(mask("_a"), 1) & F.array_contains(mask("_b"), 1)).alias("usable"),
    )


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) from plain conversations.

    Chosen is the conversation up to its last assistant turn. In rejected, that turn
    repeats the text of the turn before it (nothing, if it is the first). Without an
    assistant turn both are the whole conversation.
    """
    roles = F.transform("turns", lambda t: t["role"].eqNullSafe(TRAINED_ROLE))
    back = F.array_position(F.reverse(roles), True).cast("int")
    last = F.when(back > 0, F.size("turns") - back + 1)
    work = conversations.select("conv_id", "turns", last.alias("last"))
    said = F.when(F.col("last") > 1, F.get("turns", F.col("last") - 2)["text"]).otherwise(F.lit(""))
    echo = F.array(F.struct(F.lit(TRAINED_ROLE).alias("role"), said.alias("text")))
    return work.select(
        "conv_id",
        F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.col("last"))).alias("chosen"),
        F.when(F.col("last").isNull(), F.col("turns")).otherwise(
            F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), echo)
        ).alias("rejected"),
    )
