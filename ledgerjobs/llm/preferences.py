"""Preference formatting of chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written; role and text are put in.
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def gather_turns(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(beside, conv_id, turns array<struct<turn, role, text>>): turns in order of (turn, role, text), nulls first.

    ``beside`` is conv_id without its last bit: conversations 2k and 2k + 1 stand beside each
    other, and one shuffle by it serves them both. Null roles and texts become empty. Repeated
    turn numbers stay, one after the other. Turns without a conversation are left out.
    """
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("t")).where("conv_id is not null")
    rows = rows.select(F.shiftright("conv_id", 1).alias("beside"), "conv_id", "t").repartition("beside")
    return rows.groupBy("beside", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen, rejected), one row per conversation of ``gather_turns``.

    Chosen is the conversation up to its last reply (turn of the assistant), rejected the same
    history with a reply of the conversation beside it: the one of the same number, or the
    last if there are fewer. Where there is no such reply, rejected_id is null and rejected is
    the history alone; a conversation without a reply is its own rejected one.
    """
    replies = lambda turns: F.filter(turns, lambda t: t.role == "assistant")
    both = conversations.groupBy("beside").agg(F.collect_list(F.struct("conv_id", "turns")).alias("c"))
    each = both.select(F.explode("c").alias("own"), "c")
    each = each.select("own.*", F.get(F.filter("c", lambda c: c.conv_id != F.col("own.conv_id")), F.lit(0)).alias("other"))
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t.role), "assistant") + 1
    each = each.withColumn("upto", F.when(F.size(replies(F.col("turns"))) > 0, last).otherwise(0).cast("int")).withColumn("answers", replies(F.coalesce("other.turns", F.array())))
    history = F.slice("turns", F.lit(1), F.greatest(F.col("upto") - 1, F.lit(0)))
    can = (F.col("upto") > 0) & (F.size("answers") > 0)
    answer = F.element_at("answers", F.least(F.size(replies(F.col("turns"))), F.size("answers")))
    chosen = F.when(F.col("upto") > 0, F.slice("turns", F.lit(1), F.col("upto"))).otherwise(F.col("turns"))
    rejected = F.when(can, F.concat(history, F.array(answer))).when(F.col("upto") > 0, history).otherwise(F.col("turns"))
    return each.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.when(can, F.col("other.conv_id")).alias("rejected_id"), chosen.alias("chosen"), rejected.alias("rejected"))


def rendered(turn: Column) -> Column:
    a, b, c = TEMPLATE
    return F.concat(F.lit(a), turn.role, F.lit(b), turn.text, F.lit(c))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def loss_spans(turns: Column) -> Column:
    """Character spans start:end of what is learned in the rendered turns: assistant texts with their end mark."""
    a, b, c = TEMPLATE
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, turn):
        begin = acc.at + F.lit(len(a) + len(b)) + F.length(turn.role)
        end = begin + F.length(turn.text) + F.lit(len(c))
        span = F.when(turn.role == "assistant", F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc.spans, span).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc.spans), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """One row per pair: prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The longest common prefix of (role, text) turns is written once as the prompt; each side's
    other turns are its completion. A mask lists the character spans of its completion that
    bear loss. Equal conversations give two empty completions; without a common turn the
    prompt is empty. ``pairs`` has pair_id, chosen_id, rejected_id and both arrays of turns.
    """
    same = F.zip_with("chosen", "rejected", lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    first = F.array_position(same, False)
    n = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    cut = pairs.withColumn("n", n)
    tail = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").alias("prompt_turns"),
        joined(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        joined(tail("chosen")).alias("chosen"),
        joined(tail("rejected")).alias("rejected"),
        loss_spans(tail("chosen")).alias("chosen_mask"),
        loss_spans(tail("rejected")).alias("rejected_mask"),
    )
