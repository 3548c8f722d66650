"""Chat text of conversations stored one turn per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lectern import fixed
from lectern.functions import chat
from lectern.operators.sampling import number_ordered

TURNS_PER_PART = 4096


def render_conversations(
    turns: DataFrame,
    *,
    bos: str = fixed.BOS,
    add_generation_prompt: bool = False,
    on_invalid: str = "empty",
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """``conv_id, part, n_turns, valid, text`` from ``conv_id, turn, role, text``: a row per part of a conversation.

    Turns stand by their number; of those with the same one the user's is first, as in tables that number
    exchanges. A conversation of up to ``turns_per_part`` turns is one part. A longer one comes in parts of so
    many turns, however its turns are numbered: ``n_turns`` counts the part's, and the parts' texts, joined, are
    the whole. A conversation is valid if user and other turns alternate, the user first; in all its parts, or in
    none. A null turn makes its conversation invalid. Turns without a conversation are one invalid row.

    Runs one job over the numbers of turns per conversation. If none is over-long, as in most tables, the plan
    is a single shuffle of the turns. Over-long ones are numbered over range buckets, not gathered.
    """
    if on_invalid not in chat.ON_INVALID:
        raise ValueError(f"on_invalid must be one of {chat.ON_INVALID}")
    if turns_per_part < 1:
        raise ValueError("a part holds a turn at least")
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = lengths.where((F.col("n") > turns_per_part) & F.col("conv_id").isNotNull()).select("conv_id")
    lost = lengths.where("conv_id IS NULL").select(
        "conv_id", F.lit(0).cast("bigint").alias("part"), F.col("n").alias("n_turns"), F.lit(False).alias("valid"), F.lit("").alias("body")
    )
    found = lengths.agg(F.max(F.struct(F.when(F.col("conv_id").isNotNull(), F.col("n")).alias("n"))).alias("m"), F.count_if(F.col("conv_id").isNull()).alias("lost")).first()
    known = turns.where(F.col("conv_id").isNotNull())
    some_long = bool(found["m"] and found["m"]["n"] and found["m"]["n"] > turns_per_part)

    usual = known.join(long, "conv_id", "left_anti") if some_long else known
    pieces = _gathered(usual.withColumn("part", F.lit(0).cast("bigint"))).withColumns({"is_first": F.lit(True), "is_last": F.lit(True)})
    if some_long:
        pieces = pieces.unionByName(_long_pieces(known.join(long, "conv_id", "left_semi"), turns_per_part))

    head = F.when(F.col("is_first"), F.lit(bos)).otherwise(F.lit(""))
    tail = F.when(F.col("is_last"), F.lit(fixed.MODEL_TURN if add_generation_prompt else "")).otherwise(F.lit(""))
    shown = pieces.select("conv_id", "part", "n_turns", "valid", F.concat(head, "body", tail).alias("text"))
    if found["lost"]:
        shown = shown.unionByName(lost.withColumnRenamed("body", "text"))
    if on_invalid == "drop":
        return shown.where("valid")
    if on_invalid == "fail":
        told = F.lit("conversation roles must alternate")
        return shown.where(F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    return shown.withColumn("text", F.when(F.col("valid"), F.col("text")).otherwise(F.lit("")))


def _gathered(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """A row per ``conv_id`` and ``part``, with the turns' text and whether they alternate as they should there."""
    asks = ~F.col("role").eqNullSafe(F.lit("user"))
    turn = F.struct("turn", asks.alias("told"), "role", F.col("text").alias("content"))
    gathered = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.count_if(F.col("turn").isNull()).alias("unplaced"))
    odd = F.col("part") * turns_per_part % 2 == 1
    return gathered.select(
        "conv_id",
        "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        ((F.col("unplaced") == 0) & F.when(odd, chat.roles_alternate(F.col("turns"), 1)).otherwise(chat.roles_alternate(F.col("turns")))).alias("valid"),
        chat.turns_text(F.col("turns")).alias("body"),
    )


def _long_pieces(turns: DataFrame, turns_per_part: int) -> DataFrame:
    """Over-long conversations in parts, by the position of each turn; valid if all parts are.

    Turns are numbered over all these conversations, and a conversation's first number taken off.
    """
    keys = ["conv_id", "turn", "_told", "role", "text"]
    placed = number_ordered(turns.select("conv_id", "turn", "role", "text").withColumn("_told", ~F.col("role").eqNullSafe(F.lit("user"))), keys)
    starts = placed.groupBy("conv_id").agg(F.min("position").alias("_start"))
    part = F.floor((F.col("position") - F.col("_start")) / turns_per_part).cast("bigint")
    pieces = _gathered(placed.join(starts, "conv_id").withColumn("part", part), turns_per_part)
    whole = Window.partitionBy("conv_id")
    return pieces.withColumns(
        {
            "valid": F.min("valid").over(whole),
            "is_first": F.col("part") == 0,
            "is_last": F.col("part") == F.max("part").over(whole),
        }
    )
