"""Reward columns for completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern import fixed
from lectern.functions.text import boxed_answer, has_reasoning_block, strip_unicode


def completion_text(df: DataFrame, column: str) -> Column:
    """The completion as text: a message array gives its first message's content."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.get(F.col(column), F.lit(0))["content"]
    return F.col(column)


def format_reward(text: Column) -> Column:
    return F.when(has_reasoning_block(text), F.lit(fixed.FORMAT_REWARD)).otherwise(F.lit(0.0))


def predicted_answer(text: Column, plain_gold: bool = False) -> Column:
    boxed = boxed_answer(text)
    return F.coalesce(boxed, strip_unicode(text)) if plain_gold else boxed


def gold_answer(answer: Column, plain_gold: bool = False) -> Column:
    """The boxed gold; an empty answer stays empty. ``plain_gold`` takes unboxed answers as they are."""
    boxed = boxed_answer(answer)
    if plain_gold:
        boxed = F.coalesce(boxed, strip_unicode(answer))
    return F.when(answer == "", F.lit("")).otherwise(boxed)


def match_reward(predicted: Column, gold: Column) -> Column:
    """Exact equality; a missing side earns nothing."""
    return F.when(predicted == gold, F.lit(fixed.CORRECT_REWARD)).otherwise(F.lit(0.0))


def correctness_reward(text: Column, answer: Column, plain_gold: bool = False) -> Column:
    return match_reward(predicted_answer(text, plain_gold), gold_answer(answer, plain_gold))
