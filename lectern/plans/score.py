"""Scoring completions against their prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lectern import fixed
from lectern.operators.combine import generation_requests
from lectern.operators.formats import reward_format
from lectern.operators.scoring import group_advantage, score_completions, total_reward


def prompt_requests(df: DataFrame, per_prompt: int = fixed.GENERATIONS_PER_PROMPT) -> DataFrame:
    """Prompts with their gold answers, each as often as completions are wanted of it."""
    return generation_requests(reward_format(df), per_prompt)


def scored_groups(
    completions: DataFrame,
    prompts: DataFrame,
    scored_path: str,
    *,
    keep: Sequence[str] = (),
    plain_gold: bool = False,
) -> DataFrame:
    """Both rewards, their sum, and the advantage within the completions of the same prompt.

    Scores are written to ``scored_path``, in the shared folder, and read back: they are a small part of
    the texts, which are so read once, and a lost executor does not have them scored again.
    """
    scored = total_reward(score_completions(completions, prompts, keep=keep, plain_gold=plain_gold))
    scored.write.mode("overwrite").parquet(scored_path)
    return group_advantage(completions.sparkSession.read.schema(scored.schema).parquet(scored_path))
