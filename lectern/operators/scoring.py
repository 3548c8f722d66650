"""Rewards of completions, totals, group statistics and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern import fixed
from lectern.functions import rewards
from lectern.operators.joins import ROWS_PER_SALT, count_keys, heavy_keys, spread_join

# Name, weight and a function from a completion text to its reward.
RewardSpec = tuple[str, float, Callable[[Column], Column]]


def score_join(
    completions: DataFrame, prompts: DataFrame, *, prompt_id: str = "prompt_id", rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Every completion with the columns of its prompt. ``prompts`` has one row per ``prompt_id``."""
    return spread_join(completions, prompts, prompt_id, rows_per_salt=rows_per_salt)


def with_format_reward(df: DataFrame, completion: str = "completion") -> DataFrame:
    return df.withColumn("format_reward", rewards.format_reward(rewards.completion_text(df, completion)))


def with_correctness_reward(
    df: DataFrame, completion: str = "completion", answer: str = "answer", plain_gold: bool = False
) -> DataFrame:
    text = rewards.completion_text(df, completion)
    return df.withColumn("correctness_reward", rewards.correctness_reward(text, F.col(answer), plain_gold))


def score_completions(
    completions: DataFrame,
    prompts: DataFrame,
    *,
    prompt_id: str = "prompt_id",
    keep: Sequence[str] = (),
    plain_gold: bool = False,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``prompt_id, gen_idx, format_reward, correctness_reward`` and the kept completion columns.

    What the rewards need is extracted on each side first, so the texts themselves are never shuffled.
    """
    text = rewards.completion_text(completions, "completion")
    left = completions.select(
        prompt_id,
        "gen_idx",
        *keep,
        rewards.format_reward(text).alias("format_reward"),
        rewards.predicted_answer(text, plain_gold).alias("_predicted"),
    )
    right = prompts.select(prompt_id, rewards.gold_answer(F.col("answer"), plain_gold).alias("_gold"))
    joined = score_join(left, right, prompt_id=prompt_id, rows_per_salt=rows_per_salt)
    return joined.withColumn("correctness_reward", rewards.match_reward(F.col("_predicted"), F.col("_gold"))).drop(
        "_predicted", "_gold"
    )


def apply_rewards(df: DataFrame, specs: Sequence[RewardSpec], completion: str = "completion") -> DataFrame:
    """One column per reward function and their weighted sum ``reward``."""
    text = rewards.completion_text(df, completion)
    scored = df.withColumns({name: fn(text) for name, _, fn in specs})
    return total_reward(scored, {name: weight for name, weight, _ in specs})


def total_reward(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``reward``: the weighted sum of reward columns, format and correctness by default."""
    if weights is None:
        weights = {"format_reward": 1.0, "correctness_reward": 1.0}
    parts = [F.coalesce(F.col(name), F.lit(0.0)) * F.lit(float(weight)) for name, weight in weights.items()]
    return df.withColumn("reward", reduce(add, parts))


def group_advantage(
    df: DataFrame,
    *,
    prompt_id: str = "prompt_id",
    reward: str = "reward",
    eps: float = fixed.ADVANTAGE_EPS,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``advantage``: how far a reward lies from the mean of its prompt's, in standard deviations.

    Ordinary prompts are windows over their few completions. A prompt with more than a task should hold is not
    gathered: such prompts' statistics are partial sums, a row for each of the few, joined back by broadcast.
    The table is read for the counts and then for the rows: write it first where computing it is dear.
    """
    few = F.broadcast(heavy_keys(count_keys(df, prompt_id), prompt_id, rows_per_salt).select("_heavy_key"))
    heavy = F.col(prompt_id).eqNullSafe(F.col("_heavy_key"))
    group = Window.partitionBy(prompt_id)
    usual = df.join(few, heavy, "left_anti").withColumns({n: c.over(group) for n, c in _statistics(reward).items()})
    large = df.join(few, heavy, "left_semi")
    stats = large.groupBy(prompt_id).agg(*[c.alias(n) for n, c in _statistics(reward).items()])
    stats = F.broadcast(stats.withColumnRenamed(prompt_id, "_heavy_key"))
    both = usual.unionByName(large.join(stats, heavy).drop("_heavy_key"))
    # Adding 0.0 turns a negative zero into zero.
    advantage = (F.col(reward) - F.col("_mean")) / (F.coalesce("_std", F.lit(0.0)) + F.lit(eps)) + F.lit(0.0)
    return both.withColumn("advantage", advantage).drop("_mean", "_std")


def _statistics(reward: str) -> dict[str, Column]:
    return {"_mean": F.avg(reward), "_std": F.stddev_samp(reward)}


def reward_report(df: DataFrame, by: str = "source") -> DataFrame:
    """Per source: completions, mean total, share well formed, share correct."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("completions"),
        F.avg("reward").alias("mean_reward"),
        F.avg((F.col("format_reward") > 0).cast("int")).alias("share_formatted"),
        F.avg((F.col("correctness_reward") > 0).cast("int")).alias("share_correct"),
    )
