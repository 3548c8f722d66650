"""Row counts along preparation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Groups of rows that one observation tells apart.
MAX_GROUPS = 10_000
_ROOM = 16_384  # a power of two; the sketch counts exactly while less than three quarters of it are taken


def _counts(max_tokens: int) -> list[Column]:
    kept = F.col("n_tokens") <= max_tokens
    return [
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(F.col("empty_prompt")).alias("empty_prompt"),
        F.count_if(~F.col("empty_prompt") & ~F.col("empty_response")).alias("formatted"),
        F.count_if(~kept).alias("too_long"),
        F.count_if(kept).alias("kept"),
    ]


def prep_funnel(df: DataFrame, max_tokens: int, by: str = "source") -> DataFrame:
    """Per source, in one pass: rows loaded, without a prompt, with prompt and response, too long, kept.

    Needs ``n_tokens``, ``empty_prompt`` and ``empty_response``.
    """
    return df.groupBy(by).agg(*_counts(max_tokens))


def observe_funnel(df: DataFrame, max_tokens: int, observation: Observation) -> DataFrame:
    """The same counts over all sources, gathered while the table is written: no extra pass."""
    return df.observe(observation, *_counts(max_tokens))


def observe_rows(df: DataFrame, observation: Observation) -> DataFrame:
    """The number of rows that pass here, gathered while the result is written."""
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))


def observe_groups(df: DataFrame, observation: Observation, by: str = "source") -> DataFrame:
    """The number of rows that pass here for each value of ``by``, gathered while the result is written.

    At most ``MAX_GROUPS`` values, nulls among them: a task keeps a count for each, and the driver their sum. Whatever
    comes behind must not shuffle before the write, else tasks that are run again after a lost executor count twice.
    """
    groups = F.expr(f"approx_top_k(`{by}`, {MAX_GROUPS}, {_ROOM})")
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), groups.alias("groups"))


def group_counts(spark: SparkSession, stages: Mapping[str, Observation], by: str = "source") -> DataFrame:
    """``stage``, the group and ``n_rows`` of all observations, once the result is written.

    A group that a stage left no row of has 0 there. Raises if there were too many groups for exact counts.
    """
    counts = {stage: {g["item"]: g["count"] for g in seen.get["groups"] or []} for stage, seen in stages.items()}
    for stage, seen in stages.items():
        if sum(counts[stage].values()) != seen.get["rows"]:
            raise ValueError(f"{stage}: more than {MAX_GROUPS} values of {by}; count them with groupBy")
    groups = {g: None for of_stage in counts.values() for g in of_stage}
    rows = [(stage, g, of_stage.get(g, 0)) for stage, of_stage in counts.items() for g in groups]
    return spark.createDataFrame(rows, f"stage string, `{by}` string, n_rows bigint")
