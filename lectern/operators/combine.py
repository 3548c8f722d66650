"""Putting sources together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lectern import fixed


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Already formatted tables one after the other, duplicates kept, columns matched by name."""
    if not tables:
        raise ValueError("no table given")
    return reduce(DataFrame.unionByName, tables)


def union_align(tables: Sequence[DataFrame]) -> DataFrame:
    """Raw tables of different shapes; a column a table lacks is null there."""
    if not tables:
        raise ValueError("no table given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def generation_requests(prompts: DataFrame, per_prompt: int = fixed.GENERATIONS_PER_PROMPT) -> DataFrame:
    """Every prompt ``per_prompt`` times, numbered by ``gen_idx``."""
    return prompts.withColumn("gen_idx", F.explode(F.sequence(F.lit(0), F.lit(per_prompt - 1))))
