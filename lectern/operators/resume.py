"""What is left to do after an interrupted run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pending_rows(inputs: DataFrame, finished: DataFrame, key: str = "row_key") -> DataFrame:
    """Input rows whose key is not among the finished ones. Only the finished keys are read."""
    return inputs.join(finished.select(key), key, "left_anti")
