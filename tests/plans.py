"""Looking into physical plans."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def count(df: DataFrame, node: str) -> int:
    return sum(node in line for line in plan_text(df).splitlines())
