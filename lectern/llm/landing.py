"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.session import scratch_path


def landed(df: DataFrame, name: str) -> DataFrame:
    """The table written once and read back: it is not computed again, whatever executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def whole_row(df: DataFrame) -> Column:
    """All columns as one value, so that columns added beside it clash with none, whatever their names."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def columns_of(row: str, df: DataFrame) -> list[Column]:
    """The columns of ``df`` out of the value that ``whole_row`` made."""
    return [F.col(row)[c].alias(c) for c in df.columns]
