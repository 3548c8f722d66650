"""A ledger of the parts of a job that are done, so that a later run does the rest.

A part is written to a folder of its own, and then entered. Whoever reads goes by the entries: what an interrupted
run left half written is never seen, and what it entered is never done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ENTRY = "run string, part string, n_rows bigint, n_failed bigint"


class Ledger:
    """Parts below ``path/generated``, entries below ``path/ledger``; one run at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.run = spark, path, uuid.uuid4().hex
        self._enter(None, 0, 0)  # so that there is a table to read from

    def _enter(self, part: str | None, n_rows: int, n_failed: int) -> None:
        entry = self.spark.createDataFrame([(self.run, part, n_rows, n_failed)], ENTRY)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def entries(self) -> DataFrame:
        """``run, part, n_rows, n_failed`` of every part that is done."""
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/ledger").where(F.col("part").isNotNull())

    def folder(self, part: str) -> str:
        return f"{self.path}/generated/part={part}"

    def commit(self, df: DataFrame, number: int, failed: str = "failed") -> None:
        """Write a part and enter it. Until the entry is there, the part is not."""
        part = f"{self.run}-{number}"
        df.write.mode("overwrite").partitionBy(failed).parquet(self.folder(part))
        written = self.spark.read.schema(T.StructType([*df.schema])).parquet(self.folder(part))
        n_rows, n_failed = written.agg(F.count(F.lit(1)), F.count_if(failed)).first()
        self._enter(part, n_rows, n_failed)

    def rows(self, schema: T.StructType) -> DataFrame:
        """The rows of all parts that are done, with their ``part``. Other folders are not read."""
        parts = [r["part"] for r in self.entries().select("part").collect()]  # one for each commit, not for rows
        schema = T.StructType([*schema, T.StructField("part", T.StringType())])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/generated").where(F.col("part").isin(parts))


def unanswered(inputs: DataFrame, rows: DataFrame, key: Sequence[str], *, ask_failed_again: bool = False) -> DataFrame:
    """The inputs whose key is in no row, or only in failed ones if these are to be asked again."""
    done = rows.where(~F.col("failed")) if ask_failed_again else rows
    return inputs.join(done.select(*key), list(key), "left_anti")
