"""Tables without a key, put side by side by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lectern.session import scratch_path


def in_files(df: DataFrame) -> DataFrame:
    """The table written once, so that its rows have places: in the order of its partitions, and in each as they are."""
    path = scratch_path(df.sparkSession, "in-files")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_positions(table: DataFrame, name: str = "position") -> DataFrame:
    """Rows of a table read from Parquet with their 0-based place: files by path, then the row in the file.

    The rows of each file are counted without reading a column; prefix sums over these counts, a row for each file,
    are sent to every task. Rows are not moved, and splits may lie anywhere in a file.
    """
    if name in table.columns:
        raise ValueError(f"the table has a column {name} already")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    counts = table.select(file.alias("_file"), row.alias("_row")).groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    ahead = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_file").alias("_of_file"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    placed = table.select(F.struct(*table.columns).alias("_own"), file.alias("_file"), row.alias("_row"))
    placed = placed.join(F.broadcast(offsets), F.col("_file") == F.col("_of_file"))
    return placed.select((F.col("_offset") + F.col("_row")).alias(name), *[F.col("_own")[c].alias(c) for c in table.columns])


def zip_rows(left: DataFrame, right: DataFrame, *, padded: bool = False, name: str = "position") -> DataFrame:
    """Row i of one table beside row i of another, with their ``position``.

    Both are tables read from Parquet (write others with ``in_files``); their files and splits may differ. The rows
    beyond the shorter one are left out, or have nulls beside them if ``padded``. Each table is shuffled once, by
    position, so no task has more than its share of rows whatever they hold.
    """
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"columns of both tables: {', '.join(sorted(shared))}")
    return with_positions(left, name).join(with_positions(right, name), name, "full" if padded else "inner")
