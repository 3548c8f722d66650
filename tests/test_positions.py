"""Rows put side by side by position, against DuckDB's positional join."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators.positions import in_files, with_positions, zip_rows
from tests.plans import count


def written(spark, path, rows, files, name):
    spark.range(rows).select(F.col("id").alias(name)).repartitionByRange(files, name).write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("rows", [(500, 500, 3, 11), (77, 500, 1, 6), (400, 13, 5, 2), (0, 9, 1, 2)])
@pytest.mark.parametrize("padded", [False, True])
def test_tables_in_different_files(spark, tmp_path, rows, padded):
    a, b, files_a, files_b = rows
    left = written(spark, tmp_path / "a", a, files_a, "x")
    right = written(spark, tmp_path / "b", b, files_b, "y")
    found = sorted(map(tuple, zip_rows(left, right, padded=padded).select("x", "y").collect()), key=repr)
    sql = f"SELECT x, y FROM read_parquet('{tmp_path}/a/*.parquet') POSITIONAL JOIN read_parquet('{tmp_path}/b/*.parquet')"
    expected = duckdb.sql(sql if padded else f"{sql} WHERE x IS NOT NULL AND y IS NOT NULL").fetchall()
    assert found == sorted(expected, key=repr)


def test_splits_do_not_matter(spark, tmp_path):
    table = written(spark, tmp_path / "a", 20_000, 2, "x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        places = with_positions(table)
        assert places.where("position <> x").count() == 0 and places.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_in_their_order_and_nulls_and_copies(spark):
    rows = [(None, "a"), (1, None), (1, "a"), (1, "a"), (None, None)]
    left = in_files(spark.createDataFrame(rows, "x int, _own string").coalesce(1))
    right = in_files(spark.range(5).select(F.col("id").alias("_file")).orderBy(F.desc("id")))
    found = zip_rows(left, right).orderBy("position").collect()
    assert [(r["x"], r["_own"], r["_file"]) for r in found] == [(x, s, 4 - i) for i, (x, s) in enumerate(rows)]


def test_clashing_columns_are_refused(spark, tmp_path):
    table = written(spark, tmp_path / "a", 5, 1, "x")
    with pytest.raises(ValueError, match="x"):
        zip_rows(table, table)
    with pytest.raises(ValueError, match="x"):
        with_positions(table, "x")


def test_each_table_is_shuffled_once(spark, tmp_path):
    left, right = written(spark, tmp_path / "a", 50, 2, "x"), written(spark, tmp_path / "b", 50, 2, "y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = zip_rows(left, right)
        assert count(df, "hashpartitioning(position") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
