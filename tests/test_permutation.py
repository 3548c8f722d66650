"""The addressable shuffle is a permutation, for every size, and can be turned back."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.permutation import fetch_batch, place_of, position_of


def test_bijective_for_every_size(spark):
    sizes = [*range(1, 700), 1000, 1024, 4095, 4096, 4097, 9999, 10_000, 30_011]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").repartition(16)
    rows = rows.select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    rows = rows.withColumn("place", place_of(F.col("i"), F.col("n"))).withColumn("back", position_of(F.col("place"), F.col("n")))
    wrong = F.count_if((F.col("place") < 0) | (F.col("place") >= F.col("n")) | (F.col("back") != F.col("i")))
    bad = rows.groupBy("n").agg(F.countDistinct("place").alias("d"), wrong.alias("wrong")).where("d <> n OR wrong > 0")
    assert bad.collect() == []


def test_large_positions_and_seeds(spark):
    n = 10**15 + 7
    rows = spark.range(500).select((F.col("id") * 1_999_999_999_993 + 11).alias("i"))
    places = {}
    for seed in (1, 2):
        found = rows.select("i", place_of(F.col("i"), F.lit(n), seed).alias("p")).withColumn("b", position_of(F.col("p"), F.lit(n), seed)).collect()
        assert all(r["b"] == r["i"] and 0 <= r["p"] < n for r in found)
        places[seed] = [r["p"] for r in found]
    assert sum(a == b for a, b in zip(places[1], places[2])) < 3


def test_neighbours_are_spread(spark):
    n = 20_000
    found = [r["p"] for r in spark.range(n).select(place_of(F.col("id"), F.lit(n)).alias("p")).collect()]
    first = sum(p < n // 2 for p in found[: n // 10])
    assert abs(first - n // 20) < 150
    assert sum(abs(a - b) < n // 100 for a, b in zip(found, found[1:])) < n * 0.03


def test_batches_are_the_shuffled_order(spark, tmp_path):
    spark.range(103).repartition(4).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    batches = [fetch_batch(table, i, 10).collect() for i in range(12)]
    assert [len(b) for b in batches] == [10] * 10 + [3, 0]
    assert sorted(r["place"] for b in batches for r in b) == list(range(103))
    assert sorted(r["id"] for b in batches for r in b) == list(range(103))
    assert "Sort" not in fetch_batch(table, 1, 10)._jdf.queryExecution().executedPlan().toString().split("Window")[0]
