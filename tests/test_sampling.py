"""Order, caps and numbering: brute force, any partitioning, plans."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import sampling
from tests.plans import count, plan_text

ROWS = [(f"k{i * 7919 % 1000:04d}", i % 13) for i in range(700)]
PARTITIONS = [1, 4, 37]


def table(spark, partitions=1):
    return spark.createDataFrame(ROWS, "row_key string, v int").repartition(partitions)


def shuffled_keys(seed=42):
    return sorted((k for k, _ in ROWS), key=lambda k: (hashlib.md5(f"{k}|{seed}".encode()).hexdigest(), k))


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_shuffle(spark, partitions):
    rows = sampling.seeded_shuffle(table(spark, partitions), partitions=partitions).collect()
    assert [r["row_key"] for r in rows] == shuffled_keys()


def test_shuffle_depends_on_seed(spark):
    assert [r["row_key"] for r in sampling.seeded_shuffle(table(spark), seed=7).collect()] == shuffled_keys(7)


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_shuffled_positions(spark, partitions):
    rows = sampling.number_shuffled(table(spark, partitions), digits=2).collect()
    assert {r["row_key"]: r["position"] for r in rows} == {k: i for i, k in enumerate(shuffled_keys())}


@pytest.mark.parametrize("partitions", PARTITIONS)
@pytest.mark.parametrize("buckets", [2, 50, 4096])
def test_batches(spark, partitions, buckets):
    rows = sampling.batch_numbering(table(spark, partitions), ["row_key"], 4, buckets).collect()
    assert {r["row_key"]: r["position"] for r in rows} == {k: i for i, k in enumerate(sorted(k for k, _ in ROWS))}
    assert all(r["batch_id"] == r["position"] // 4 for r in rows)


def test_batches_by_two_columns(spark):
    rows = sampling.batch_numbering(table(spark), ["v", "row_key"], 10, 16).collect()
    assert {r["row_key"]: r["position"] for r in rows} == {k: i for i, (_, k) in enumerate(sorted((v, k) for k, v in ROWS))}


@pytest.mark.parametrize("n", [1, 10, 400, 699, 700, 701])
@pytest.mark.parametrize("top_k", [True, False])
def test_sample_cap(spark, n, top_k):
    rows = sampling.sample_cap(table(spark, 4), n, top_k=top_k, digits=2).collect()
    assert {r["row_key"] for r in rows} == set(shuffled_keys()[:n])
    assert len(rows) == min(n, 700)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 9, 30])
def test_caps_are_exact_where_keys_repeat(spark, n):
    df = spark.createDataFrame([(f"k{i // 5}", i) for i in range(20)] + [("k1", 5)] * 3, "row_key string, v int")
    for capped in (sampling.sample_cap(df, n, digits=1), sampling.head_cap(df, n, ["row_key"], buckets=4)):
        rows = [(r["row_key"], r["v"]) for r in capped.collect()]
        assert len(rows) == min(n, 23)
    assert {k for k, _ in rows} <= set(sorted(["k0"] * 5 + ["k1"] * 8 + ["k2"] * 5 + ["k3"] * 5)[:n])
    with pytest.raises(ValueError):
        sampling.head_cap(df, -1, ["row_key"])


@pytest.mark.parametrize("n", [0, None])
def test_no_cap(spark, n):
    assert sampling.sample_cap(table(spark), n).count() == 700
    assert sampling.head_cap(table(spark), n, ["row_key"]).count() == 700


@pytest.mark.parametrize("n", [1, 333, 900])
@pytest.mark.parametrize("top_k", [True, False])
def test_head_cap(spark, n, top_k):
    rows = sampling.head_cap(table(spark, 4), n, ["row_key"], top_k=top_k, buckets=32).collect()
    assert {r["row_key"] for r in rows} == set(sorted(k for k, _ in ROWS)[:n])


def test_empty_table(spark):
    empty = table(spark).where("false")
    assert sampling.batch_numbering(empty, ["row_key"]).collect() == []
    assert sampling.sample_cap(empty, 5).collect() == []


def test_only_bucket_totals_meet_in_one_partition(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    plan = plan_text(sampling.number_shuffled(docs, "doc_id"))
    assert plan.count("SinglePartition") == 1
    below = plan[plan.index("SinglePartition") :]
    assert re.search(r"HashAggregate\(keys=\[_bucket#\d+\], functions=\[count\(1\)\]\)", below)
    assert "text" not in below


def test_counting_pass_reads_only_the_key(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    plan = plan_text(sampling.sample_cap(docs, 50, "doc_id", unique=True))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert sum("text" in s for s in schemas) == 1 and all(s == "struct<doc_id:bigint>" for s in schemas if "text" not in s)
    wide = plan[: plan.index("Subquery")]
    assert "Exchange" not in wide


def test_small_cap_is_a_top_k(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert count(sampling.sample_cap(docs, 50, "doc_id", top_k=True), "TakeOrderedAndProject") == 1


def test_shuffle_is_one_exchange_without_sampling(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    plan = plan_text(sampling.seeded_shuffle(docs, "doc_id"))
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan


def test_shuffle_ranges_are_even(spark):
    df = sampling.seeded_shuffle(spark.range(20000), "id", partitions=8)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)
