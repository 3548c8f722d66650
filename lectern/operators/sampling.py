"""Reproducible shuffling, caps and global numbering.

Order columns must together identify a row, as ``row_key`` does.

Numbering and large caps never sort a table in one task. Rows fall into buckets that follow the order;
buckets are counted (one small aggregate), their running totals are broadcast (one row per bucket, so
the size is fixed by the bucket count), and rows are numbered within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lectern import fixed

HASH_DIGITS = 4
RANGE_BUCKETS = 8192
KEYS_PER_RANGE = 8


def order_key(row_key: str, seed: int = fixed.SHUFFLE_SEED) -> Column:
    """Shuffle position of a row: depends on its key and the seed, not on partitioning."""
    return F.md5(F.concat(F.col(row_key).cast("string"), F.lit(f"|{seed}")))


def with_order_key(df: DataFrame, row_key: str = "row_key", seed: int = fixed.SHUFFLE_SEED) -> DataFrame:
    return df.withColumn("order_key", order_key(row_key, seed))


def in_key_ranges(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows moved to the partition of their range of ``order_key``.

    The keys are evenly spread hashes, so the ranges are known beforehand. Sorting by a range would first
    sample the table, and compute everything below it twice.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("bigint")
    return df.repartitionById(partitions, F.floor(prefix * partitions / 16**8).cast("int"))


def seeded_shuffle(
    df: DataFrame, row_key: str = "row_key", seed: int = fixed.SHUFFLE_SEED, partitions: int | None = None
) -> DataFrame:
    """The table in shuffled order, the same for any partitioning; keeps ``order_key``.

    Partitions follow each other in the order, as do the files when it is written.
    """
    return in_key_ranges(with_order_key(df, row_key, seed), partitions).sortWithinPartitions("order_key", row_key)


def _with_hash_bucket(df: DataFrame, digits: int = HASH_DIGITS) -> DataFrame:
    """``_bucket``: the first hex digits of ``order_key``, so 16 ** digits even buckets in its order."""
    bucket = F.conv(F.substring("order_key", 1, digits), 16, 10).cast("int")
    return df.withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))


def _with_range_bucket(df: DataFrame, order: list[str], buckets: int = RANGE_BUCKETS) -> DataFrame:
    """``_bucket`` for any order columns: how many split points are not above the row's key.

    Split points come from a fixed number of keys, those with the smallest hashes. They only decide how
    even the buckets are; the numbering is exact whatever they are. Keys with large hashes are dropped
    before the top-k, so that it gathers about twice the keys it keeps and not some from every partition.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    wanted = buckets * KEYS_PER_RANGE
    share = F.xxhash64("key") / F.lit(2.0**64) + 0.5
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    some = df.select(key.alias("key")).where(share * total <= 2 * wanted).orderBy(F.xxhash64("key"), "key").limit(wanted)
    keys = some.agg(F.sort_array(F.collect_list("key")).alias("keys"))
    ordinals = F.sequence(F.lit(1), F.lit(buckets - 1))
    splits = keys.select(
        F.transform(ordinals, lambda i: F.get(F.col("keys"), F.floor(i * F.size("keys") / buckets).cast("int"))).alias("s")
    ).scalar()
    # Binary search: each step moves on if the split point it leads to is not above the key. Written out as
    # columns the steps would run faster, but the optimizer then copies them into each other without end.
    steps = F.array(*[F.lit(2**i) for i in reversed(range((buckets - 1).bit_length()))])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get("_splits", at + step - 1) <= key, at + step).otherwise(at)
    )
    return df.withColumn("_splits", splits).withColumn("_bucket", F.coalesce(found, F.lit(0))).drop("_splits")


def _bucket_totals(df: DataFrame) -> DataFrame:
    """``_bucket``, its ``_rows`` and the rows ``_before`` it. As many rows as there are buckets."""
    counts = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _number(in_buckets: DataFrame, order: list[str], name: str) -> DataFrame:
    totals = _bucket_totals(in_buckets.select("_bucket")).select("_bucket", "_before")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        in_buckets.withColumn("_place", place)
        .join(F.broadcast(totals), "_bucket")
        .withColumn(name, F.col("_before") + F.col("_place") - 1)
        .drop("_bucket", "_before", "_place")
    )


def number_shuffled(
    df: DataFrame, row_key: str = "row_key", seed: int = fixed.SHUFFLE_SEED, name: str = "position", digits: int = HASH_DIGITS
) -> DataFrame:
    """Position of every row in the seeded shuffle, from 0, with ``order_key``."""
    return _number(_with_hash_bucket(with_order_key(df, row_key, seed), digits), ["order_key", row_key], name)


def number_ordered(df: DataFrame, order: list[str], name: str = "position", buckets: int = RANGE_BUCKETS) -> DataFrame:
    """Position of every row in the order of the given columns, from 0."""
    return _number(_with_range_bucket(df, order, buckets), order, name)


def batch_numbering(
    df: DataFrame, order: list[str], batch_size: int = fixed.GENERATION_BATCH, buckets: int = RANGE_BUCKETS
) -> DataFrame:
    """``position`` and ``batch_id`` of contiguous batches; the last one may be short."""
    numbered = number_ordered(df, order, buckets=buckets)
    return numbered.withColumn("batch_id", F.expr(f"position div {int(batch_size)}"))


def _first_rows(in_buckets: DataFrame, n: int, order: list[str], unique: bool) -> DataFrame:
    """The first n rows by a filter: find the n-th key, keep what is not above it.

    The key is found on the order columns alone, by counting buckets and ranking the one bucket the
    n-th row lies in. The wide rows are only filtered, never moved. Where keys may repeat, the rows of the n-th
    key are read once more and as many taken as are missing, by a hash of the row.
    """
    keys = in_buckets.select("_bucket", F.struct(*order).alias("_key"))
    edge = _bucket_totals(keys).where((F.col("_before") < n) & (F.col("_before") + F.col("_rows") >= n))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    placed = keys.join(F.broadcast(edge), "_bucket").withColumn("_place", place + F.col("_before"))
    last = placed.where(F.col("_place") == n).select("_key").scalar()
    rows, key = in_buckets.drop("_bucket"), F.struct(*order)
    if unique:
        return rows.where(F.coalesce(key <= last, F.lit(True)))
    first_of_key = placed.where(F.col("_key") == last).agg(F.min("_place")).scalar()
    copies = rows.where(key == last)
    hashed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    copy = F.row_number().over(Window.orderBy(F.xxhash64(*hashed)))
    taken = copies.withColumn("_copy", copy).where(F.col("_copy") <= n + 1 - first_of_key).drop("_copy")
    return rows.where(F.coalesce(key < last, F.lit(True))).unionByName(taken)


def sample_cap(
    df: DataFrame,
    n: int | None = fixed.MAX_SAMPLES,
    row_key: str = "row_key",
    seed: int = fixed.SHUFFLE_SEED,
    top_k: bool = False,
    digits: int = HASH_DIGITS,
    unique: bool = False,
) -> DataFrame:
    """The first n rows of the seeded shuffle as a set, with ``order_key``; n of 0 or None means all.

    Never more than n, also where keys repeat. ``unique`` says they do not, which spares a second look at the
    rows of the last key.

    ``top_k`` reads the table once instead of three times, but gathers n whole rows of every partition
    in one task: for small tables only.
    """
    keyed = with_order_key(df, row_key, seed)
    if not n or n < 0:
        return keyed
    order = ["order_key", row_key]
    return keyed.orderBy(*order).limit(n) if top_k else _first_rows(_with_hash_bucket(keyed, digits), n, order, unique)


def head_cap(
    df: DataFrame, n: int | None, order: list[str], top_k: bool = False, buckets: int = RANGE_BUCKETS, unique: bool = False
) -> DataFrame:
    """The first n rows in the given order as a set; n of 0 or None means all. ``top_k`` and ``unique`` as above."""
    if not n:
        return df
    if n < 0:
        raise ValueError("a head cannot have fewer than no rows")
    return df.orderBy(*order).limit(n) if top_k else _first_rows(_with_range_bucket(df, order, buckets), n, order, unique)
