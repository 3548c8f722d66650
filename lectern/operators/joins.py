"""Equi-joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROWS_PER_SALT = 1_000_000
MAX_HEAVY_KEYS = 10_000


def heavy_keys(
    counts: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT, max_keys: int = MAX_HEAVY_KEYS
) -> DataFrame:
    """``_heavy_key, _salts`` of the keys with more rows than a task should hold.

    ``counts`` has one row per key with its ``n_rows``. A task holds ``rows_per_salt`` rows, or one in
    ``max_keys`` of all rows if that is more. Fewer than ``max_keys`` keys can have more rows than that, so the
    result may be broadcast, and none is left out.
    """
    share = F.greatest(F.lit(rows_per_salt), F.ceil(counts.agg(F.sum("n_rows")).scalar() / max_keys))
    return counts.where(F.col("n_rows") > share).select(
        F.col(key).alias("_heavy_key"), F.ceil(F.col("n_rows") / share).cast("int").alias("_salts")
    )


def count_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    how: str = "inner",
    counts: DataFrame | None = None,
    null_safe: bool = False,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``left`` joined to ``right``, where a few keys of ``left`` may be very frequent.

    Left rows of a heavy key are dealt out over its salts by a hash of the row; the right rows of that key
    are repeated once per salt. All other keys have one salt and cost nothing extra. Exact copies of one row
    share a salt; both sides are freshly shuffled, so adaptive execution can split those by map output.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can repeat the right side")
    if counts is None:
        counts = count_keys(left, key)
    heavy = F.broadcast(heavy_keys(counts, key, rows_per_salt))

    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b) if null_safe else a == b

    salts = F.coalesce("_salts", F.lit(1))
    # A null key meets no other, so its rows may lie anywhere.
    own_salts = salts if null_safe else F.when(F.col(key).isNull(), F.lit(MAX_HEAVY_KEYS)).otherwise(salts)
    left_salted = (
        left.join(heavy, same(F.col(key), F.col("_heavy_key")), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*left.columns), own_salts).cast("int"))
        .drop("_heavy_key", "_salts")
    )
    right_salted = (
        right.join(heavy, same(F.col(key), F.col("_heavy_key")), "left")
        .withColumn("_right_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_heavy_key", "_salts")
        .withColumnRenamed(key, "_right_key")
    )
    on = same(F.col(key), F.col("_right_key")) & (F.col("_salt") == F.col("_right_salt"))
    return left_salted.join(right_salted, on, how).drop("_salt", "_right_salt", "_right_key")
