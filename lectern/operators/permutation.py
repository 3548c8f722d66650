"""A shuffle that can be addressed: a row's place follows from its position by arithmetic, and back.

Positions below n are numbers of a rectangle that is hardly larger than n; rounds of a Feistel network move them along
its sides in turn, each round by a number that depends on the other side. What comes out beyond n goes through again.
So no row is sorted or moved, and any batch of the shuffled order can be fetched by itself.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, functions as F

from lectern import fixed
from lectern.operators.positions import with_positions

ROUNDS = 4
# Arithmetic modulo this prime stays within a bigint.
PRIME = 2**31 - 1
# Less than one number in the root of n lies beyond n, so from some n on nothing goes through as often as this.
MOST_TURNS = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers for each of twice the rounds."""
    return [tuple(zlib.crc32(f"{seed}:{i}:{j}".encode()) % (PRIME - 2) + 1 for j in range(2)) for i in range(2 * ROUNDS)]


def _sides(n: Column) -> tuple[Column, Column]:
    width = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    return width, F.floor((n + width - 1) / width).cast("bigint")


def _mixed(x: Column, key: tuple[int, int]) -> Column:
    """A number below the prime that depends on all of x."""
    shifted = (x % PRIME + key[0]) % PRIME
    squared = (shifted * shifted) % PRIME
    again = (squared * key[1] + shifted) % PRIME
    return (again * again + key[0]) % PRIME


def _once(x: Column, n: Column, seed: int, back: bool) -> Column:
    width, height = _sides(n)
    sides = [(x % width, width), (F.floor(x / width).cast("bigint"), height)]
    start = F.struct(*[v.alias(f"s{i}") for i, (v, _) in enumerate(sides)])
    # One element per round; the state is a struct, so that no round is copied into the next one's expression.
    rounds = F.array(*[F.struct(F.lit(i % 2).alias("side"), F.lit(k[0]).cast("bigint").alias("a"), F.lit(k[1]).cast("bigint").alias("b")) for i, k in enumerate(round_keys(seed))])
    if back:
        rounds = F.reverse(rounds)

    def step(state: Column, r: Column) -> Column:
        moved, by, size = (F.when(r["side"] == 0, p).otherwise(q) for p, q in ((state["s0"], state["s1"]), (state["s1"], state["s0"]), (width, height)))
        amount = _mixed(by, (r["a"], r["b"])) % size
        after = F.pmod(moved - amount, size) if back else F.pmod(moved + amount, size)
        return F.struct(F.when(r["side"] == 0, after).otherwise(state["s0"]).alias("s0"), F.when(r["side"] == 1, after).otherwise(state["s1"]).alias("s1"))

    return F.aggregate(rounds, start, step, lambda s: s["s1"] * width + s["s0"])


def _walked(x: Column, n: Column, seed: int, back: bool) -> Column:
    width, height = _sides(n)
    turns = F.sequence(F.lit(1), F.least(width * height - n, F.lit(MOST_TURNS)).cast("int") + 1)
    return F.aggregate(turns, F.lit(-1).cast("bigint"), lambda at, i: F.when((i > 1) & (at < n), at).otherwise(_once(F.when(i == 1, x).otherwise(at), n, seed, back)))


def place_of(position: Column, n: Column, seed: int = fixed.SHUFFLE_SEED) -> Column:
    """Where the row at a 0-based position stands in the shuffle of n rows. A bigint; n is below 2 to the 60."""
    return _walked(position.cast("bigint"), n.cast("bigint"), seed, back=False)


def position_of(place: Column, n: Column, seed: int = fixed.SHUFFLE_SEED) -> Column:
    """The position of the row at a place of the shuffle."""
    return _walked(place.cast("bigint"), n.cast("bigint"), seed, back=True)


def fetch_batch(table: DataFrame, number: int, batch_size: int, seed: int = fixed.SHUFFLE_SEED) -> DataFrame:
    """One batch of the shuffled order of a table read from Parquet, with ``place``: its rows are looked up, none is sorted.

    The last batch may be short, and beyond it there are none. The batch's positions, as many as it has rows, are
    sent to every task.
    """
    n = table.select(F.col("_metadata.row_index").alias("i")).count()
    first, last = number * batch_size, min((number + 1) * batch_size, n)
    places = table.sparkSession.range(first, max(first, last)).select(F.col("id").alias("place"))
    wanted = places.select("place", position_of(F.col("place"), F.lit(max(n, 1)), seed).alias("position"))
    return with_positions(table).join(F.broadcast(wanted), "position").drop("position")
