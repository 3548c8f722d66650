"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lectern.llm.landing import columns_of, landed, whole_row
from lectern.operators.sampling import number_ordered

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"
# The shuffled order and the finish times are cut into so many ranges, whose sums are small tables.
RANGE_DIGITS = 3
TIME_RANGES = 32768


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: one row per source.

    Sources stand by code point, null last, and take the weights in turn. The budget is dealt out by weight; a
    source that gets more than ``copies`` times its words keeps that many, and the rest is dealt out again. With
    the sources in the order of how soon they are full, those that end up full are the first few: the rest's
    share at each place is known from running sums, and the full ones end where it fits all that follow.

    Sources are numbered in ranges over many tasks. Running sums are over different fillings, not sources: words over
    weight. Sources add up to the words, so of n words there are fewer than three times the root of 2 n of them.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = landed(by_source.withColumn("is_null", F.col("source").isNull()), "sources")
    placed = number_ordered(by_source, ["is_null", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("weight", weight).withColumn("most", copies * F.col("source_size"))
    weighed = landed(weighed.withColumn("filling", F.col("most") / F.col("weight")), "weighed")
    fillings = weighed.groupBy("filling").agg(*[F.sum(c).alias(c) for c in ("source_size", "most", "weight")])
    filling = Window.orderBy("filling")
    before, after = (filling.rowsBetween(*r) for r in ((Window.unboundedPreceding, -1), (Window.currentRow, Window.unboundedFollowing)))
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = fillings.select("filling", (left / F.sum("weight").over(after)).alias("share"))
    level = share.where(F.col("share") <= F.col("filling")).agg(F.min_by("share", "filling")).scalar()
    most = F.col("most").cast("double")
    return weighed.select("source", "source_size", F.least(most, F.coalesce(F.col("weight") * level, most)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """``doc_id, source, size, source_size, target, n_copies, taken`` of every row.

    Each source is a queue of its documents in the order of a hash of ``doc_id``, all of them once, then again.
    A document's virtual finish time is the words of its source up to its end over the source's target. All
    queues are served in the order of finish times until the words of all targets are spent; the document that
    would overrun is left, and all after it. So a source gets its target up to about one document. ``taken`` is
    ``n_copies`` (0 to ``copies``) times the size.

    Running sums never pass through one task: queues and times are cut into ranges, the ranges' sums are summed
    up in order, and rows only within their range. The order, and so the result, depends on the rows alone.
    Equal finish times go by source and order. A null text, or one without words, has size 0 and is not taken;
    a null source is a source; rows without ``doc_id``, and rows that repeat, are served one after another. An
    empty table gives none. Only ``doc_id, text`` and ``source`` are read.
    """
    shown = ["doc_id", "source", "size", "source_size", "target", "n_copies", (F.col("n_copies") * F.col("size")).alias("taken")]
    return _copies(docs, weights, budget, copies).select(*shown)


def _copies(docs: DataFrame, weights: Sequence[int], budget: float, copies: int) -> DataFrame:
    """Per row ``n_copies``, and ``_tie`` and ``_place`` to know it by among rows of its ``doc_id`` and source."""
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"),
        F.xxhash64("text").alias("_tie"),
    ).withColumn("_range", F.conv(F.substring("_order", 1, RANGE_DIGITS), 16, 10).cast("int"))
    own = landed(own, "sizes")
    targets = landed(source_targets(own.select("source", "size"), weights, budget, copies), "targets")

    # Words before each range of a queue, then before each document.
    ranges = own.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    queue = Window.partitionBy("source", "_range").orderBy("_order", "doc_id", "_tie")
    upto = own.withColumn("_upto", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    upto = upto.withColumn("_place", F.row_number().over(queue))
    placed = _same_source(upto, ranges, ["_range"]).withColumn("_end", F.col("_before") + F.col("_upto"))
    placed = landed(_same_source(placed.drop("_upto", "_before", "_range"), targets, []), "placed")

    # The same for finish times over all queues: only the range in which the budget ends is looked into.
    order = ["_finish", "source", "_order", "doc_id", "_tie", "_place", "_turn"]
    turn = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_turn")
    turns = placed.where("size > 0").select("*", turn).withColumn("_finish", _finish(F.col("_turn")))
    turns = turns.select(*order, "size").withColumn("_slot", _slot(F.col("_finish"), copies))
    slots = turns.groupBy("_slot").agg(F.sum("size").alias("_words"))
    served = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = targets.agg(F.floor(F.sum("target") + 0.5))
    over = slots.withColumn("_after", F.sum("_words").over(served)).where(F.col("_after") > total.scalar())
    edge = landed(over.orderBy("_slot").limit(1).select("_slot", (F.col("_after") - F.col("_words")).alias("_before")), "edge")
    cut, slot = _first_beyond(turns, edge, order, total), edge.agg(F.min("_slot")).scalar()
    taken = [_is_taken(t, copies, cut, slot, order) for t in range(copies)]
    return placed.withColumn("n_copies", sum(taken[1:], taken[0]))


def _first_beyond(turns: DataFrame, edge: DataFrame, order: list[str], total: DataFrame) -> Column:
    """The first turn of the edge's slot that overruns the budget; of nulls if none does.

    Very many turns may have one finish time, and so lie in one slot. They are cut into ranges of the whole order,
    and only the range in which the budget ends is summed up row by row.
    """
    within = turns.join(F.broadcast(edge), "_slot").repartitionByRange(*order)  # the edge is one row
    within = landed(within.withColumn("_part", F.spark_partition_id()), "within")
    parts = within.groupBy("_part").agg(F.sum("size").alias("_words"), F.min("_before").alias("_before"))
    served = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_after", F.col("_before") + F.sum("_words").over(served))
    last = parts.where(F.col("_after") > total.scalar()).orderBy("_part").limit(1)
    last = landed(last.select("_part", (F.col("_after") - F.col("_words")).alias("_ahead")), "last")
    running = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    beyond = within.join(F.broadcast(last), "_part").withColumn("_served", F.col("_ahead") + running)
    return beyond.where(F.col("_served") > total.scalar()).agg(F.min(F.struct(*order))).scalar()


def _same_source(left: DataFrame, right: DataFrame, also: list[str]) -> DataFrame:
    """Joined on the source, null being one, and the other columns."""
    right = right.withColumnRenamed("source", "_source")
    for c in also:
        right = right.withColumnRenamed(c, f"_right{c}")
    on = left["source"].eqNullSafe(right["_source"])
    for c in also:
        on &= left[c] == right[f"_right{c}"]
    return left.join(right, on).drop("_source", *[f"_right{c}" for c in also])


def _finish(turn: Column) -> Column:
    return (F.col("_end") + turn * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))


def _slot(finish: Column, copies: int) -> Column:
    """Ranges of finish times. A source is served to its target at 1; later times share the last range."""
    return F.least(F.floor(finish * TIME_RANGES), F.lit(copies * TIME_RANGES)).cast("int")


def _is_taken(turn: int, copies: int, cut: Column, slot: Column, order: list[str]) -> Column:
    values = {"_finish": _finish(F.lit(turn)), "_turn": F.lit(turn)}
    at = _slot(values["_finish"], copies)
    key = F.struct(*[values.get(c, F.col(c)).alias(c) for c in order])
    early = slot.isNull() | (at < slot) | ((at == slot) & F.coalesce(key < cut, F.lit(True)))
    return F.when((F.col("size") > 0) & early, 1).otherwise(0)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Rows equal in ``doc_id, source`` and ``text`` are told apart by the hash of all their columns. Texts are
    shuffled once, to meet their number of copies. Nulls, long texts, ties and repeated rows are as in ``mix``; other
    columns may have any names. An empty table gives none.
    """
    counts = _copies(docs, weights, budget, copies)
    same = [F.col("doc_id"), F.col("source"), F.col("_tie")]
    counts = counts.withColumn("_row", F.row_number().over(Window.partitionBy(*same).orderBy("_place")))
    counts = counts.select(*[c.alias(f"_of_{i}") for i, c in enumerate(same)], F.col("_row").alias("_of_row"), "n_copies").where("n_copies > 0")
    own = [F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.xxhash64("text")]
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64(*hashed)))
    numbered = docs.select(whole_row(docs).alias("_own"), *[c.alias(f"_is_{i}") for i, c in enumerate(own)], row.alias("_is_row"))
    on = F.lit(True)
    for i in (*range(len(own)), "row"):
        on &= F.col(f"_is_{i}").eqNullSafe(F.col(f"_of_{i}"))
    joined = numbered.join(counts, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return joined.select(*columns_of("_own", docs))
