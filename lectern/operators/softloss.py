"""Soft-label loss of stored student and teacher logits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern import fixed
from lectern.functions import arrays


def token_losses(
    logits: DataFrame, temperature: float = fixed.LOSS_TEMPERATURE, *, wide_vocabulary: bool = False
) -> DataFrame:
    """Per position: ``soft_ce`` (teacher to student), ``teacher_entropy``, ``kl`` and ``hard_ce``.

    Input: ``example_id, pos, label, student, teacher``. Both arrays are cut to the shorter one for the
    soft part; the hard part sees the whole student array. Ignored positions have null losses, and
    their arrays are dropped before anything is computed. So have ``refused`` ones: a counted position whose
    arrays are null or empty, or hold a null or NaN.

    ``wide_vocabulary`` computes the same in Arrow batches, faster from some thousand entries on.
    """
    labelled = F.coalesce(F.col("label") != fixed.IGNORED_LABEL, F.lit(False))
    sound = F.lit(True)
    for side in ("student", "teacher"):
        bad = F.exists(F.col(side).cast("array<double>"), lambda x: x.isNull() | F.isnan(x))
        sound &= F.coalesce((F.size(side) > 0) & ~bad, F.lit(False))
    counted = labelled & sound
    masked = logits.select(
        "example_id",
        "pos",
        (labelled & ~sound).alias("refused"),
        F.when(counted, F.col("label")).alias("label"),
        F.when(counted, F.col("student").cast("array<double>")).alias("student"),
        F.when(counted, F.col("teacher").cast("array<double>")).alias("teacher"),
    )
    losses = _losses_in_batches if wide_vocabulary else _losses_in_sql
    return losses(masked, float(temperature)).withColumn("kl", F.col("soft_ce") - F.col("teacher_entropy"))


def _losses_in_sql(masked: DataFrame, temperature: float) -> DataFrame:
    size = F.least(F.size("student"), F.size("teacher"))

    def softened(column: str) -> Column:
        return F.transform(F.slice(column, 1, size), lambda x: x / F.lit(temperature))

    soft = masked.select(
        "*",
        F.array_max("student").alias("raw_max"),
        F.get("student", F.col("label")).alias("raw_at_label"),
        softened("student").alias("s"),
        softened("teacher").alias("t"),
    ).select("*", F.array_max("s").alias("s_max"), F.array_max("t").alias("t_max"))
    sums = soft.select(
        "*",
        arrays.sum_exp_shifted(F.col("s"), F.col("s_max")).alias("s_sum"),
        arrays.sum_exp_shifted(F.col("student"), F.col("raw_max")).alias("raw_sum"),
        arrays.exp_shifted(F.col("t"), F.col("t_max")).alias("t_exp"),
    ).select("*", arrays.array_sum(F.col("t_exp")).alias("t_sum"))
    soft_ce = F.col("s_max") + F.log("s_sum") - arrays.dot(F.col("t_exp"), F.col("s")) / F.col("t_sum")
    entropy = F.col("t_max") + F.log("t_sum") - arrays.dot(F.col("t_exp"), F.col("t")) / F.col("t_sum")
    hard_ce = F.col("raw_max") + F.log("raw_sum") - F.col("raw_at_label")
    return sums.select(
        "example_id", "pos", "refused", soft_ce.alias("soft_ce"), entropy.alias("teacher_entropy"), hard_ce.alias("hard_ce")
    )


def _losses_in_batches(masked: DataFrame, temperature: float) -> DataFrame:
    @F.arrow_udf("soft_ce double, teacher_entropy double, hard_ce double")
    def losses(labels: pa.Array, students: pa.Array, teachers: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        def log_sum_exp(x):
            return x.max() + np.log(np.exp(x - x.max()).sum())

        out = []
        for label, student, teacher in zip(labels.to_pylist(), students, teachers):
            if not (student.is_valid and teacher.is_valid):
                out.append((None, None, None))
                continue
            raw, t = student.values.to_numpy(), teacher.values.to_numpy() / temperature
            s, t = raw[: len(t)] / temperature, t[: len(raw)]
            log_p = t - log_sum_exp(t)
            p = np.exp(log_p)
            at_label = raw[label] if label is not None and 0 <= label < len(raw) else None
            out.append((log_sum_exp(s) - p @ s, -(p @ log_p), None if at_label is None else log_sum_exp(raw) - at_label))
        return pa.StructArray.from_arrays(
            [pa.array(column, pa.float64()) for column in zip(*out)], ["soft_ce", "teacher_entropy", "hard_ce"]
        )

    with_losses = masked.select("example_id", "pos", "refused", losses("label", "student", "teacher").alias("l"))
    return with_losses.select("example_id", "pos", "refused", "l.soft_ce", "l.teacher_entropy", "l.hard_ce")


def soft_label_loss(
    logits: DataFrame,
    temperature: float = fixed.LOSS_TEMPERATURE,
    alpha: float = fixed.LOSS_ALPHA,
    *,
    wide_vocabulary: bool = False,
) -> DataFrame:
    """Per example: counted tokens, mean losses scaled by the squared temperature, and their blend.

    ``soft_ce`` is what training minimises; ``kl`` is the same less the teacher's entropy. An example
    without counted tokens has losses of 0. ``n_refused`` counts positions that could not be judged, ``n_hard``
    those with a hard loss: a counted position whose label is not among its entries has none.
    """
    return _by_example(token_losses(logits, temperature, wide_vocabulary=wide_vocabulary), temperature, alpha)


def _by_example(losses: DataFrame, temperature: float, alpha: float) -> DataFrame:
    scale = float(temperature) ** 2

    def mean(column: str) -> Column:
        return F.coalesce(F.avg(column), F.lit(0.0))

    per_example = losses.groupBy("example_id").agg(
        F.count("soft_ce").alias("n_tokens"),
        F.count_if("refused").alias("n_refused"),
        F.count("hard_ce").alias("n_hard"),
        (mean("soft_ce") * scale).alias("soft_ce"),
        (mean("kl") * scale).alias("kl"),
        mean("hard_ce").alias("hard_ce"),
    )
    return per_example.withColumn("loss", alpha * F.col("soft_ce") + (1 - alpha) * F.col("hard_ce"))


def loss_total(losses: DataFrame, alpha: float = fixed.LOSS_ALPHA) -> DataFrame:
    """One row for the whole table: every token weighs the same, however long its example is.

    Each loss is a mean over the tokens that have it, and their blend is of these means.
    """

    def mean(column: str, count: str) -> Column:
        return F.coalesce(F.sum(F.col(column) * F.col(count)) / F.nullif(F.sum(count), F.lit(0)), F.lit(0.0)).alias(column)

    total = losses.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        *[mean(c, n) for c, n in (("soft_ce", "n_tokens"), ("kl", "n_tokens"), ("hard_ce", "n_hard"))],
    )
    return total.withColumn("loss", alpha * F.col("soft_ce") + (1 - alpha) * F.col("hard_ce"))


# Logits are summed up as powers of e within bands of this width, so that no term leaves the range of a double.
BAND = 64.0


def entry_losses(entries: DataFrame, temperature: float = fixed.LOSS_TEMPERATURE, *, unique: bool = False) -> DataFrame:
    """``token_losses`` of ``example_id, pos, label, token_id, student, teacher``, one row per vocabulary entry.

    No distribution is gathered: a position's entries are summed up in bands of logits, before they are shuffled
    and after. Its few bands are then brought to the highest one. Band sums of one position can be merged in any
    order, so a position of any width may lie in many splits.

    The entries kept for a position stand for the whole distribution, as in ``pack_logits``: copies of an entry
    count once, a label outside them has no hard loss, and a position with a null or NaN among them is refused.
    ``unique`` says that there are no copies, which saves a shuffle of all entries.
    """
    columns = [F.col(c).cast("double").alias(c) for c in ("student", "teacher")]
    rows = entries.select("example_id", "pos", "label", "token_id", *columns)
    if not unique:
        rows = rows.distinct()
    labelled = F.coalesce(F.col("label") != fixed.IGNORED_LABEL, F.lit(False))
    sound = F.lit(True)
    for side in ("student", "teacher"):
        sound &= F.col(side).isNotNull() & ~F.isnan(side)
    s, t = F.col("student") / F.lit(float(temperature)), F.col("teacher") / F.lit(float(temperature))
    rows = rows.select(
        "example_id", "pos", "label", labelled.alias("labelled"), sound.alias("sound"), (F.col("token_id") == F.col("label")).alias("at_label"),
        F.col("student").alias("raw"), s.alias("s"), t.alias("t"),
    ).select("*", *[F.floor(F.col(c) / BAND).alias(f"{c}_band") for c in ("raw", "s", "t")])

    def power(c: str) -> Column:
        return F.exp(F.col(c) - F.col(f"{c}_band") * BAND)

    key = ["example_id", "pos", "label"]
    # Entries that are not counted only say that they are there.
    used = [F.when(F.col("labelled") & F.col("sound"), F.col(f"{c}_band")).alias(f"{c}_band") for c in ("raw", "s", "t")]
    bands = rows.withColumns({f"{c}_band": u for c, u in zip(("raw", "s", "t"), used)}).groupBy(*key, "raw_band", "s_band", "t_band").agg(
        F.first("labelled").alias("labelled"),
        F.bool_and("sound").alias("sound"),
        F.min(F.when(F.col("at_label"), F.col("raw"))).alias("raw_at_label"),
        F.sum(power("raw")).alias("raw_sum"),
        F.sum(power("s")).alias("s_sum"),
        F.sum(power("t")).alias("t_sum"),
        F.sum(power("t") * F.col("s")).alias("ts_sum"),
        F.sum(power("t") * F.col("t")).alias("tt_sum"),
    )
    sums = ("raw_sum", "s_sum", "t_sum", "ts_sum", "tt_sum")
    positions = bands.groupBy(*key).agg(
        F.first("labelled").alias("labelled"),
        F.bool_and("sound").alias("sound"),
        F.min("raw_at_label").alias("raw_at_label"),
        *[F.max(f"{c}_band").alias(f"{c}_top") for c in ("raw", "s", "t")],
        F.collect_list(F.struct("raw_band", "s_band", "t_band", *sums)).alias("bands"),
    )

    def total(column: str, band: str) -> Column:
        def scaled(b: Column) -> Column:
            return b[column] * F.exp((b[f"{band}_band"] - F.col(f"{band}_top")) * BAND)

        return F.aggregate("bands", F.lit(0.0), lambda acc, b: acc + F.coalesce(scaled(b), F.lit(0.0)))

    def log_sum(c: str) -> Column:
        return F.col(f"{c}_top") * BAND + F.log(F.col(f"{c}_sum"))

    positions = positions.withColumns({"raw_sum": total("raw_sum", "raw"), "s_sum": total("s_sum", "s"), **{c: total(c, "t") for c in ("t_sum", "ts_sum", "tt_sum")}})
    counted = F.col("labelled") & F.col("sound")
    return positions.select(
        "example_id",
        "pos",
        (F.col("labelled") & ~F.col("sound")).alias("refused"),
        F.when(counted, log_sum("s") - F.col("ts_sum") / F.col("t_sum")).alias("soft_ce"),
        F.when(counted, log_sum("t") - F.col("tt_sum") / F.col("t_sum")).alias("teacher_entropy"),
        F.when(counted, log_sum("raw") - F.col("raw_at_label")).alias("hard_ce"),
    ).withColumn("kl", F.col("soft_ce") - F.col("teacher_entropy"))


def soft_label_loss_of_entries(
    entries: DataFrame, temperature: float = fixed.LOSS_TEMPERATURE, alpha: float = fixed.LOSS_ALPHA, *, unique: bool = False
) -> DataFrame:
    """``soft_label_loss`` over one row per vocabulary entry."""
    return _by_example(entry_losses(entries, temperature, unique=unique), temperature, alpha)


def pack_logits(entries: DataFrame) -> DataFrame:
    """Array form of ``example_id, pos, label, token_id, student, teacher``, one row per vocabulary entry.

    The entries kept for a position stand for the whole distribution: both sides are renormalised over
    them, and a label outside them has no hard loss. Copies of an entry count once, so an array is never
    longer than the vocabulary.
    """
    packed = entries.groupBy("example_id", "pos", "label").agg(
        F.sort_array(F.collect_set(F.struct("token_id", "student", "teacher"))).alias("e")
    )
    at = F.array_position(F.col("e.token_id"), F.col("label").cast("int")).cast("int") - 1
    return packed.select(
        "example_id",
        "pos",
        F.when(F.col("label") == fixed.IGNORED_LABEL, F.col("label")).otherwise(at).alias("label"),
        F.col("e.student").alias("student"),
        F.col("e.teacher").alias("teacher"),
    )
