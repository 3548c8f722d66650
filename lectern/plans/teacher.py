"""Responses of a teacher to an instruction table, as a whole job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern import fixed
from lectern.operators.formats import teacher_prompt, teacher_record
from lectern.operators.generate import GeneratorLoader, answered, failed, generate_responses
from lectern.operators.ledger import Ledger, unanswered
from lectern.operators.sampling import batch_numbering, head_cap
from lectern.session import scratch_path
from lectern.sources.sinks import write_jsonl

# Rows that are answered between two entries in the ledger: as many as an interruption may cost.
COMMIT_ROWS = 1_000_000


def teacher_rows(
    instructions: DataFrame,
    load_generator: GeneratorLoader,
    *,
    max_samples: int | None = None,
    order: tuple[str, ...] = ("row_key",),
    batch_size: int = fixed.GENERATION_BATCH,
    bos: str = fixed.BOS,
) -> DataFrame:
    """The first rows with ``prompt``, ``response`` and ``error``. Write them once, then split them."""
    prompts = teacher_prompt(head_cap(instructions, max_samples, list(order)), bos)
    return generate_responses(prompts, load_generator, batch_size=batch_size)


def teacher_records(generated: DataFrame) -> DataFrame:
    return teacher_record(answered(generated))


def quarantined_rows(generated: DataFrame) -> DataFrame:
    return failed(generated)


def teacher_job(
    instructions: DataFrame,
    load_generator: GeneratorLoader,
    path: str,
    *,
    max_samples: int | None = None,
    order: tuple[str, ...] = ("row_key",),
    batch_size: int = fixed.GENERATION_BATCH,
    commit_rows: int = COMMIT_ROWS,
    ask_failed_again: bool = False,
    compression: str = "none",
) -> None:
    """The first rows in contiguous batches, answered; records as JSON lines, failed rows apart. Can be continued.

    Below ``path``: ``generated`` with every row, its ``position`` and ``batch_id``, ``ledger`` with the parts that
    are done, ``records`` as JSON lines, and ``quarantine`` with the rows that have an error and no answer.

    Rows are answered in parts of ``commit_rows`` in their order, each written and then entered in the ledger. A run
    that was stopped, whatever it was doing, loses at most the part it was at: called again for the same path, the
    job asks for what no part holds, also of rows that came to the instructions since. Rows are known by their
    ``order`` columns, which must not be null. With ``ask_failed_again`` those that failed are tried again, and
    leave the quarantine once they are answered. ``compression`` is that of the records, which hold each prompt twice.
    """
    spark, ledger, key = instructions.sparkSession, Ledger(instructions.sparkSession, path), list(order)
    first = head_cap(instructions, max_samples, key)
    schema = _generated(batch_numbering(first, key, batch_size), load_generator, batch_size).schema
    left = _left(first, ledger.rows(schema), key, batch_size, ask_failed_again)
    left = left.withColumn("_part", F.floor(F.col("position") / commit_rows))
    parts = [r["_part"] for r in left.select("_part").distinct().orderBy("_part").collect()]  # one for each commit
    if len(parts) > 1:  # what is read once need not be written first
        waiting = scratch_path(spark, "waiting")
        left.sortWithinPartitions("_part", "position").write.partitionBy("_part").parquet(waiting)
        left = spark.read.schema(left.schema).parquet(waiting)
    for number in parts:
        asked = left.where(F.col("_part") == number).drop("_part").sortWithinPartitions("position")
        ledger.commit(_generated(asked, load_generator, batch_size), number)

    written = ledger.rows(schema).drop("part")
    write_jsonl(teacher_records(teacher_prompt(written)), f"{path}/records", compression=compression)
    refused = quarantined_rows(written)
    if ask_failed_again:
        latest = refused.groupBy(*key).agg(F.max_by(F.struct("batch_id", "error"), "position").alias("l")).select(*key, "l.*")
        refused = latest.join(answered(written).select(*key), key, "left_anti")
    refused.select(*key, "batch_id", "error").write.mode("overwrite").parquet(f"{path}/quarantine")


def _left(rows: DataFrame, done: DataFrame, key: list[str], batch_size: int, ask_failed_again: bool) -> DataFrame:
    """The rows that are still to be asked, with ``position`` and ``batch_id`` among all of them.

    Rows are numbered and compared with those that are done by their keys alone; then the texts are moved once, or not
    at all where the keys are few. Only if keys repeat or are null are whole rows numbered.
    """

    def unasked(numbered: DataFrame) -> DataFrame:
        return unanswered(batch_numbering(numbered, key, batch_size), done, key, ask_failed_again=ask_failed_again)

    path = scratch_path(rows.sparkSession, "unasked")
    unasked(rows.select(*key)).write.parquet(path)
    keys = rows.sparkSession.read.parquet(path)
    is_null = reduce(Column.__or__, [F.col(c).isNull() for c in key])
    if not keys.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | is_null).isEmpty():
        return unasked(rows)
    return rows.join(keys, key).select(*rows.columns, "position", "batch_id")


def _generated(rows: DataFrame, load_generator: GeneratorLoader, batch_size: int) -> DataFrame:
    """The rows answered. Their prompts follow from them, and are not kept."""
    generated = generate_responses(teacher_prompt(rows), load_generator, batch_size=batch_size)
    return generated.drop("prompt").withColumn("failed", F.col("error").isNotNull())


def teacher_report(ledger: Ledger) -> DataFrame:
    """``run, n_parts, n_asked, n_answered, n_refused`` of every run that finished a part."""
    return ledger.entries().groupBy("run").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.sum("n_rows").alias("n_asked"),
        F.sum(F.col("n_rows") - F.col("n_failed")).alias("n_answered"),
        F.sum("n_failed").alias("n_refused"),
    )
