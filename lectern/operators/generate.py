"""Batch generation by a caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern import fixed

# Called once per task; gives a function from prompts to as many responses.
GeneratorLoader = Callable[[], Callable[[list[str]], list[str]]]

ANSWER = "struct<response:string,error:string>"


def _answers(generate: Callable[[list[str]], list[str]], prompts: list[str]) -> list[str]:
    answers = list(generate(prompts))
    if len(answers) != len(prompts):
        raise ValueError(f"{len(answers)} responses for {len(prompts)} prompts")
    return answers


def _try_batch(generate: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """Response and error of every prompt. A batch that fails is tried again prompt by prompt."""
    try:
        answers = _answers(generate, prompts)
    except Exception as e:
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [_try_batch(generate, [p])[0] for p in prompts]
    return [(None, "ValueError: no response") if a is None else (str(a).strip(), None) for a in answers]


def generate_responses(
    df: DataFrame, load_generator: GeneratorLoader, *, prompt: str = "prompt", batch_size: int = fixed.GENERATION_BATCH
) -> DataFrame:
    """``response`` and ``error`` for every row.

    Only prompts go to the generator, ``batch_size`` at a time; the other columns stay as they are. A batch that
    fails is tried again prompt by prompt, so the rows with an error, and no response, are those the generator
    fails on by themselves, however the table is partitioned. A lost executor repeats its batches, so the
    generator must bear being called again.
    """

    @F.arrow_udf(ANSWER)
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa

        generate = load_generator()
        for batch in batches:
            prompts, found = batch.to_pylist(), []
            for start in range(0, len(prompts), batch_size):
                found += _try_batch(generate, prompts[start : start + batch_size])
            columns = [pa.array([row[i] for row in found], pa.string()) for i in (0, 1)]
            yield pa.StructArray.from_arrays(columns, ["response", "error"])

    # Declared otherwise, the optimizer would copy the function into later filters and run it again there.
    answered_rows = df.withColumn("_answer", answer.asNondeterministic()(F.col(prompt)))
    return answered_rows.withColumns({c: F.col(f"_answer.{c}") for c in ("response", "error")}).drop("_answer")


def answered(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull())


def failed(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNotNull())


def write_generated(df: DataFrame, path: str) -> None:
    """Answered and failed rows in one pass, in the folders ``failed=false`` and ``failed=true``."""
    df.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(path)
