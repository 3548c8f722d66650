"""Preparation of training tables: for logit training, and supervised."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from lectern import fixed
from lectern.functions import chat
from lectern.operators.combine import union_all
from lectern.operators.formats import format_exchange
from lectern.operators.funnel import observe_groups, observe_rows
from lectern.operators.sampling import sample_cap, seeded_shuffle
from lectern.operators.tokens import length_filter, length_truncate

Encode = Callable[[DataFrame], DataFrame]


def render_exchanges(df: DataFrame, bos: str = fixed.BOS) -> DataFrame:
    text = chat.render_exchange(F.col("problem"), F.col("response"), bos)
    return df.withColumn("text", text).drop("problem", "response")


def formatted_union(tables: Sequence[DataFrame], *, instruction: bool, generations: bool) -> DataFrame:
    """Sources of different shapes, each formatted on its own, then put together."""
    return union_all([format_exchange(t, instruction=instruction, generations=generations) for t in tables])


def logit_training_rows(
    tables: Sequence[DataFrame],
    encode: Encode,
    *,
    max_samples: int | None = fixed.MAX_SAMPLES,
    max_tokens: int = fixed.MAX_TOKENS,
    seed: int = fixed.SHUFFLE_SEED,
    bos: str = fixed.BOS,
    capped_rows: Observation | None = None,
    kept_rows: Observation | None = None,
    by_source: Mapping[str, Observation] | None = None,
) -> DataFrame:
    """``source, row_key, order_key, text, ids, n_tokens`` of the rows to train on, un-padded.

    The cap comes before the length filter, so fewer than ``max_samples`` rows may be left. Rendering and
    encoding run on the capped rows only. ``encode`` adds ``ids`` and ``n_tokens``, once. The observations get the
    numbers of rows after the cap and after the filter as the result is written; those of ``by_source``, under any of
    the names ``loaded``, ``capped`` and ``kept``, get them for each source. ``row_key`` identifies a row, as loading
    sees to.
    """
    by_source = dict(by_source or {})
    rows = formatted_union(tables, instruction=True, generations=True)
    if "loaded" in by_source:
        rows = observe_groups(rows, by_source["loaded"])
    capped = sample_cap(rows, max_samples, seed=seed, unique=True)
    if capped_rows is not None:
        capped = observe_rows(capped, capped_rows)
    if "capped" in by_source:
        capped = observe_groups(capped, by_source["capped"])
    kept = length_filter(encode(render_exchanges(capped, bos)), max_tokens).drop("empty_prompt", "empty_response")
    if "kept" in by_source:
        kept = observe_groups(kept, by_source["kept"])
    return kept if kept_rows is None else observe_rows(kept, kept_rows)


def supervised_rows(
    tables: Sequence[DataFrame],
    encode: Encode | None = None,
    *,
    max_tokens: int = fixed.MAX_TOKENS,
    seed: int = fixed.SHUFFLE_SEED,
    bos: str = fixed.BOS,
) -> DataFrame:
    """All rows in shuffled order: no instruction, no generations, no cap; long rows are cut, not dropped."""
    rows = render_exchanges(formatted_union(tables, instruction=False, generations=False), bos).drop("empty_prompt", "empty_response")
    if encode is not None:
        rows = length_truncate(encode(rows), max_tokens)
    return seeded_shuffle(rows, seed=seed)
