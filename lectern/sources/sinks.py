"""Writing results as JSON lines, JSON arrays or training shards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern import fixed
from lectern.functions import arrays
from lectern.operators.sampling import in_key_ranges


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines in a folder of part files: null fields kept, non-ASCII characters as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", compression).json(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """A folder of files that each hold one top-level JSON array, a row to a line; null fields are kept."""

    def arrays_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            rows = batch["value"].to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [f"{lead if i == 0 else ','}{r}" for i, r in enumerate(rows)]})
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": ["[]" if lead == "[" else "]"]})

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(arrays_of, "value string").write.mode("overwrite").text(path)


def padded_columns(max_tokens: int, pad_id: int = fixed.PAD_ID, mask_pad_ids: bool = False) -> list[Column]:
    """``input_ids``, ``attention_mask`` and ``labels`` out of un-padded ``ids`` and ``n_tokens``.

    Labels are ignored by position, so a pad id inside the text keeps its label; ``mask_pad_ids``
    ignores every pad id instead.
    """
    padded = arrays.pad_right(F.col("ids"), max_tokens, pad_id)
    labels = arrays.labels_by_pad_id(padded, pad_id) if mask_pad_ids else arrays.labels_by_position(padded, F.col("n_tokens"))
    return [
        padded.alias("input_ids"),
        arrays.attention_mask(F.col("n_tokens"), max_tokens).alias("attention_mask"),
        labels.alias("labels"),
    ]


def write_shards(
    df: DataFrame,
    path: str,
    *,
    max_tokens: int,
    row_key: str = "row_key",
    shards: int | None = None,
    pad_id: int = fixed.PAD_ID,
    mask_pad_ids: bool = False,
) -> None:
    """Parquet files in shuffled order, each holding a range of it.

    Rows come with ``order_key`` and are moved and sorted un-padded. Padding is the last projection
    before the write, so the long arrays are never shuffled.
    """
    ordered = in_key_ranges(df, shards).sortWithinPartitions("order_key", row_key)
    columns = padded_columns(max_tokens, pad_id, mask_pad_ids)
    ordered.select("order_key", row_key, "n_tokens", *columns).write.mode("overwrite").parquet(path)
