"""Token counts, vocabulary, ids, length rules and padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lectern import fixed
from lectern.functions import arrays

MAX_VOCABULARY = 1 << 20
# Pieces that are looked up at a time, or those of one row, so that the arrays stay small whatever the batch size is.
SLICE_PIECES = 1 << 19

# Called once per task; gives a function from texts to as many lists of token ids.
EncoderLoader = Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]


def pieces(text: Column) -> Column:
    """Pieces of the built-in encoder: runs of letters and digits, and single other characters."""
    return F.regexp_extract_all(text, F.lit(fixed.PIECE_PATTERN), 0)


def count_pieces(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fixed.PIECE_PATTERN))


def token_count(df: DataFrame, text: str = "text") -> DataFrame:
    """``n_tokens`` by the built-in encoder, without building the tokens."""
    return df.withColumn("n_tokens", count_pieces(F.col(text)))


def build_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``piece, n, id`` of the most frequent pieces, ties by piece; ids start after the reserved ones.

    The count at which ``size`` pieces are reached is found first, from how many pieces share each
    count: n tokens have at most about sqrt(2 n) different counts. Rarer pieces are dropped before the
    top-k, which so gathers ``size`` rows and the ties. Pieces are counted once, for both.
    """
    if size > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary may hold at most {MAX_VOCABULARY} pieces")
    counts = df.select(F.explode(pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    sharing = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_pieces"))
    reached = F.sum("_pieces").over(Window.orderBy(F.desc("n")))
    lowest = sharing.withColumn("_reached", reached).where(F.col("_reached") >= size).agg(F.max("n").alias("n"))
    top = counts.where(F.col("n") >= F.coalesce(lowest.scalar(), F.lit(1))).orderBy(F.desc("n"), "piece").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "piece"))
    return top.withColumn("id", rank + F.lit(fixed.RESERVED_IDS - 1))


def _once(udf):
    """Keeps the optimizer from copying the function into a later filter, which would run it twice per row.

    The functions are deterministic; only declaring them otherwise holds such a filter above them. So filter
    on plain columns before encoding.
    """
    return udf.asNondeterministic()


def encode_with_vocab(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """``ids`` and ``n_tokens`` by the built-in encoder; pieces outside the vocabulary get the unknown id.

    Runs the job that builds the vocabulary: its rows, at most ``MAX_VOCABULARY``, go to every task.
    Pieces are split in the JVM and looked up slice by slice; nothing is shuffled.
    """
    known = vocab.select("piece", "id").orderBy(F.desc("id")).limit(MAX_VOCABULARY + 1).collect()
    if len(known) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary may hold at most {MAX_VOCABULARY} pieces")
    shared = df.sparkSession.sparkContext.broadcast(([r["piece"] for r in known], [r["id"] for r in known]))
    unknown, most = fixed.UNK_ID, max(SLICE_PIECES, 4 * len(known))  # each slice hashes the vocabulary anew

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa
        import pyarrow.compute as pc

        known, numbers = pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.int32())  # built once per task
        for batch in batches:
            ends = pc.fill_null(pc.list_value_length(batch), 0).to_numpy().cumsum(dtype="int64")
            first = 0
            while first < len(batch):
                before = int(ends[first - 1]) if first else 0
                last = max(int(ends.searchsorted(before + most, side="right")), first + 1)
                found = pc.index_in(batch.slice(first, last - first).flatten().cast(pa.string()), value_set=known)
                starts = pa.array([0, *(ends[first:last] - before)], pa.int32())
                yield pa.ListArray.from_arrays(starts, pc.fill_null(numbers.take(found), unknown))
                first = last
            batch = found = None  # else they stay while the next batch is read

    encoded = df.withColumn("ids", _once(look_up)(F.coalesce(pieces(F.col(text)), F.array().cast("array<string>"))))
    return encoded.withColumn("n_tokens", F.size("ids"))


def encode_with(df: DataFrame, load_encoder: EncoderLoader, text: str = "text") -> DataFrame:
    """``ids`` and ``n_tokens`` by a caller's encoder, loaded once per task and called once per batch."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load_encoder()
        for batch in batches:
            yield pd.Series([list(ids) for ids in run(batch.fillna("").tolist())])

    return df.withColumn("ids", _once(encode)(F.col(text))).withColumn("n_tokens", F.size("ids"))


def length_filter(df: DataFrame, max_tokens: int = fixed.MAX_TOKENS) -> DataFrame:
    """Rows of at most ``max_tokens`` tokens, by a count taken before any cut."""
    return df.where(F.col("n_tokens") <= max_tokens)


def length_truncate(df: DataFrame, max_tokens: int = fixed.MAX_TOKENS) -> DataFrame:
    """Every row, its ids cut to ``max_tokens``."""
    return df.withColumns(
        {"ids": arrays.truncate(F.col("ids"), max_tokens), "n_tokens": F.least(F.col("n_tokens"), F.lit(max_tokens))}
    )


def pad_tokens(df: DataFrame, max_tokens: int = fixed.MAX_TOKENS, pad_id: int = fixed.PAD_ID) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of exactly ``max_tokens`` each. Pad as late as possible."""
    return df.withColumns(
        {
            "input_ids": arrays.pad_right(F.col("ids"), max_tokens, pad_id),
            "attention_mask": arrays.attention_mask(F.col("n_tokens"), max_tokens),
        }
    )


def make_labels(df: DataFrame, pad_id: int = fixed.PAD_ID, mask_pad_ids: bool = False) -> DataFrame:
    """``labels``: the input ids, ignored after the text; prompt tokens count. ``mask_pad_ids`` goes by id."""
    padded = F.col("input_ids")
    labels = arrays.labels_by_pad_id(padded, pad_id) if mask_pad_ids else arrays.labels_by_position(padded, F.col("n_tokens"))
    return df.withColumn("labels", labels)


def pad_left_batch(
    df: DataFrame, max_tokens: int = fixed.PROMPT_MAX_TOKENS, pad_id: int = fixed.PAD_ID, batch: str = "batch_id"
) -> DataFrame:
    """``input_ids`` and ``attention_mask`` padded in front to the longest row of the batch.

    Rows are first cut to ``max_tokens``. A batch has as many rows as batch numbering gave it, so the
    window over it is small.
    """
    longest = F.max("n_tokens").over(Window.partitionBy(batch))
    cut = length_truncate(df, max_tokens).withColumn("_longest", longest)
    return cut.withColumns(
        {
            "input_ids": arrays.pad_left(F.col("ids"), F.col("_longest"), pad_id),
            "attention_mask": F.concat(
                F.array_repeat(F.lit(0), F.col("_longest") - F.col("n_tokens")), F.array_repeat(F.lit(1), F.col("n_tokens"))
            ),
        }
    ).drop("_longest")
