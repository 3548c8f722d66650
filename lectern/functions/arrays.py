"""Padding, masks, labels and softmax sums on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern import fixed


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def pad_right(ids: Column, length: int, pad_id: int = fixed.PAD_ID) -> Column:
    """Exactly ``length`` ids: padded at the end, or cut."""
    fill = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.slice(F.concat(ids, fill), 1, length)


def pad_left(ids: Column, length: Column, pad_id: int = fixed.PAD_ID) -> Column:
    """Ids moved to the end of an array of ``length`` by padding in front."""
    return F.concat(F.array_repeat(F.lit(pad_id), length - F.size(ids)), ids)


def attention_mask(n_tokens: Column, length: int) -> Column:
    ones = F.least(n_tokens, F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(length) - ones))


def labels_by_position(padded: Column, n_tokens: Column) -> Column:
    """Ids as labels, ignored from position ``n_tokens`` on."""
    return F.transform(padded, lambda x, i: F.when(i >= n_tokens, F.lit(fixed.IGNORED_LABEL)).otherwise(x))


def labels_by_pad_id(padded: Column, pad_id: int = fixed.PAD_ID) -> Column:
    """Ids as labels, every pad id ignored, also inside the text."""
    return F.transform(padded, lambda x: F.when(x == pad_id, F.lit(fixed.IGNORED_LABEL)).otherwise(x))


def exp_shifted(values: Column, shift: Column) -> Column:
    """exp(x - shift) of every element; with the maximum as shift nothing overflows."""
    return F.transform(values, lambda x: F.exp(x - shift))


def sum_exp_shifted(values: Column, shift: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - shift))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda a, b: a * b))
