"""Stripping, extraction and tag checks on text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern import fixed


def strip_unicode(text: Column) -> Column:
    """Strip every Unicode space character at both ends, not only U+0020."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip_unicode(text), F.lit(""))


def boxed_answer(text: Column) -> Column:
    """Content of the last ``\\boxed{...}``, up to its first ``}``; null if there is none."""
    matches = F.regexp_extract_all(text, F.lit(fixed.BOXED_PATTERN), 1)
    return strip_unicode(F.try_element_at(matches, F.lit(-1)))


def tagged_answer(text: Column) -> Column:
    """What follows the last opening answer tag, up to the closing one; without tags, the whole text."""
    after_open = F.substring_index(text, fixed.ANSWER_OPEN, -1)
    return strip_unicode(F.substring_index(after_open, fixed.ANSWER_CLOSE, 1))


def thinking(text: Column) -> Column:
    """First ``<think>`` block in any case, across lines; '' if there is none."""
    return strip_unicode(F.regexp_extract(text, fixed.THINK_PATTERN, 1))


def has_reasoning_block(text: Column) -> Column:
    """Both reasoning tags occur, and the first opening one comes before the first closing one."""
    opened = F.instr(text, fixed.REASONING_OPEN)
    closed = F.instr(text, fixed.REASONING_CLOSE)
    return F.coalesce((opened > 0) & (closed > 0) & (opened < closed), F.lit(False))
