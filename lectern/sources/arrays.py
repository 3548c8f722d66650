"""Top-level JSON arrays, read by many tasks.

Spark's text source cuts a file into splits, and here into pieces that end with ``}``; a piece belongs to the split it
begins in. Where a split begins inside a text or how deep is not known at first. So one pass tells for every split
what it does to either state of the lexer, a prefix sum over the splits gives the state each begins in, and a second
pass cuts out the elements. An element that reaches over splits is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lectern.session import scratch_path

END = "}"
# Rows of a batch that are Python objects at a time.
ROWS_AT_ONCE = 64
SPLIT = ["file", "start"]
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_BETWEEN = " \t\r\n,"
_LINE_ENDS = str.maketrans("\r\n", "  ")
# A control character that no JSON text may hold as it is: the row is malformed, as a line end within a string makes it.
_MALFORMED = "\x01"


@dataclass
class Lexer:
    """What is known between two pieces: whether a string is open, and how many brackets are."""

    in_string: bool = False
    depth: int = 0

    def read(self, piece: str) -> bool:
        """Go on behind a piece and the ``}`` that ends it. False if a string in it holds a line end."""
        inside, outside = self._parts(piece)
        self.depth += _opened(outside) - (not self.in_string)
        return not any("\n" in p or "\r" in p for p in inside)

    def _parts(self, piece: str) -> tuple[list[str], list[str]]:
        parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
        first = self.in_string
        self.in_string ^= len(parts) % 2 == 0
        return parts[not first :: 2], parts[first::2]


def _opened(parts: list[str]) -> int:
    text = "".join(parts)
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", END).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool]]:
    """The rows one by one, and whether each is the first of its split. A task reads its splits one after the other."""
    last = None
    for rows in batches:
        for at in range(0, rows.num_rows, ROWS_AT_ONCE):
            for row in rows.slice(at, ROWS_AT_ONCE).to_pylist():
                split = (row["file"], row["start"])
                yield row, split != last
                last = split
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


_EFFECT = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("flips", pa.int32()), ("from_outside", pa.int64()), ("from_inside", pa.int64()), ("base", pa.int32())]
)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: whether it flips being in a string, the brackets it opens if it begins outside or inside one, and at
    the start of a file how deep its rows lie: 1 in an array, else 0."""

    def row(split, outside: Lexer, inside: Lexer, base) -> pa.RecordBatch:
        values = [*split, int(outside.in_string), outside.depth, inside.depth, base]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _EFFECT)], schema=_EFFECT)

    split, outside, inside, base = None, None, None, None
    for piece, is_first in _by_split(batches):
        if is_first:
            if split is not None:
                yield row(split, outside, inside, base)
            split, outside, inside, base = (piece["file"], piece["start"]), Lexer(), Lexer(in_string=True), None
            if piece["start"] == 0:
                base = int(piece["value"].lstrip("﻿" + _BETWEEN).startswith("["))
        outside.read(piece["value"])
        inside.read(piece["value"])
    if split is not None:
        yield row(split, outside, inside, base)


def split_states(pieces: DataFrame) -> DataFrame:
    """``file, start, in_string, depth, base`` at the beginning of every split: one row for each."""
    schema = "file string, start bigint, flips int, from_outside bigint, from_inside bigint, base int"
    effects = pieces.mapInArrow(_effects, schema)
    splits = Window.partitionBy("file").orderBy("start")
    ahead = splits.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("flips").over(ahead), F.lit(0)) % 2
    states = effects.select("*", (inside == 1).alias("in_string"))
    opened = F.when(F.col("in_string"), F.col("from_inside")).otherwise(F.col("from_outside"))
    states = states.withColumn("opened", opened)
    depth = F.coalesce(F.sum("opened").over(ahead), F.lit(0).cast("bigint"))
    return states.select(*SPLIT, "in_string", depth.alias("depth"), F.first("base", ignorenulls=True).over(splits).alias("base"))


_ELEMENTS = pa.schema([("value", pa.string()), ("kind", pa.string())])
ROW, PART = "row", "part"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that lie in one split, and the split's parts of others: what stands before its first end of a row and
    behind its last. A part is written with its file, split and place."""
    lexer, held, split, ended, base, out = Lexer(), [], None, False, 0, []

    def part() -> tuple[str, str]:
        file, start = split
        return "\t".join([file, str(start), str(int(ended)), str(base), "".join(held)]), PART

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*out)], schema=_ELEMENTS)

    for piece, is_first in _by_split(batches):
        if is_first:
            if split is not None:
                out.append(part())
            split, base = (piece["file"], piece["start"]), piece["base"]
            lexer, held, ended = Lexer(piece["in_string"], piece["depth"]), [], False
            out.append(("", ROW))
        sound = lexer.read(piece["value"])
        held.append(("" if sound else _MALFORMED) + piece["value"].translate(_LINE_ENDS) + END)
        if lexer.depth == base and not lexer.in_string:
            out.append(("".join(held).lstrip(_BETWEEN), ROW) if ended else part())
            held, ended = [], True
        if len(out) >= ROWS_AT_ONCE:
            yield sent()
            out = []
    if split is not None:
        out.append(part())
    if out:
        yield sent()


def _joined_parts(lines: DataFrame) -> DataFrame:
    """The rows that reach over splits. What follows the last end of a row in one split goes on at the start of the next.

    What follows the last row of a file has to be the end of its array; else the file is cut off, and malformed.
    """
    columns = F.split("value", "\t", 5)
    parts = lines.select(
        columns[0].alias("file"),
        *[columns[i].cast("bigint").alias(c) for i, c in ((1, "start"), (2, "behind"), (3, "base"))],
        columns[4].alias("text"),
    )
    of_file = Window.partitionBy("file")
    upto = of_file.orderBy("start", "behind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbers = parts.select("file", "start", "behind", F.sum("behind").over(upto).alias("number"), F.sum("behind").over(of_file).alias("last"))
    told = parts.join(numbers, ["file", "start", "behind"])
    whole = told.groupBy("file", "base", "number", "last").agg(F.array_sort(F.collect_list(F.struct("start", "behind", "text"))).alias("p"))
    text = F.array_join(F.col("p.text"), "")
    text = F.when((F.col("number") == 0) & (F.col("base") == 1), F.regexp_replace(text, "^[\ufeff\\s,]*\\[", "")).otherwise(text)
    whole = whole.select("base", "number", "last", F.regexp_replace(text, "^[\ufeff\\s,]+", "").alias("value"))
    is_end = F.when(F.col("base") == 1, F.col("value").startswith("]")).otherwise(F.col("value").isin("", END))
    is_last = F.col("number") == F.col("last")
    value = F.when(is_last, F.concat(F.lit(_MALFORMED), "value")).otherwise(F.col("value"))
    return whole.where(~(is_last & is_end)).select(value.alias("value"))


def array_lines(spark: SparkSession, path: str) -> list[str] | None:
    """Folders with the rows of all arrays below ``path``, one JSON object to a line; None if there is not a byte.

    Objects that stand one after the other without an array are rows as well. An element that is no object, or has
    a line end within a string, comes out so that a JSON reader calls it malformed.
    """
    pieces = _pieces(spark, path)
    states = split_states(pieces)
    # One row of some hundred bytes for every split: a millionth of the data.
    placed = pieces.join(F.broadcast(states), SPLIT)
    out = scratch_path(spark, "array-rows")
    placed.mapInArrow(_elements, "value string, kind string").write.partitionBy("kind").text(out)
    if not spark.read.text(out).head(1):
        return None
    joined = scratch_path(spark, "array-joined")
    _joined_parts(spark.read.text(f"{out}/kind={PART}")).write.text(joined)
    return [f"{out}/kind={ROW}", joined]
