"""Loading one or many sources into DataFrames with ``source`` and ``row_key``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lectern.sources.arrays import array_lines
from lectern.sources.mixed import RAW, typed_rows

KEY_DIGITS = 19
DEFAULT_SPLIT = "train"
CONTENT, COPY = "_content", "_copy"


@dataclass(frozen=True)
class SourceSpec:
    """Where a source lies and how to read it.

    ``key`` names columns that together identify a row. Without one, Parquet rows are known by their file below
    ``path`` and the position in it, JSON rows by a hash of their content and the number of the copy. Neither
    depends on how files are split or where the folder lies.

    ``split`` is the value to select of a table's ``split`` column, where it has one; None takes every split.
    A malformed JSON row ends the read unless ``mode`` says otherwise. ``mixed`` says that JSON rows disagree on types:
    each is fitted to ``schema`` by itself, and comes with ``misfits`` and ``raw`` as ``typed_rows`` says; none is
    malformed then, and one without a ``split`` that could be read is in every split.
    """

    path: str
    name: str | None = None
    format: str | None = None
    schema: T.StructType | str | None = None
    split: str | None = DEFAULT_SPLIT
    key: str | Sequence[str] | None = None
    json_array: bool | None = None
    mode: str = "FAILFAST"
    mixed: bool = False

    @property
    def label(self) -> str:
        return self.name or self.path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]

    @property
    def kind(self) -> str:
        if self.format:
            return "json" if self.format == "jsonl" else self.format
        return "json" if self.path.endswith((".json", ".jsonl")) else "parquet"


def parse_source_list(sources: str | Sequence[str | SourceSpec]) -> list[SourceSpec]:
    """Specs from a comma-separated text or a list; empty parts are left out."""
    parts = sources.split(",") if isinstance(sources, str) else sources
    specs = [p if isinstance(p, SourceSpec) else SourceSpec(p.strip()) for p in parts if not isinstance(p, str) or p.strip()]
    if not specs:
        raise ValueError("no source given")
    return specs


def _is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first non-blank line starts an array. Reads one line's first character."""
    line = F.ltrim(F.col("value"))
    first = spark.read.text(path).where(line != "").select(F.substring(line, 1, 1).alias("c")).limit(1).collect()
    return bool(first) and first[0]["c"] == "["


def read_json(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """JSON lines, or top-level arrays, whose rows are first written out as lines by as many tasks as there are splits."""
    is_array = spec.json_array
    if is_array is None:
        is_array = spec.path.endswith(".json") and _is_json_array(spark, spec.path)
    paths = (array_lines(spark, spec.path) if is_array else None) or spec.path
    if spec.mixed:
        if spec.schema is None:
            raise ValueError("a mixed source needs a schema")
        return _in_split(typed_rows(spark.read.text(paths), spec.schema), spec)
    reader = spark.read.option("mode", spec.mode)
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    return _in_split(reader.json(paths), spec)


def _in_split(df: DataFrame, spec: SourceSpec) -> DataFrame:
    if spec.split is None or "split" not in df.columns:
        return df
    chosen = F.col("split") == spec.split
    return df.where(chosen | (F.col("split").isNull() & F.col(RAW).isNotNull()) if spec.mixed else chosen)


def read_table(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """An already landed table."""
    reader = spark.read
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    return _in_split(reader.format(spec.kind).load(spec.path), spec)


def _key_text(df: DataFrame, column: str) -> Column:
    """Text in the order of the values: a negative integer is a minus and its distance from a number below all of them."""
    value = F.col(column)
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        return value.cast("string")
    distance = F.lit(Decimal(10**KEY_DIGITS)) + value.cast("decimal(19,0)")
    below = F.concat(F.lit("-"), F.lpad(distance.cast("decimal(20,0)").cast("string"), KEY_DIGITS, "0"))
    return F.when(value < 0, below).otherwise(F.lpad(value.cast("string"), KEY_DIGITS, "0"))


def _joined_key(label: str, parts: list[Column]) -> Column:
    """Label and parts joined by colons so that no two lists of parts give one text. A null part has a sign of its own."""
    marks = ["\\"] if len(parts) == 1 else ["\\", ":"]
    shown = []
    for part in parts:
        for mark in marks:
            part = F.replace(part, F.lit(mark), F.lit(f"\\{mark}"))
        shown.append(F.coalesce(part, F.lit("\\0")))
    return F.concat_ws(":", F.lit(label.replace("\\", "\\\\").replace(":", "\\:")), *shown)


def row_key(df: DataFrame, spec: SourceSpec) -> Column:
    """Unique text key whose order is the natural order of the source.

    A row of a mixed source whose key could not be read has the digest of its text as well; equal ones share it.
    """
    if spec.key is not None:
        columns = [spec.key] if isinstance(spec.key, str) else list(spec.key)
        key = _joined_key(spec.label, [_key_text(df, c) for c in columns])
        if not spec.mixed:
            return key
        unread = F.col(RAW).isNotNull() & reduce(Column.__or__, [F.col(c).isNull() for c in columns])
        return F.when(unread, F.concat_ws(":", key, F.md5(RAW))).otherwise(key)
    if spec.kind == "parquet":
        position = F.lpad(F.col("_metadata.row_index").cast("string"), KEY_DIGITS, "0")
        return F.concat_ws(":", F.lit(spec.label), _below(F.col("_metadata.file_path"), _base(df.sparkSession, spec.path)), position)
    return F.concat_ws(":", F.lit(spec.label), F.col(CONTENT), F.lpad(F.col(COPY).cast("string"), KEY_DIGITS, "0"))


def _base(spark: SparkSession, path: str) -> str:
    """The absolute path of a source, without what names its store; of a pattern the folder before its first wildcard."""
    parts = path.rstrip("/").split("/")
    plain = list(takewhile(lambda part: not set("*?[{") & set(part), parts))
    base = spark._jvm.org.apache.hadoop.fs.Path("/".join(plain) or ("/" if path.startswith("/") else "."))
    store = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return base.makeQualified(store.getUri(), store.getWorkingDirectory()).toUri().getPath().rstrip("/")


def _below(file: Column, base: str) -> Column:
    """The part of a file's path below the source's; its name if the source is that file, all of it if it lies elsewhere."""
    encoded = F.regexp_replace(file, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    plain = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    name = F.substring_index(plain, "/", -1)
    below = F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    return F.when(plain == base, name).when(F.startswith(plain, F.lit(f"{base}/")), below).otherwise(plain)


def with_content_keys(df: DataFrame) -> DataFrame:
    """Every row with a hash of its content, and a number among its copies.

    Hashes alone are counted. A row whose hash no other has, as most, is not moved. Of equal rows one is kept, with
    partial results before the shuffle, and written out again as often as there were: a row that holds a large
    share of the table is not gathered to be numbered.
    """
    if any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        raise ValueError("rows with a map column need a key")
    content = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    hashed = df.withColumn(CONTENT, content)
    repeated = hashed.groupBy(CONTENT).agg(F.count(F.lit(1)).alias(COPY)).where(F.col(COPY) > 1)
    alone = hashed.join(repeated, CONTENT, "left_anti").withColumn(COPY, F.lit(1).cast("bigint"))
    copies = hashed.join(repeated.select(CONTENT), CONTENT, "left_semi")
    copies = copies.groupBy(CONTENT).agg(F.first(F.struct(*df.columns)).alias("_row"), F.count(F.lit(1)).alias(COPY))
    copies = copies.withColumn(COPY, F.explode(F.sequence(F.lit(1).cast("bigint"), COPY)))
    columns = [F.col("_row")[c].alias(c) for c in df.columns]
    return alone.select(*df.columns, CONTENT, COPY).unionByName(copies.select(*columns, CONTENT, COPY))


def load_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """One source, with ``source`` and ``row_key`` in front. A missing path raises here.

    Columns of these names the table already has come out as ``own_source`` and ``own_row_key``.
    """
    df = read_json(spark, spec) if spec.kind == "json" else read_table(spark, spec)
    columns = [F.col(c).alias(f"own_{c}") if c in ("source", "row_key") else F.col(c) for c in df.columns]
    if spec.kind == "json" and spec.key is None:  # of a mixed source the raw text is content as well
        df = with_content_keys(df)
    return df.select(F.lit(spec.label).alias("source"), row_key(df, spec).alias("row_key"), *columns)


def load_sources(spark: SparkSession, sources: str | Sequence[str | SourceSpec]) -> list[DataFrame]:
    """Every source in the given order; the first that fails ends the call. Each has a label of its own."""
    return [load_source(spark, spec) for spec in with_own_labels(parse_source_list(sources))]


def with_own_labels(specs: Sequence[SourceSpec]) -> list[SourceSpec]:
    """Sources of one label are numbered from the second on, so that no two share a ``row_key``."""
    seen: Counter = Counter()
    labelled = []
    for spec in specs:
        label = spec.label
        while seen[label]:
            seen[spec.label] += 1
            label = f"{spec.label}-{seen[spec.label]}"
        seen[label] += 1
        labelled.append(replace(spec, name=label))
    return labelled


def land_json(spark: SparkSession, spec: SourceSpec, path: str) -> SourceSpec:
    """Write a JSON source once as Parquet, which can be split, pruned and keyed by position."""
    read_json(spark, replace(spec, split=None)).write.mode("overwrite").parquet(path)
    return replace(spec, path=path, name=spec.label, format="parquet")
