"""JSON rows that disagree on their types, read as variants and taken out by type without losing a row.

A reader with one schema gives up, or gives nulls, where one row has a number and the next a text, a list or an object
under the same name. Here each row is parsed for itself, and each wanted column cast by the value the row has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MISFITS, RAW = "misfits", "raw"
_PARSED = "_parsed"
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def _path(name: str) -> str:
    if "?" in name or ("'" in name and '"' in name):
        raise ValueError(f"no path leads to a field called {name}")
    return f'$["{name}"]' if "'" in name else f"$['{name}']"


def _is_given(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _has_fraction(value: Column) -> Column:
    """Of what a whole number would lose."""
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(number != F.floor(number), F.lit(False))


def _scalar(value: Column, kind: T.DataType) -> Column:
    """The value as the type, null where it does not fit. An object or list as text is its JSON."""
    cast = F.try_variant_get(value, "$", kind.simpleString())
    return F.when(~_has_fraction(value), cast) if isinstance(kind, T.IntegralType) else cast


def _typed(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The value as the type, and whether something of it did not fit."""
    if isinstance(kind, T.VariantType):
        return value, F.lit(False)
    if not isinstance(kind, T.ArrayType):
        cast = _scalar(value, kind)
        return cast, _is_given(value) & cast.isNull()
    several = F.try_variant_get(value, "$", "array<variant>")
    several = F.coalesce(several, F.when(_is_given(value), F.array(value)))
    lost = F.exists(several, lambda v: _is_given(v) & _scalar(v, kind.elementType).isNull())
    return F.transform(several, lambda v: _scalar(v, kind.elementType)), F.coalesce(lost, F.lit(False))


def _checked(schema: T.StructType) -> None:
    for field in schema.fields:
        kind = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType
        if isinstance(kind, _NESTED):
            raise ValueError(f"{field.name}: give a simple type, a list of one, or variant")
        if field.name in (MISFITS, RAW):
            raise ValueError(f"{field.name} is a column of the result")


def typed_rows(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The columns of ``schema`` from JSON objects in ``value``, one row for each; then ``misfits`` and ``raw``.

    Numbers, truth values, objects and lists are texts where a text is wanted (numbers in their shortest form); texts
    are numbers, dates or truth values where they read as such; a single value is a list of one where a list is wanted.
    What does not fit, also a fraction where a whole number is wanted, is null, and ``misfits`` names its column; of a
    list only the entries that do not fit are. A field that is missing or null is null and no misfit. ``misfits`` is
    null for a row that is no JSON object at all, such as a cut-off line or one with a name twice. ``raw`` holds the
    text of rows that did not fit as a whole, so that nothing is lost, and is null for all others. Fields that the
    schema does not name are not read. Blank lines are no rows.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    _checked(schema)
    is_object = F.startswith(F.ltrim("value"), F.lit("{"))
    rows = lines.select("value").where(F.trim(F.translate("value", "\t\r\n﻿", "   ")) != "")
    rows = rows.withColumn(_PARSED, F.when(is_object, F.try_parse_json("value")))
    fields = [F.try_variant_get(_PARSED, _path(f.name), "variant").alias(f"f{i}") for i, f in enumerate(schema.fields)]
    rows = rows.select("value", F.col(_PARSED).isNull().alias("malformed"), *fields)
    typed = [_typed(F.col(f"f{i}"), f.dataType) for i, f in enumerate(schema.fields)]
    names = [F.when(lost, F.lit(f.name)) for (_, lost), f in zip(typed, schema.fields, strict=True)]
    misfits = F.when(~F.col("malformed"), F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"))
    values = [value.alias(f"c{i}") for i, (value, _) in enumerate(typed)]
    rows = rows.select("value", misfits.alias("m"), *values)
    raw = F.when(F.col("m").isNull() | (F.size("m") > 0), F.col("value"))
    return rows.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(schema.fields)], F.col("m").alias(MISFITS), raw.alias(RAW))
