"""Canonical JSON of nested columns: sorted keys, no spaces, one form of each number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits behind the point of a number; trailing zeros, and then the point, go.
SCALE = 12


def _quoted(text: Column) -> Column:
    """A string as JSON: what Spark writes for an array of it, without the brackets."""
    json = F.to_json(F.array(text))
    return F.substr(json, F.lit(2), F.length(json) - 2)


def _number(x: Column) -> Column:
    """A number without exponent: whole ones have no point. Numbers that are none are strings."""
    fixed = F.regexp_replace(F.regexp_replace(x.try_cast(f"decimal(38,{SCALE})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(fixed == "-0", "0").otherwise(fixed), _quoted(x.cast("string")))


def canonical_json(column: Column, kind: T.DataType) -> Column:
    """The text of ``column``, of data type ``kind``: keys of structs and maps in order, nulls as null, times in UTC
    as Spark prints them, bytes in base 64. Two values that differ only in the order of their keys, or in the
    width or scale of their numbers, have one text."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(f"{',' if i else ''}"), _quoted(F.lit(f.name)), F.lit(":"), canonical_json(column[f.name], f.dataType)) for i, f in enumerate(fields)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))
        keys = F.array_sort(F.map_keys(column))
        pairs = F.transform(keys, lambda k: entry(F.struct(k.alias("key"), F.element_at(column, k).alias("value"))))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = column.cast("string")
    elif isinstance(kind, T.NumericType):
        text = _number(column)
    elif isinstance(kind, T.BinaryType):
        text = _quoted(F.base64(column))
    else:
        text = _quoted(column.cast("string"))
    return F.coalesce(text, F.lit("null"))
