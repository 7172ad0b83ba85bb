"""Typed access to JSON properties, with the reference semantics of dynamic values.

`kind` tells text from number from boolean, so that "5" stays text and true counts as 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(name: str) -> str:
    return "$." + ".".join(name.split("."))


def prop(properties: Column, name: str) -> Column:
    """The property as a variant; null where the JSON is broken or lacks it."""
    return F.try_variant_get(F.try_parse_json(properties), _path(name), "variant")


def kind(value: Column) -> Column:
    """STRING, NUMBER, BOOLEAN or OTHER; null where the value is missing or JSON null."""
    t = F.schema_of_variant(value)
    return F.when(value.isNull() | (t == "VOID"), F.lit(None)).when(t == "STRING", "STRING").when(t == "BOOLEAN", "BOOLEAN").when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "NUMBER").otherwise("OTHER")


def text(properties: Column, name: str) -> Column:
    """A text property, null where it is none."""
    v = prop(properties, name)
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number(properties: Column, name: str) -> Column:
    """A number property; booleans count as 0 and 1, numeric text is null."""
    v = prop(properties, name)
    return F.when(kind(v).isin("NUMBER", "BOOLEAN"), F.try_variant_get(v, "$", "double"))


def equals(properties: Column, name: str, value: object) -> Column:
    """property = value as a dynamic language compares; null and missing equal nothing."""
    if value is None:
        return F.lit(False)
    if isinstance(value, str):
        return F.coalesce(text(properties, name) == value, F.lit(False))
    return F.coalesce(number(properties, name) == float(value), F.lit(False))


def typed_equals(kind: T.DataType, column: Column, value: object) -> Column:
    """`equals` on a typed column instead of JSON: text equals text; numbers and booleans equal numbers and booleans."""
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return column == value
    if isinstance(kind, T.NumericType) and isinstance(value, (bool, int, float)):
        whole = isinstance(kind, T.IntegralType) and float(value).is_integer()
        return column == (int(value) if whole else float(value))
    if isinstance(kind, T.BooleanType) and isinstance(value, (bool, int, float)):
        return column == bool(value) if value in (0, 1) else F.lit(False)
    return F.lit(False)
