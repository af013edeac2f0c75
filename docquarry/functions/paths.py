"""Dotted paths and type families: what the compilers need to know of a schema."""

from __future__ import annotations

import datetime as dt
import decimal
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, STRING, BOOLEAN, TEMPORAL, BINARY, NESTED, VARIANT, NULL = "numeric", "string", "boolean", "temporal", "binary", "nested", "variant", "null"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def family(kind: T.DataType | None) -> str:
    """Types of one family compare with each other; across families no comparison holds."""
    if kind is None or isinstance(kind, T.NullType):
        return NULL
    if isinstance(kind, T.NumericType):
        return NUMERIC
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    if isinstance(kind, T.BinaryType):
        return BINARY
    return VARIANT if isinstance(kind, T.VariantType) else NESTED


def value_family(value: object) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float, decimal.Decimal)):
        return NUMERIC
    if isinstance(value, str):
        return STRING
    if isinstance(value, (dt.date, dt.datetime)):
        return TEMPORAL
    if isinstance(value, (bytes, bytearray)):
        return BINARY
    return NESTED


class Field:
    """A path resolved against a schema: its column and type, or absent (``kind`` None)."""

    def __init__(self, path: str, column: Column | None, kind: T.DataType | None, parent: Column | None = None):
        self.path, self.column, self.kind, self.parent = path, column, kind, parent

    @property
    def exists(self) -> bool:
        return self.column is not None

    @property
    def family(self) -> str:
        return family(self.kind)


def resolve(df: DataFrame, path: str) -> Field:
    """Walk structs and maps by name, arrays by numeric segments, variants by path. A scalar or unknown name on the way makes
    the field absent. A column whose own name has dots wins over the walk."""
    names = {f.name: f for f in df.schema.fields}
    if path in names:
        return Field(path, df[quoted(path)], names[path].dataType)
    head, *rest = path.split(".")
    if head not in names:
        return Field(path, None, None)
    column, kind = df[quoted(head)], names[head].dataType
    for k, part in enumerate(rest):
        if isinstance(kind, T.StructType):
            found = next((f for f in kind.fields if f.name == part), None)
            if found is None:
                return Field(path, None, None)
            column, kind = column.getField(part), found.dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            column, kind = F.get(column, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.VariantType):
            return Field(path, F.try_variant_get(column, variant_path(rest[k:]), "variant"), kind, column)
        else:
            return Field(path, None, None)
    return Field(path, column, kind)


def variant_path(parts: list[str]) -> str:
    """A JSON path; numeric segments index arrays."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" if re.fullmatch(r"\w+", p) else "['" + p.replace("'", "\\'") + "']" for p in parts)
