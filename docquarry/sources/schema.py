"""Table schemas: inference from documents, evolution, and column mapping."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.paths import quoted

INT32 = 1 << 31


def infer_type(value: object) -> T.DataType | None:
    """The type of one value; None for null. Integers are INT if they fit, else BIGINT."""
    if value is None:
        return None
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.IntegerType() if -INT32 <= value < INT32 else T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(value, dt.datetime):
        return T.TimestampType()
    if isinstance(value, dt.date):
        return T.DateType()
    if isinstance(value, Mapping):
        fields = [(str(k), infer_type(v)) for k, v in value.items()]
        return T.StructType([T.StructField(k, t or T.NullType()) for k, t in fields])
    if isinstance(value, (list, tuple)):
        kind: T.DataType | None = None
        for v in value:
            kind = unify(kind, infer_type(v))
        return T.ArrayType(kind or T.NullType())
    raise ValidationError(f"values of type {type(value).__name__} can't be stored", None, value)


_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def widen(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The smallest type that holds both; None if the two don't go together."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDTH and type(b) in _WIDTH:
        return max(a, b, key=lambda t: _WIDTH.index(type(t)))
    return None


def unify(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    """As ``widen``; nested values of different shapes become VARIANT."""
    if a is None or b is None:
        return a if b is None else b
    if (both := widen(a, b)) is not None:
        return both
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.names, *b.names]))
        fields = [T.StructField(n, unify(a[n].dataType if n in a.names else None, b[n].dataType if n in b.names else None)) for n in names]
        return T.StructType(fields)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(unify(a.elementType, b.elementType))
    return T.VariantType()


def _settled(kind: T.DataType | None) -> T.DataType:
    """Columns that were always null are strings; nested types with a variant inside are variants as a whole."""
    if kind is None or isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        inner = [_settled(f.dataType) for f in kind.fields]
        if not inner or any(isinstance(t, T.VariantType) for t in inner):
            return T.VariantType()
        return T.StructType([T.StructField(f.name, t) for f, t in zip(kind.fields, inner, strict=True)])
    if isinstance(kind, T.ArrayType):
        inner = _settled(kind.elementType)
        return inner if isinstance(inner, T.VariantType) else T.ArrayType(inner)
    return kind


def infer_schema(rows: Sequence[Mapping]) -> T.StructType:
    """Fields are the union over all rows, in the order first seen. ValidationError if a field has values of different kinds."""
    kinds: dict[str, T.DataType | None] = {}
    for i, row in enumerate(rows):
        if not isinstance(row, Mapping):
            raise ValidationError("a row is an object", f"rows[{i}]", row)
        for name, value in row.items():
            kind, before = infer_type(value), kinds.get(name)
            both = unify(before, kind)
            if isinstance(both, T.VariantType) and not all(isinstance(t, (T.StructType, T.ArrayType, T.VariantType)) for t in (before, kind) if t is not None):
                raise ValidationError(f"field {name} has values of type {before.simpleString()} and {kind.simpleString()}", name, value)
            kinds[name] = both
    return T.StructType([T.StructField(n, _settled(t)) for n, t in kinds.items()])


def _shaped(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.VariantType):
        return json.dumps(value, default=str)
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_shaped(v, kind.elementType) for v in value]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    return value


def to_frame(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """Documents as a DataFrame of the inferred schema."""
    schema = infer_schema(rows)
    plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.VariantType) else f.dataType) for f in schema.fields])
    df = spark.createDataFrame([[_shaped(r.get(f.name), f.dataType) for f in schema.fields] for r in rows], plain)
    return df.select(*[(F.parse_json(quoted(f.name)) if isinstance(f.dataType, T.VariantType) else F.col(quoted(f.name))).alias(f.name) for f in schema.fields])


#: Widenings that files of the narrower type can be read with.
_READABLE = {("int", "bigint"), ("int", "double"), ("float", "double"), ("tinyint", "int"), ("smallint", "int"), ("tinyint", "bigint"), ("smallint", "bigint")}


def merge_schemas(table: T.StructType, batch: T.StructType) -> T.StructType:
    """The schema after an append: known columns keep their place, widened where files of both types can be read as one;
    new ones come last and are nullable."""
    fields = []
    for f in table.fields:
        if f.name in batch.names:
            kind = batch[f.name].dataType
            wide = widen(f.dataType, kind)
            if wide is None or (wide != f.dataType and (f.dataType.simpleString(), wide.simpleString()) not in _READABLE):
                raise ValidationError(f"column {f.name} is {f.dataType.simpleString()}; the new rows have {kind.simpleString()}", f.name, kind.simpleString())
            fields.append(T.StructField(f.name, wide, True, f.metadata))
        else:
            fields.append(T.StructField(f.name, f.dataType, True, f.metadata))
    fields += [T.StructField(f.name, f.dataType, True, f.metadata) for f in batch.fields if f.name not in table.names]
    return T.StructType(fields)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with exactly the schema's columns."""

    def one(f: T.StructField) -> Column:
        return (F.col(quoted(f.name)).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)

    return df.select(*[one(f) for f in schema.fields])


MAPPING_MODE, PHYSICAL_NAME = "columnMapping.mode", "columnMapping.physicalName"


def physical_names(schema: T.StructType, configuration: Mapping[str, str]) -> dict[str, str]:
    """Logical name -> name in the files, for top-level columns; empty without column mapping."""
    if configuration.get(MAPPING_MODE) not in ("name", "id"):
        return {}
    return {f.name: f.metadata[PHYSICAL_NAME] for f in schema.fields if f.metadata.get(PHYSICAL_NAME)}


def physical_schema(schema: T.StructType, names: Mapping[str, str]) -> T.StructType:
    return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields])
