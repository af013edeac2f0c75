"""Document filters compiled to Spark predicates.

The filter language is two-valued: every predicate is true or false, also on null or missing fields. Spark's is three-valued,
so negations are driven down to the comparisons (De Morgan), where each has a form that is true exactly when the comparison
is not. The result only combines with AND and OR and is bare comparisons wherever possible, which reach the Parquet scan.

Values of different type families never match; the check happens here, against the schema, so Spark never coerces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.paths import BINARY, BOOLEAN, NESTED, NULL, NUMERIC, STRING, TEMPORAL, VARIANT, Field, resolve, value_family

#: Fixed values of the language.
LOGICAL = ("$and", "$or", "$nor", "$not")
COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$type", "$regex")
LONGEST_INPUT, LONGEST_PATTERN = 10_000, 1_000

TRUE, FALSE = True, False  # results known while compiling
Predicate = Column | bool


def is_operator_object(value: object) -> bool:
    return isinstance(value, Mapping) and bool(value) and all(isinstance(k, str) and k.startswith("$") for k in value)


def validate_filter(spec: object) -> None:
    """Raise ValidationError unless the filter is well formed."""
    if not isinstance(spec, Mapping):
        raise ValidationError("a filter is an object", "filter", spec)
    for key, value in spec.items():
        if not isinstance(key, str):
            raise ValidationError("filter keys are strings", "filter", key)
        if key == "$not":
            if not isinstance(value, Mapping):
                raise ValidationError("$not needs an object", key, value)
            validate_filter(value)
        elif key in LOGICAL:
            if not isinstance(value, (list, tuple)):
                raise ValidationError(f"{key} needs an array", key, value)
            for part in value:
                validate_filter(part)
        elif key.startswith("$"):
            raise ValidationError(f"unknown operator {key}; logical operators are {', '.join(LOGICAL)}", key, value)
        elif isinstance(value, Mapping):
            for op in value:
                if op not in COMPARISONS:
                    raise ValidationError(f"unknown operator {op} on {key}; operators are {', '.join(COMPARISONS)}", key, op)


def _all(parts: list[Predicate]) -> Predicate:
    if any(p is FALSE for p in parts):
        return FALSE
    columns = [p for p in parts if p is not TRUE]
    return reduce(lambda a, b: a & b, columns) if columns else TRUE


def _any(parts: list[Predicate]) -> Predicate:
    if any(p is TRUE for p in parts):
        return TRUE
    columns = [p for p in parts if p is not FALSE]
    return reduce(lambda a, b: a | b, columns) if columns else FALSE


#: Families by what schema_of_variant says.
_VARIANT_KINDS = {
    NUMERIC: (r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$", "double"),
    STRING: (r"^STRING", "string"),
    BOOLEAN: (r"^BOOLEAN$", "boolean"),
    TEMPORAL: (r"^(DATE|TIMESTAMP.*)$", "timestamp"),
    BINARY: (r"^BINARY$", "binary"),
}


class Compiler:
    """Compiles filters against one DataFrame's schema."""

    def __init__(self, df: DataFrame):
        self.df = df

    def where(self, spec: Mapping, holds: bool = True) -> Predicate:
        """A predicate that is true where the filter holds, or with ``holds=False`` where it doesn't; else false or null."""
        parts = [self._entry(k, v, holds) for k, v in spec.items()]
        return _all(parts) if holds else _any(parts)

    def _entry(self, key: str, value: object, holds: bool) -> Predicate:
        if key == "$not":
            return self.where(value, not holds)
        if key in LOGICAL:
            if key == "$nor":
                holds = not holds
            parts = [self.where(v, holds) for v in value]
            return (_all if (key == "$and") == holds else _any)(parts)
        field = resolve(self.df, key)
        if isinstance(value, Mapping) and not value or is_operator_object(value):
            parts = [self.compare(field, op, v, holds) for op, v in value.items()]
            return _all(parts) if holds else _any(parts)
        return self.compare(field, "$eq", value, holds)

    def compare(self, field: Field, op: str, value: object, holds: bool = True) -> Predicate:
        if op in ("$ne", "$nin"):
            positive = "$eq" if op == "$ne" else "$in"
            if op == "$nin" and not isinstance(value, (list, tuple)):
                return TRUE if holds else FALSE
            return self.compare(field, positive, value, not holds)
        handler: Callable[[Field, object, bool], Predicate] = {
            "$eq": self._eq,
            "$in": self._in,
            "$exists": self._exists,
            "$type": self._type,
            "$regex": self._regex,
        }.get(op) or (lambda f, v, h: self._range(f, op, v, h))
        return handler(field, value, holds)

    def _operand(self, field: Field, family: str) -> Column | None:
        """The field as a column of that family; None if it can't have such values. Null where a variant holds another kind."""
        if not field.exists:
            return None
        if field.family == VARIANT:
            pattern, kind = _VARIANT_KINDS[family]
            return F.when(F.schema_of_variant(field.column).rlike(pattern), F.try_variant_get(field.column, "$", kind))
        return field.column if field.family == family else None

    @staticmethod
    def _missing(field: Field, holds: bool) -> Predicate:
        if not field.exists:
            return TRUE if holds else FALSE
        return field.column.isNull() if holds else field.column.isNotNull()

    def _eq(self, field: Field, value: object, holds: bool) -> Predicate:
        family = value_family(value)
        if family == NULL:
            if field.exists and field.family == VARIANT:  # a null in a document is not a missing field
                null = F.coalesce(F.is_variant_null(field.column), F.lit(False))
                return null if holds else ~null
            return self._missing(field, holds)
        if family == NESTED:
            raise ValidationError("equality with arrays and objects is not supported", field.path, value)
        column = self._operand(field, family)
        if column is None or (isinstance(value, float) and math.isnan(value)):
            return FALSE if holds else TRUE
        return column == F.lit(value) if holds else ~column.eqNullSafe(F.lit(value))

    def _range(self, field: Field, op: str, value: object, holds: bool) -> Predicate:
        family = value_family(value)
        column = self._operand(field, family) if family in (NUMERIC, STRING, TEMPORAL) else None
        if column is None or (isinstance(value, float) and math.isnan(value)):
            return FALSE if holds else TRUE
        v = F.lit(value)
        real = isinstance(field.kind, (T.FloatType, T.DoubleType)) or field.family == VARIANT
        nan = F.isnan(column) if family == NUMERIC and real and op in ("$gt", "$gte") else None  # Spark orders NaN last
        if holds:
            met = {"$gt": column > v, "$gte": column >= v, "$lt": column < v, "$lte": column <= v}[op]
            return met if nan is None else met & ~nan
        unmet = column.isNull() | {"$gt": column <= v, "$gte": column < v, "$lt": column >= v, "$lte": column > v}[op]
        return unmet if nan is None else unmet | nan

    def _in(self, field: Field, values: object, holds: bool) -> Predicate:
        if not isinstance(values, (list, tuple)):
            return FALSE if holds else TRUE
        parts: list[Predicate] = []
        families: dict[str, list] = {}
        for v in values:
            family = value_family(v)
            if family == NULL:
                parts.append(self._eq(field, None, holds))
            elif family == NESTED:
                raise ValidationError("membership of arrays and objects is not supported", field.path, v)
            else:
                families.setdefault(family, []).append(v)
        for family, some in families.items():
            column = self._operand(field, family)
            if column is None:
                continue
            plain = [v for v in some if v == v]
            if len(plain) < len(some):  # in lists, NaN matches NaN
                nan = F.isnan(column.cast("double"))
                parts.append(nan if holds else column.isNull() | ~nan)
            if plain:
                parts.append(column.isin(plain) if holds else column.isNull() | ~column.isin(plain))
        return _any(parts) if holds else _all(parts)

    def _exists(self, field: Field, value: object, holds: bool) -> Predicate:
        if not isinstance(value, bool):
            raise ValidationError("$exists needs true or false", field.path, value)
        return self._missing(field, value != holds)

    def _type(self, field: Field, names: object, holds: bool) -> Predicate:
        wanted = list(names) if isinstance(names, (list, tuple)) else [names]
        tests: list[Predicate] = [self._one_type(field, n) for n in wanted]
        found = _any(tests)
        if isinstance(found, bool) or holds:
            return found if holds else not found
        return ~F.coalesce(found, F.lit(False))

    def _one_type(self, field: Field, name: object) -> Predicate:
        kinds: dict[str, tuple[tuple, str]] = {
            "string": ((T.StringType,), r"^STRING"),
            "number": ((T.NumericType,), _VARIANT_KINDS[NUMERIC][0]),
            "int": ((T.ByteType, T.ShortType, T.IntegerType), r"^(TINYINT|SMALLINT|INT)$"),
            "long": ((T.LongType,), r"^BIGINT$"),
            "double": ((T.FloatType, T.DoubleType), r"^(FLOAT|DOUBLE)$"),
            "decimal": ((T.DecimalType,), r"^DECIMAL"),
            "bool": ((T.BooleanType,), r"^BOOLEAN$"),
            "boolean": ((T.BooleanType,), r"^BOOLEAN$"),
            "date": ((T.DateType, T.TimestampType, T.TimestampNTZType), _VARIANT_KINDS[TEMPORAL][0]),
            "timestamp": ((T.TimestampType, T.TimestampNTZType), r"^TIMESTAMP"),
            "binary": ((T.BinaryType,), r"^BINARY$"),
            "array": ((T.ArrayType,), r"^ARRAY"),
            "object": ((T.StructType, T.MapType), r"^OBJECT"),
        }
        if name == "null":
            return self._eq(field, None, True)
        if name not in kinds:
            raise ValidationError(f"unknown type {name}; types are null, {', '.join(kinds)}", field.path, name)
        classes, pattern = kinds[name]
        if not field.exists:
            return FALSE
        if field.family == VARIANT:
            return F.schema_of_variant(field.column).rlike(pattern)
        return field.column.isNotNull() if isinstance(field.kind, classes) else FALSE

    def _regex(self, field: Field, value: object, holds: bool) -> Predicate:
        pattern, flags = (value.pattern, value.flags) if isinstance(value, re.Pattern) else (value, 0)
        if not isinstance(pattern, str):
            raise ValidationError("$regex needs a string or a compiled pattern", field.path, value)
        if isinstance(value, str) and len(pattern) > LONGEST_PATTERN:
            raise ValidationError(f"a pattern has {LONGEST_PATTERN} characters at most", field.path, len(pattern))
        column = self._operand(field, STRING)
        if column is None:
            return FALSE if holds else TRUE
        marks = "".join(m for f, m in ((re.IGNORECASE, "i"), (re.MULTILINE, "m"), (re.DOTALL, "s")) if flags & f)
        # the limit counts UTF-16 units; only strings over half of it can reach it
        short = (F.length(column) <= LONGEST_INPUT // 2) | (F.octet_length(F.encode(column, "UTF-16BE")) <= 2 * LONGEST_INPUT)
        met = short & column.rlike(f"(?{marks}){pattern}" if marks else pattern)
        return met if holds else ~F.coalesce(met, F.lit(False))


def as_column(found: Predicate) -> Column:
    return F.lit(found) if isinstance(found, bool) else found


def compile_filter(df: DataFrame, spec: Mapping, total: bool = False) -> Column:
    """The filter as a column over ``df``. Where it doesn't hold the column is false or null; ``total``: always false."""
    validate_filter(spec)
    found = as_column(Compiler(df).where(spec))
    return F.coalesce(found, F.lit(False)) if total else found


def find(df: DataFrame, spec: Mapping | None = None) -> DataFrame:
    return df if not spec else df.where(compile_filter(df, spec))


def get_nested_value(document: object, path: str) -> object:
    """The value at a dotted path of a plain document (dicts and lists); None if the way is blocked or missing."""
    for part in path.split("."):
        if isinstance(document, Mapping):
            document = document.get(part)
        elif isinstance(document, (list, tuple)) and part.isdigit() and int(part) < len(document):
            document = document[int(part)]
        else:
            return None
    return document
