"""Projections: fields to include or exclude, dotted paths too."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.paths import quoted

Projection = Sequence[str] | Mapping[str, int]


def parse_projection(spec: Projection | None) -> tuple[str, list[str]]:
    """('all' | 'include' | 'exclude', fields). The first entry of an object sets the mode; entries that disagree are ignored."""
    if not spec:
        return "all", []
    if isinstance(spec, Mapping):
        if any(v not in (0, 1, True, False) for v in spec.values()):
            raise ValidationError("projection values are 0 or 1", "projection", dict(spec))
        mode = bool(next(iter(spec.values())))
        return ("include" if mode else "exclude"), [k for k, v in spec.items() if bool(v) == mode]
    if isinstance(spec, str) or not all(isinstance(f, str) for f in spec):
        raise ValidationError("a projection is a list of fields or an object", "projection", spec)
    return "include", list(spec)


def projection_columns(spec: Projection | None) -> list[str]:
    """Root columns that a projection needs; empty: all."""
    mode, fields = parse_projection(spec)
    return list(dict.fromkeys(f.split(".")[0] for f in fields)) if mode == "include" else []


def _tree(fields: list[str]) -> dict:
    tree: dict = {}
    for field in fields:
        node, parts = tree, field.split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
            if node is None:
                break
        else:
            node[parts[-1]] = None  # the whole field, also if parts of it were asked for before
    return tree


def _included(column: Column, kind: T.DataType, tree: dict) -> Column | None:
    if not isinstance(kind, T.StructType):
        return None  # a path into a scalar leads nowhere
    kept = []
    for field in kind.fields:
        if field.name in tree:
            inner = column.getField(field.name)
            inner = inner if tree[field.name] is None else _included(inner, field.dataType, tree[field.name])
            if inner is not None:
                kept.append(inner.alias(field.name))
    return F.when(column.isNotNull(), F.struct(*kept)) if kept else None


def project(df: DataFrame, spec: Projection | None, hidden: Sequence[str] = ()) -> DataFrame:
    """Apply a projection. Fields that the schema lacks are left out; ``hidden`` columns stay."""
    mode, fields = parse_projection(spec)
    if mode == "all":
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    if mode == "exclude":
        whole = [f for f in fields if f in types and f not in hidden]
        out = df.drop(*whole)
        for field in fields:
            head, _, rest = field.partition(".")
            if field not in types and rest and isinstance(types.get(head), T.StructType) and head not in whole and _has(types[head], rest.split(".")):
                out = out.withColumn(head, out[quoted(head)].dropFields(".".join(quoted(p) for p in rest.split("."))))
        return out
    tree = _tree([f for f in fields if f not in types])
    kept = []
    for name in dict.fromkeys([f if f in types else f.split(".")[0] for f in fields]):
        if name not in types or name in hidden:
            continue
        column = df[quoted(name)] if name in fields else _included(df[quoted(name)], types[name], tree[name])
        if column is not None:
            kept.append(column.alias(name))
    return df.select(*kept, *[df[quoted(h)] for h in hidden])


def _has(kind: T.DataType, parts: list[str]) -> bool:
    for part in parts:
        found = next((f.dataType for f in kind.fields if f.name == part), None) if isinstance(kind, T.StructType) else None
        if found is None:
            return False
        kind = found
    return True
