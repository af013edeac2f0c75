"""Deduplication of rows: exact, or by key with the first, last or latest row kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.paths import quoted

KEEP = ("first", "last", "latest")


def _comparable(df: DataFrame, name: str):
    """A column that can be grouped by: variants and maps as JSON text."""
    kind = df.schema[name].dataType
    c = F.col(quoted(name))
    return F.to_json(c) if isinstance(kind, (T.VariantType, T.MapType)) else c


def deduplicate_exact(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of each set of equal rows, comparing ``columns`` (all by default). Partial aggregation before the shuffle."""
    names = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not any(isinstance(kinds[n], (T.VariantType, T.MapType)) for n in names):
        return df.dropDuplicates(names)
    keyed = df.select("*", *[_comparable(df, n).alias(f"__k{i}") for i, n in enumerate(names)])
    return keyed.dropDuplicates([f"__k{i}" for i in range(len(names))]).select(*[quoted(c) for c in df.columns])


def deduplicate_by_key(df: DataFrame, keys: Sequence[str], keep: str = "first", order: Sequence[str] = (), order_by: str | None = None) -> DataFrame:
    """One row per key. ``order``: columns that give the encounter order. 'latest': the greatest ``order_by``, the first of
    ties; a null never wins over a value. Null keys are a key like others.

    The choice is a minimum or maximum over structs, so it is pre-aggregated and a hot key moves one row per task.
    """
    if keep not in KEEP:
        raise ValidationError(f"keep is one of {', '.join(KEEP)}", "keep", keep)
    if not keys or any(k not in df.columns for k in keys):
        raise ValidationError("keys must be columns", "keys", list(keys))
    if keep == "latest" and order_by not in df.columns:
        raise ValidationError("'latest' needs order_by", "order_by", order_by)
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    at = F.struct(*[F.col(quoted(c)) for c in order]) if order else F.struct(F.monotonically_increasing_id().alias("i"))
    grouped = df.select(*[_comparable(df, k).alias(f"__k{i}") for i, k in enumerate(keys)], row.alias("__row"), at.alias("__at"), *([F.col(quoted(order_by)).alias("__by")] if keep == "latest" else []))
    group = grouped.groupBy(*[f"__k{i}" for i in range(len(keys))])
    if keep == "first":
        best = F.min_by("__row", "__at")
    elif keep == "last":
        best = F.max_by("__row", "__at")
    else:
        # the first row of each value, then that of the greatest value; a null never wins over a value
        names = [f"__k{i}" for i in range(len(keys))]
        firsts = grouped.groupBy(*names, "__by").agg(F.min_by("__row", "__at").alias("__row"))
        group, best = firsts.groupBy(*names), F.max_by("__row", F.struct(F.col("__by").isNotNull(), "__by"))
    return group.agg(best.alias("__row")).select("__row.*")


def duplicate_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(extra_copies, n_keys): how many keys have how many rows beyond their first; unique keys are 0."""
    return df.groupBy(*[_comparable(df, k).alias(k) for k in keys]).agg((F.count(F.lit(1)) - 1).alias("extra_copies")).groupBy("extra_copies").agg(F.count(F.lit(1)).alias("n_keys"))
