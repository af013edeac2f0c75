"""Space-filling-curve keys as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from .paths import quoted


def interleave(columns: Sequence[Column], bits: int = 21) -> Column:
    """Morton key: bit i of column d becomes bit ``i * n + d``. Columns are non-negative integers below 2**bits; all bits
    must fit a BIGINT."""
    n = len(columns)
    if not n or n * bits > 63:
        raise ValidationError(f"{n} columns of {bits} bits don't fit a 63-bit key", "columns", n)
    parts = [F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1)), i * n + d) for d, c in enumerate(columns) for i in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def hilbert(columns: Sequence[Column], bits: int = 16) -> Column:
    """Hilbert key of two columns, most significant bit first."""
    if len(columns) != 2:
        raise ValidationError("the Hilbert key takes two columns", "columns", len(columns))
    state = F.struct(columns[0].cast("long").alias("x"), columns[1].cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, i: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits - 1) - i)
        rx, ry = (acc["x"].bitwiseAND(side) > 0).cast("long"), (acc["y"].bitwiseAND(side) > 0).cast("long")
        d = acc["d"] + side * side * (F.lit(3) * rx).bitwiseXOR(ry)
        top = F.lit((1 << bits) - 1).cast("long")
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, top - acc["x"]).otherwise(acc["x"]), F.when(flip, top - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), state, step)["d"]


def spread(df: DataFrame, names: Sequence[str], bits: int) -> list[Column]:
    """Each column as an integer of ``bits`` bits that keeps its order, by where a value stands among sampled quantiles
    (strings too); nulls are 0. Bounds come from one pass over the frame."""
    cells = (1 << min(bits, 10)) - 1
    out = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if missing := [n for n in names if n not in kinds]:
        raise ValidationError(f"unknown columns {missing}", "columns", missing)
    numeric = {n: _number(F.col(quoted(n)), kinds[n]) for n in names}
    bounds = df.agg(*[F.percentile_approx(c, [i / cells for i in range(1, cells)], 10_000).alias(f"q{i}") for i, c in enumerate(numeric.values())]).collect()[0]  # one row
    for i, c in enumerate(numeric.values()):
        limits = sorted(set(bounds[f"q{i}"] or []))
        out.append(F.coalesce(F.shiftleft(_rank(c, limits), max(0, bits - 10)), F.lit(0)))
    return out


def _rank(c: Column, limits: Sequence[float]) -> Column:
    """How many limits lie below the value, by binary search in a literal array; null for null."""
    if not limits:
        return F.when(c.isNotNull(), 0)
    steps = len(limits).bit_length()
    array = F.array(*[F.lit(float(v)) for v in limits], *[F.lit(float("inf"))] * ((1 << steps) - 1 - len(limits)))

    def step(low: Column, half: Column) -> Column:
        return F.when(F.element_at(array, low + half) < c, low + half).otherwise(low)

    below = F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(steps))]), F.lit(0), step)
    return F.when(c.isNotNull(), below)


def _number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):  # the first six bytes as a number keep binary order
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    raise ValidationError(f"can't order by columns of type {kind.simpleString()}", "columns", kind.simpleString())
