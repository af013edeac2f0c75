"""Aggregation pipelines: a list of stages folded into one lazy DataFrame.

Some results depend on the order in which documents come: ``$first``, ``$last``, ``$push``, ``$addToSet``, ties of ``$sort``
and any ``$limit`` or ``$skip``. ``order`` names the columns that define it; the fold carries them along under hidden names.
Without it, such results follow whatever order Spark reads.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.paths import NESTED, NUMERIC, VARIANT, Field, quoted, resolve
from ..sources.schema import to_frame
from .filters import compile_filter
from .projection import project

HIDDEN = "__docquarry_order_"


@dataclass(frozen=True)
class _State:
    """``keys``: hidden columns, and whether each is descending, that order the rows; ``sorted``: the rows stand in it."""

    df: DataFrame
    keys: tuple[tuple[str, bool], ...] = ()
    sorted: bool = False

    @property
    def hidden(self) -> list[str]:
        return [k for k, _ in self.keys]

    def order(self) -> list[Column]:
        return [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first() for k, down in self.keys]

    def in_order(self) -> DataFrame:
        return self.df if self.sorted or not self.keys else self.df.orderBy(*self.order())


def _path(spec: object, what: str) -> str:
    if not isinstance(spec, str) or not spec.startswith("$") or len(spec) < 2:
        raise ValidationError(f"{what} needs a field path such as '$field'", what, spec)
    return spec[1:]


def _fresh(state: _State) -> str:
    return f"{HIDDEN}{len(state.keys)}_{sum(c.startswith(HIDDEN) for c in state.df.columns)}"


def _match(state: _State, spec: object) -> _State:
    return _State(state.df.where(compile_filter(state.df, spec)), state.keys, state.sorted)


def _numeric(f: Field) -> Column | None:
    if not f.exists:
        return None
    if f.family == VARIANT:
        return F.when(F.schema_of_variant(f.column).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(f.column, "$", "double"))
    return f.column if f.family == NUMERIC else None


def _plain(f: Field) -> Column:
    """The field as a value; a variant as its JSON-typed string, since variants can be neither grouped nor compared."""
    if not f.exists:
        return F.lit(None).cast("string")
    return F.try_variant_get(f.column, "$", "string") if f.family == VARIANT else f.column


#: Fixed names of the language's accumulators.
ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$first", "$last", "$push", "$addToSet", "$count", "$stdDevPop", "$stdDevSamp")


def _sum(df: DataFrame, operand: object) -> Column:
    if isinstance(operand, bool):
        raise ValidationError("$sum needs a number, a path or an accumulator", "$sum", operand)
    if isinstance(operand, (int, float)):
        return F.count(F.lit(1)) * F.lit(operand)
    if isinstance(operand, Mapping):  # the sum of the inner accumulator over single documents
        op, inner = _single(operand, "$sum")
        if op in ("$sum", "$avg", "$min", "$max", "$first", "$last"):
            return _sum(df, inner)
        return F.count(F.lit(1)) if op == "$count" else F.lit(0).cast("long") * F.count(F.lit(1))
    column = _numeric(resolve(df, _path(operand, "$sum")))
    return F.lit(0).cast("long") * F.count(F.lit(1)) if column is None else F.coalesce(F.sum(column), F.lit(0))


def _single(spec: object, name: str) -> tuple[str, object]:
    if not isinstance(spec, Mapping) or len(spec) != 1:
        raise ValidationError(f"{name} needs an object with one accumulator", name, spec)
    op, operand = next(iter(spec.items()))
    if op not in ACCUMULATORS:
        raise ValidationError(f"unknown accumulator {op}; accumulators are {', '.join(ACCUMULATORS)}", name, op)
    return op, operand


def _accumulate(df: DataFrame, name: str, spec: object, rank: Column | None) -> Column:
    op, operand = _single(spec, name)
    if op == "$sum":
        return _sum(df, operand)
    if op == "$count":
        return F.count(F.lit(1))
    f = resolve(df, _path(operand, op))
    if op in ("$avg", "$stdDevPop", "$stdDevSamp"):
        column = _numeric(f)
        column = F.lit(None).cast("double") if column is None else column
        return {"$avg": F.avg, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}[op](column)
    if op in ("$min", "$max"):
        column = F.lit(None).cast("string") if f.family == NESTED else _plain(f)
        return (F.min if op == "$min" else F.max)(column)
    boxed = F.struct(_plain(f).alias("v"))  # keeps nulls
    if op in ("$first", "$last"):
        if rank is None:
            return (F.first if op == "$first" else F.last)(boxed).getField("v")
        return (F.min_by if op == "$first" else F.max_by)(boxed, rank).getField("v")
    listed = F.collect_list(boxed) if rank is None else F.array_sort(F.collect_list(F.struct(rank.alias("r"), boxed.alias("b")))).getField("b")
    values = listed.getField("v")
    return F.array_distinct(values) if op == "$addToSet" else values


def _group(state: _State, spec: object) -> _State:
    if not isinstance(spec, Mapping) or "_id" not in spec:
        raise ValidationError("$group needs an _id", "$group", spec)
    df, key = state.df, spec["_id"]
    if key is None:
        keys = F.lit(None).cast("string")  # a literal key: no input rows, no group
    elif isinstance(key, str):
        keys = _plain(resolve(df, _path(key, "_id")))
    elif isinstance(key, Mapping) and key:
        keys = F.struct(*[_plain(resolve(df, _path(v, f"_id.{k}"))).alias(k) for k, v in key.items()])
    else:
        raise ValidationError("_id is null, a path or an object of paths", "_id", key)
    accumulators = {k: v for k, v in spec.items() if k != "_id"}
    ordered = [v for v in accumulators.values() if isinstance(v, Mapping) and next(iter(v), None) in ("$first", "$last", "$push", "$addToSet")]
    rank = None
    if state.keys:
        if not any(down for _, down in state.keys):
            rank = F.struct(*[F.col(k) for k in state.hidden])
        elif ordered:  # descending keys have no general ascending form: number the rows within their groups
            df = df.withColumn(f"{HIDDEN}rank", F.row_number().over(Window.partitionBy(keys).orderBy(*state.order())))
            rank = F.col(f"{HIDDEN}rank")
    columns = [_accumulate(df, name, acc, rank).alias(name) for name, acc in accumulators.items()]
    if rank is None or any(down for _, down in state.keys):
        out = df.groupBy(keys.alias("_id")).agg(*columns) if columns else df.select(keys.alias("_id")).distinct()
        return _State(out)
    out = df.groupBy(keys.alias("_id")).agg(*columns, F.min(rank).alias(f"{HIDDEN}0"))
    return _State(out, ((f"{HIDDEN}0", False),))  # groups in the order first seen


def _project(state: _State, spec: object) -> _State:
    return _State(project(state.df, spec, state.hidden), state.keys, state.sorted)


def _sort(state: _State, spec: object, collation: str | None) -> _State:
    if not isinstance(spec, Mapping) or not spec or any(v not in (1, -1) or isinstance(v, bool) for v in spec.values()):
        raise ValidationError("$sort needs fields with 1 or -1", "$sort", spec)
    df, keys = state.df, []
    for n, (name, way) in enumerate(spec.items()):
        f = resolve(state.df, name)
        column = _plain(f)
        if collation and isinstance(f.kind, T.StringType):
            column = F.collate(column, collation)
        hidden = f"{HIDDEN}s{len(state.keys)}_{n}"
        df = df.withColumn(hidden, column)
        keys.append((hidden, way == -1))
    out = _State(df, (*keys, *state.keys))  # stable: ties keep the order they came in
    return _State(df.orderBy(*out.order()), out.keys, True)


def _count_of(spec: object, stage: str) -> int:
    if isinstance(spec, bool) or not isinstance(spec, int) or spec < 0:
        raise ValidationError(f"{stage} needs a non-negative integer", stage, spec)
    return spec


def _limit(state: _State, spec: object) -> _State:
    return _State(state.in_order().limit(_count_of(spec, "$limit")), state.keys, bool(state.keys))


def _skip(state: _State, spec: object) -> _State:
    return _State(state.in_order().offset(_count_of(spec, "$skip")), state.keys, bool(state.keys))


def _unwind(state: _State, spec: object) -> _State:
    keep = False
    if isinstance(spec, Mapping):
        keep, spec = bool(spec.get("preserveNullAndEmptyArrays", False)), spec.get("path")
    path = _path(spec, "$unwind")
    f = resolve(state.df, path)
    df, name = state.df, _fresh(state)
    empty = not f.exists or not isinstance(f.kind, T.ArrayType)
    if empty and not keep:
        return _State(df.where(F.lit(False)), state.keys, state.sorted)
    parts = path.split(".")
    if empty:
        value, out = F.lit(None), df
        if f.exists and len(parts) == 1:
            out = df.withColumn(parts[0], value.cast(f.kind))
        return _State(out, state.keys, state.sorted)
    explode = F.posexplode_outer if keep else F.posexplode
    out = df.select(*[df[quoted(c)] for c in df.columns], explode(f.column).alias(name, f"{name}_v"))
    value = F.col(f"{name}_v")
    if len(parts) == 1 or path in df.columns:
        out = out.withColumn(path, value)
    else:
        out = out.withColumn(parts[0], F.col(quoted(parts[0])).withField(".".join(quoted(p) for p in parts[1:]), value))
    out = out.select(*[out[quoted(c)] for c in df.columns], *([F.col(name)] if state.keys else []))
    return _State(out, (*state.keys, (name, False)) if state.keys else (), state.sorted)


def _count_stage(state: _State, spec: object) -> _State:
    """An extension: one row with the number of documents; none for no documents."""
    if not isinstance(spec, str) or not spec or spec.startswith("$"):
        raise ValidationError("$count needs a field name", "$count", spec)
    return _State(state.df.groupBy(F.lit(1).alias(HIDDEN)).agg(F.count(F.lit(1)).alias(spec)).drop(HIDDEN))


STAGES = ("$match", "$group", "$project", "$sort", "$limit", "$skip", "$unwind", "$count")


def aggregate(source: DataFrame | Sequence[Mapping], pipeline: Sequence[Mapping], order: Sequence[str] = (), collation: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Fold the stages over ``source`` (a DataFrame, or a list of documents). ``collation``: for strings in ``$sort``, such as
    'UNICODE'; binary order else."""
    return _fold(source, pipeline, order, collation, spark)[0]


def _fold(source, pipeline, order, collation, spark) -> tuple[DataFrame, DataFrame | None]:
    if not isinstance(source, DataFrame):
        spark = spark or SparkSession.getActiveSession()
        rows = [dict(r) | {f"{HIDDEN}0": i} for i, r in enumerate(source)]
        source = to_frame(spark, rows) if rows else spark.createDataFrame([], f"{HIDDEN}0 long")
        state = _State(source, ((f"{HIDDEN}0", False),))
    else:
        df = source
        for n, name in enumerate(order):
            df = df.withColumn(f"{HIDDEN}{n}", resolve(source, name).column)
        state = _State(df, tuple((f"{HIDDEN}{n}", False) for n in range(len(order))))
    if isinstance(pipeline, (str, Mapping)):
        raise ValidationError("a pipeline is a list of stages", "pipeline", pipeline)
    groups = None
    for stage in pipeline:
        if not isinstance(stage, Mapping) or len(stage) != 1:
            raise ValidationError("a stage is an object with one operator", "pipeline", stage)
        name, spec = next(iter(stage.items()))
        if name not in STAGES:
            raise ValidationError(f"unknown stage {name}; stages are {', '.join(STAGES)}", "pipeline", name)
        if name == "$sort":
            state = _sort(state, spec, collation)
        else:
            state = {"$match": _match, "$group": _group, "$project": _project, "$limit": _limit, "$skip": _skip, "$unwind": _unwind, "$count": _count_stage}[name](state, spec)
        if name == "$group":
            groups = state.df
    return state.df.drop(*state.hidden), groups


@dataclass
class PipelineResult:
    documents: list
    documents_processed: int
    groups_created: int | None
    execution_ms: float
    extra: dict = field(default_factory=dict)


def aggregate_with_stats(source: DataFrame | Sequence[Mapping], pipeline: Sequence[Mapping], order: Sequence[str] = (), collation: str | None = None, spark: SparkSession | None = None) -> PipelineResult:
    """Run the pipeline and fetch its documents, with the counts that a driver wants to show. Input rows are counted in the
    same pass."""
    began = time.perf_counter()
    seen = None
    if isinstance(source, DataFrame):
        seen = Observation()
        source = source.observe(seen, F.count(F.lit(1)).alias("n"))
    out, groups = _fold(source, pipeline, order, collation, spark)
    documents = [r.asDict(recursive=True) for r in out.collect()]
    made = None if groups is None else (len(documents) if groups.columns == out.columns and not any(k in s for s in pipeline for k in ("$limit", "$skip", "$match", "$unwind")) else groups.count())
    processed = len(source) if seen is None else seen.get["n"]
    return PipelineResult(documents, processed, made, (time.perf_counter() - began) * 1000)
