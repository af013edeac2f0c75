"""Versioned tables: Parquet files under a transaction log.

Every read, delete, update, merge and maintenance job goes through one scan (deletion vectors, column mapping, partition and
file pruning), and every write through one commit (stage the files, then publish them). Staged files that never get
published are litter for ``vacuum``. Data files hold all columns, partition columns too, so each can be read by itself;
the folders of partitions only keep files apart.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConcurrencyError, ValidationError
from ..functions.paths import quoted
from ..operators.filters import compile_filter, validate_filter
from ..operators.pipeline import PipelineResult, aggregate, aggregate_with_stats
from ..operators.projection import Projection, parse_projection, project, projection_columns
from ..plans.pushdown import column_predicates, file_can_match, partition_predicates, same_partition
from .log import PROTOCOL, Action, CheckpointPolicy, Snapshot, TransactionLog, add_action, now_ms, parse_stats, remove_action
from .schema import conform, infer_schema, merge_schemas, physical_names, physical_schema, to_frame
from .storage import Storage, open_storage, parse_location
from .vectors import parse_vector, vector_bytes

DATA, STAGED = "data", "__part_"
FILE, ROW = "__file", "__row"  # hidden columns of a scan: file path and row ordinal
#: Names of hidden columns, which a table can't have as its own.
RESERVED = frozenset({FILE, ROW, "__name", "__seq", "__sid", "__place", "__key", "__bin", "__dst", "__src"})
_ORDERED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
Rows = DataFrame | Sequence[Mapping]


class Table:
    """A table at a path or URL. Methods that write return the new version."""

    def __init__(self, spark: SparkSession, location: str, *, storage: Storage | None = None, policy: CheckpointPolicy = CheckpointPolicy(), compression: str = "snappy"):
        self.spark, self.root = spark, parse_location(location).uri.rstrip("/")
        self.storage = storage or open_storage(location, spark)
        self.log = TransactionLog(spark, self.storage, self.root, policy)
        self.compression = compression
        self.last_skipped_files = 0
        self.last_projection_columns: list[str] = []
        self._known: int | None = None  # the version that this writer builds on

    # State

    def version(self) -> int:
        if self._known is None:
            self._known = self.log.version()
        return self._known

    def refresh_version(self) -> int:
        self._known = None
        return self.version()

    def snapshot(self, version: int | None = None) -> Snapshot:
        return self.log.snapshot(version)

    def exists(self) -> bool:
        return self.log.version() >= 0

    def schema(self) -> T.StructType:
        return self.snapshot().schema

    # Reading

    def _pick(self, version: int | None, timestamp_ms: int | None, snapshot: Snapshot | None) -> Snapshot:
        if sum(x is not None for x in (version, timestamp_ms, snapshot)) > 1:
            raise ValidationError("give one of version, timestamp and snapshot", "options", None)
        if snapshot is not None:
            if not isinstance(snapshot, Snapshot):
                raise ValidationError("snapshot must be a Snapshot", "snapshot", snapshot)
            return snapshot
        if version is not None and (isinstance(version, bool) or not isinstance(version, int) or version < 0):
            raise ValidationError("version must be a non-negative integer", "version", version)
        return self.snapshot(self.log.version_as_of(timestamp_ms) if timestamp_ms is not None else version)

    def _files(self, snap: Snapshot, spec: Mapping) -> list[dict]:
        """Live files that may hold a match, by partition values and by statistics."""
        allowed = partition_predicates(spec, snap.partition_columns)
        predicates = column_predicates(spec)
        kept = []
        for f in snap.files.values():
            values = f.get("partitionValues") or {}
            if any(c in values and not same_partition(values[c], some) for c, some in allowed.items()):
                continue
            if file_can_match(parse_stats(f["stats"]) if f.get("stats") and predicates else None, predicates):
                kept.append(f)
        self.last_skipped_files = len(snap.files) - len(kept)
        return kept

    def _path(self, file: Mapping) -> str:
        return f"{self.root}/{file['path']}"

    def _scan(self, snap: Snapshot, files: Sequence[Mapping], hidden: bool = False) -> DataFrame:
        """All rows of the files; with ``hidden`` also their file path and ordinal."""
        if snap.metadata is None:
            return self.spark.createDataFrame([], T.StructType())
        schema = snap.schema
        names = physical_names(schema, snap.configuration)
        vectors = {f["path"]: f["deletionVector"] for f in files if f.get("deletionVector")}
        extra = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)] if hidden or vectors else []
        if not files:
            out = self.spark.createDataFrame([], T.StructType([*schema.fields, *([T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())] if hidden else [])]))
            return out
        df = self.spark.read.schema(physical_schema(schema, names)).parquet(*[self._path(f) for f in files])
        df = df.select(*[F.col(quoted(names.get(f.name, f.name))).alias(f.name) for f in schema.fields], *extra)
        if vectors:
            # compressed bitmaps travel; the executors unfold them
            packed = [(p, bytearray(vector_bytes(self.storage, v)), v.get("cardinality")) for p, v in vectors.items()]
            gone = self.spark.createDataFrame(packed, "dead string, bitmap binary, cardinality long").mapInPandas(unfolded, f"dead string, {ROW}_dead long")
            df = df.withColumn("__name", self._relative(F.col(FILE)))
            df = df.join(gone, (F.col("__name") == F.col("dead")) & (F.col(ROW) == F.col(f"{ROW}_dead")), "left_anti").drop("__name")
            if not hidden:
                df = df.drop(FILE, ROW)
        return df

    def _relative(self, file_path: Column) -> Column:
        """A file's path as the log names it."""
        return F.regexp_extract(F.url_decode(F.regexp_replace(file_path, r"\+", "%2B")), rf"/({DATA}/.*)$", 1)

    def find(self, spec: Mapping | None = None, projection: Projection | None = None, limit: int | None = None, *, version: int | None = None, timestamp_ms: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Matching rows, lazily. Files are pruned by partition values and statistics; the rest of the filter and the columns
        go down to the Parquet scan."""
        spec = spec or {}
        validate_filter(spec)
        parse_projection(projection)
        snap = self._pick(version, timestamp_ms, snapshot)
        self.last_projection_columns = projection_columns(projection)
        df = self._scan(snap, self._files(snap, spec))
        if spec:
            df = df.where(compile_filter(df, spec))
        df = project(df, projection)
        return df if limit is None else df.limit(limit)

    def count(self, spec: Mapping | None = None) -> int:
        return self.find(spec).count()

    def rows(self, spec: Mapping | None = None, **options) -> Iterator[dict]:
        """One document at a time; holds one partition on the driver."""
        for row in self.find(spec, **options).toLocalIterator():
            yield row.asDict(recursive=True)

    def batches(self, spec: Mapping | None = None, size: int = 1000, **options) -> Iterator[list[dict]]:
        """Lists of ``size`` documents; the last may be shorter."""
        if isinstance(size, bool) or not isinstance(size, int) or size < 1:
            raise ValidationError("batch size must be a positive integer", "size", size)
        batch: list[dict] = []
        for row in self.rows(spec, **options):
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def ordered(self, snap: Snapshot | None = None) -> tuple[DataFrame, list[str]]:
        """All rows with hidden columns that give the table's own order: commit order of files, then position."""
        snap = snap or self.snapshot()
        files = list(snap.files.values())
        df = self._scan(snap, files, hidden=True)
        ranks = self.spark.createDataFrame([(f["path"], i) for i, f in enumerate(files)], "__name string, __seq long")
        return df.withColumn("__name", self._relative(F.col(FILE))).join(ranks, "__name").drop("__name", FILE), ["__seq", ROW]

    def aggregate(self, pipeline: Sequence[Mapping], collation: str | None = None) -> DataFrame:
        """A pipeline over the table, lazily; leading $match stages prune files."""
        spec = {"$and": [s["$match"] for s in _leading_matches(pipeline)]}
        for part in spec["$and"]:
            validate_filter(part)
        snap = self.snapshot()
        if not _needs_order(pipeline):
            df = self._scan(snap, self._files(snap, spec))
            return aggregate(df, pipeline, collation=collation)
        pruned = dataclasses.replace(snap, files={f["path"]: f for f in self._files(snap, spec)})
        df, order = self.ordered(pruned)
        return aggregate(df, pipeline, order=order, collation=collation).drop(*order)

    def aggregate_with_stats(self, pipeline: Sequence[Mapping]) -> PipelineResult:
        df, order = self.ordered()
        result = aggregate_with_stats(df, pipeline, order=order)
        for d in result.documents:
            for name in order:
                d.pop(name, None)
        return result

    # Writing

    def _as_frame(self, rows: Rows) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        if not isinstance(rows, Sequence) or isinstance(rows, (str, bytes)) or not rows:
            raise ValidationError("rows must be a non-empty list of objects", "rows", rows)
        infer_schema(rows)
        return to_frame(self.spark, rows)

    def _stage(self, df: DataFrame, schema: T.StructType, partitions: Sequence[str], names: Mapping[str, str], folder: str = DATA, data_change: bool = True, stats: bool = True, keep_layout: bool = False) -> list[Action]:
        """Write data files and describe them. Not visible until a commit names them. Rows of a partition meet in one task,
        unless ``keep_layout``."""
        out = conform(df, schema)
        hidden = [f"{STAGED}{c}" for c in partitions]
        if partitions:
            out = out.select("*", *[F.col(quoted(c)).cast("string").alias(h) for c, h in zip(partitions, hidden, strict=True)])
            if not keep_layout:
                # a hint to rebalance: adaptive execution splits a large partition value over several tasks and files
                out = out.hint("rebalance", *[F.col(h) for h in hidden])
        out = out.withColumnsRenamed(dict(names)) if names else out
        stage = f"{folder}/{uuid.uuid4().hex}"
        writer = out.write.option("compression", self.compression).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        (writer.partitionBy(*hidden) if hidden else writer).parquet(f"{self.root}/{stage}")
        paths = [p for p in self.storage.list(stage) if p.endswith(".parquet")]
        found = self._statistics(paths, schema, names) if stats and paths else {}
        actions = []
        for p in paths:
            s = found.get(p)
            if stats and (s is None or not s["numRecords"]):
                self.storage.delete(p)  # a task without rows
                continue
            values = {c: _partition_value(p, h) for c, h in zip(partitions, hidden, strict=True)}
            actions.append(add_action(p, self.storage.stat(p).size, values, s, data_change))
        return actions

    def _statistics(self, paths: Sequence[str], schema: T.StructType, names: Mapping[str, str]) -> dict[str, dict]:
        """Row count, bounds and null counts by file, in one pass over what was written."""
        df = self.spark.read.schema(physical_schema(schema, names)).parquet(*[f"{self.root}/{p}" for p in paths])
        columns = [f for f in schema.fields if isinstance(f.dataType, _ORDERED)]
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(columns):
            c = F.col(quoted(names.get(f.name, f.name)))
            real = isinstance(f.dataType, (T.FloatType, T.DoubleType))
            bounds = F.when(~F.isnan(c), c) if real else c
            aggs += [F.min(bounds).alias(f"l{i}"), F.max(bounds).alias(f"h{i}"), F.count_if(c.isNull()).alias(f"z{i}")]
            if real:
                aggs.append(F.count_if(F.isnan(c)).alias(f"q{i}"))
        out = {}
        for r in df.groupBy(self._relative(F.col("_metadata.file_path")).alias("p")).agg(*aggs).collect():  # a row per new file
            # a NaN is in no interval, so a column that has one gets no bounds
            known = [(i, f) for i, f in enumerate(columns) if f"q{i}" not in r or not r[f"q{i}"]]
            out[r["p"]] = {
                "numRecords": r["n"],
                "minValues": {f.name: _plain(r[f"l{i}"], f.dataType) for i, f in known if r[f"l{i}"] is not None},
                "maxValues": {f.name: _plain(r[f"h{i}"], f.dataType) for i, f in known if r[f"h{i}"] is not None},
                "nullCount": {f.name: r[f"z{i}"] for i, f in enumerate(columns)},
            }
        return out

    def _commit(self, actions: Sequence[Action], operation: str, base: int, **info: object) -> int:
        stamp = {"commitInfo": {"timestamp": now_ms(), "operation": operation, "readVersion": base, **info}}
        version = self.log.commit(base + 1, [stamp, *actions])
        self._known = version
        self.log.checkpoint_if_due(version)
        return version

    def _base(self) -> int:
        """The version to build on; fails if another writer has moved on since this one last looked."""
        known, found = self.version(), self.log.version()
        self._known = found
        if known != found:
            raise ConcurrencyError(f"the table is at version {found}, not {known}; retry to build on it", known, found)
        return found

    def append(self, rows: Rows, partition_columns: Sequence[str] | None = None, configuration: Mapping[str, str] | None = None) -> int:
        """Add rows. Creates the table; later appends may bring new columns and wider numbers."""
        df = self._as_frame(rows)
        base = self._base()
        snap = self.snapshot(base) if base >= 0 else Snapshot()
        actions: list[Action] = []
        if snap.metadata is None:
            partitions = list(partition_columns or [])
            schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields])
        else:
            partitions, schema = snap.partition_columns, merge_schemas(snap.schema, df.schema)
            if partition_columns is not None and list(partition_columns) != partitions:
                raise ValidationError(f"the table is partitioned by {partitions}", "partition_columns", list(partition_columns))
        if taken := sorted(RESERVED & {c.lower() for c in schema.names}):
            raise ValidationError(f"reserved column names {taken}", "columns", taken)
        if missing := [c for c in partitions if c not in schema.names]:
            raise ValidationError(f"unknown partition columns {missing}", "partition_columns", missing)
        if snap.metadata is None:
            actions += [{"protocol": dict(PROTOCOL)}, {"metaData": _metadata(schema, partitions, configuration or {})}]
        elif schema != snap.schema:
            actions.append({"metaData": {**snap.metadata, "schemaString": schema.json()}})
        config = snap.configuration or dict(configuration or {})
        added = self._stage(df, schema, partitions, physical_names(schema, config))
        if not added:
            raise ValidationError("a write needs one row at least", "rows", 0)
        return self._commit([*actions, *added], "WRITE", base)

    def overwrite_files(self, snap: Snapshot, removed: Sequence[Mapping], df: DataFrame | None, operation: str, *, data_change: bool = True, extra: Sequence[Action] = (), **info: object) -> int:
        """Replace files by new ones with the frame's rows, in one commit."""
        names = physical_names(snap.schema, snap.configuration)
        added = [] if df is None else self._stage(df, snap.schema, snap.partition_columns, names, data_change=data_change)
        gone = [remove_action(f["path"], data_change) for f in removed]
        return self._commit([*extra, *gone, *added], operation, snap.version, **info)

    def _touched(self, snap: Snapshot, spec: Mapping) -> tuple[list[dict], DataFrame]:
        """Files with a match, and all their rows with the hidden columns."""
        candidates = self._files(snap, spec)
        df = self._scan(snap, candidates, hidden=True)
        hit = df.where(compile_filter(df, spec)).select(self._relative(F.col(FILE)).alias("p")).distinct()
        paths = {r["p"] for r in hit.collect()}  # a row per file
        files = [f for f in candidates if f["path"] in paths]
        return files, self._scan(snap, files, hidden=True)

    def delete(self, spec: Mapping) -> int:
        """Remove matching rows: files with a match are rewritten without them. ValidationError if nothing matches."""
        validate_filter(spec)
        base = self._base()
        snap = self.snapshot(base)
        files, df = self._touched(snap, spec)
        if not files:
            raise ValidationError("no rows match", "filter", spec)
        return self.overwrite_files(snap, files, df.where(~compile_filter(df, spec, total=True)).drop(FILE, ROW), "DELETE")

    def update(self, spec: Mapping, values: Mapping[str, object]) -> int:
        """Set columns of matching rows to constants or Column expressions. ValidationError if nothing matches."""
        validate_filter(spec)
        if not isinstance(values, Mapping) or not values:
            raise ValidationError("an update needs columns and values", "values", values)
        base = self._base()
        snap = self.snapshot(base)
        files, df = self._touched(snap, spec)
        if not files:
            raise ValidationError("no rows match", "filter", spec)
        snap, extra = self.with_new_columns(snap, values)
        return self.overwrite_files(snap, files, changed(df, compile_filter(df, spec, total=True), values, snap.schema).drop(FILE, ROW), "UPDATE", extra=extra)

    def with_new_columns(self, snap: Snapshot, values: Mapping[str, object]) -> tuple[Snapshot, list[Action]]:
        """The snapshot with columns that an update brings, and the action that declares them."""
        new = {k: v for k, v in values.items() if k not in snap.schema.names}
        if not new:
            return snap, []
        kinds = infer_schema([{k: v for k, v in new.items() if not isinstance(v, Column)}])
        if any(isinstance(v, Column) for v in new.values()):
            raise ValidationError("a new column needs a constant", "values", list(new))
        metadata = {**snap.metadata, "schemaString": merge_schemas(snap.schema, kinds).json()}
        return dataclasses.replace(snap, metadata=metadata), [{"metaData": metadata}]

    def merge(self, rows: Rows, keys: Sequence[str], when_matched: Mapping[str, Column | object] | str | None = "update", when_not_matched: Mapping[str, Column | object] | str | None = "insert", delete_when: Column | None = None, condition: Column | None = None, insert_when: Column | None = None) -> int | None:
        """Upsert by key. Columns of the incoming rows are ``src.<name>`` and of the table ``dst.<name>`` in expressions.
        ``when_matched``: 'update' (take the incoming values), 'delete', None (keep), or expressions by column;
        ``delete_when``: matched rows for which it holds go; ``when_not_matched``: 'insert', None (skip), or expressions by
        column over the incoming row, which else keeps its values; ``insert_when``: unmatched rows for which it doesn't hold
        are skipped; ``condition``: what else a match needs (or, without keys, all it needs). Each incoming row changes the
        first row of the table that it matches, in the table's own order. Only files with a match are read whole and
        rewritten. ValidationError if several incoming rows match one row. A condition without keys compares every incoming
        row with the whole table: it is for few incoming rows."""
        plan = self._plan_merge(rows, keys, when_matched, when_not_matched, delete_when, condition, insert_when)
        return self._commit_merge(*plan)

    def _plan_merge(self, rows: Rows, keys: Sequence[str], when_matched, when_not_matched, delete_when, condition, insert_when=None) -> tuple[Snapshot, list[Action], list[dict], DataFrame]:
        df = self._as_frame(rows)
        base = self._base()
        snap = self.snapshot(base)
        if not keys and condition is None or any(k not in df.columns or k not in snap.schema.names for k in keys):
            raise ValidationError("merge keys must be columns of both sides", "keys", list(keys))
        schema = merge_schemas(snap.schema, df.schema)
        actions: list[Action] = []
        if schema != snap.schema:
            snap = dataclasses.replace(snap, metadata={**snap.metadata, "schemaString": schema.json()})
            actions.append({"metaData": snap.metadata})
        files = list(snap.files.values())
        table = self._scan(snap, files, hidden=True)
        if condition is not None:
            df = self._first_matches(table, files, df, keys, condition)
            keys = [FILE, ROW]
        if df.where(F.col(quoted(keys[0])).isNotNull()).groupBy(*[quoted(k) for k in keys]).count().where("count > 1").limit(1).count():
            raise ValidationError("several incoming rows have the same key", "keys", list(keys))
        hits = table.join(df.select(*[quoted(k) for k in keys]), list(keys), "left_semi").select(self._relative(F.col(FILE)).alias("p")).distinct()
        touched = {r["p"] for r in hits.collect()}  # a row per file
        files = [f for f in files if f["path"] in touched]
        table = self._scan(snap, files, hidden=True)
        if condition is None:
            df = self._first_by_key(table, files, df, keys)
        return snap, actions, files, merge_changes(table, df, schema, when_matched, when_not_matched, delete_when, insert_when)

    def _ranked(self, table: DataFrame, files: Sequence[Mapping]) -> DataFrame:
        """The scan with the place of each row in the table's own order."""
        ranks = self.spark.createDataFrame([(f["path"], i) for i, f in enumerate(files)], "__name string, __seq long")
        place = F.struct(F.col("__seq").alias("s"), F.col(ROW).alias("r"), F.col(FILE).alias("f")).alias("__place")
        return table.withColumn("__name", self._relative(F.col(FILE))).join(ranks, "__name").select(*[F.col(quoted(c)) for c in table.columns], place)

    def _first_by_key(self, table: DataFrame, files: Sequence[Mapping], df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The incoming rows with file and ordinal of the first table row of their key; null without one."""
        ours = self._ranked(table, files).groupBy(*[F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min("__place").alias("__place"))
        on = [F.col(f"src.{quoted(k)}") == F.col(f"__k{i}") for i, k in enumerate(keys)]
        return df.alias("src").join(ours, on, "left").select(*[F.col(f"src.{quoted(c)}") for c in df.columns], F.col("__place.f").alias(FILE), F.col("__place.r").alias(ROW))

    def _first_matches(self, table: DataFrame, files: Sequence[Mapping], df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
        """The incoming rows with file and ordinal of the first table row that each matches; null without one."""
        ordered = self._ranked(table, files).alias("dst")
        src = df.withColumn("__sid", F.xxhash64(*[F.to_json(F.struct(F.col(quoted(c)))) for c in df.columns])).alias("src")
        on = condition
        for k in keys:
            on = on & (F.col(f"dst.{quoted(k)}") == F.col(f"src.{quoted(k)}"))
        best = src.join(ordered, on).groupBy(F.col("src.__sid").alias("__sid")).agg(F.min("dst.__place").alias("m"))
        found = src.join(best, "__sid", "left")
        return found.select(*[F.col(f"src.{quoted(c)}") for c in df.columns], F.col("m.f").alias(FILE), F.col("m.r").alias(ROW))

    def _commit_merge(self, snap: Snapshot, actions: list[Action], files: list[dict], changes: DataFrame) -> int | None:
        after = changes.where(F.col("after").isNotNull()).select("after.*")
        return self.overwrite_files(snap, files, after, "MERGE", extra=actions)

    def update_metadata(self, **changes: object) -> int:
        """Merge into the table's metadata (name, description, configuration, ...)."""
        base = self._base()
        snap = self.snapshot(base)
        if snap.metadata is None:
            raise ValidationError("the table doesn't exist", "location", self.root)
        return self._commit([{"metaData": {**snap.metadata, **changes}}], "UPDATE METADATA", base)

    def configuration(self) -> dict[str, str]:
        return self.snapshot().configuration if self.exists() else {}

    def set_configuration(self, **values: str) -> int:
        return self.update_metadata(configuration={**self.configuration(), **values})

    def commit(self, actions: Sequence[Action], operation: str = "COMMIT") -> int:
        """Publish actions as they are."""
        if not actions:
            raise ValidationError("a commit has one action at least", "actions", [])
        base = self._base()
        if any("commitInfo" in a for a in actions):
            version = self.log.commit(base + 1, list(actions))
            self._known = version
            self.log.checkpoint_if_due(version)
            return version
        return self._commit(actions, operation, base)


def _needs_order(pipeline: Sequence[Mapping]) -> bool:
    """Whether a result depends on the order of the rows: limits, ties of a sort, and accumulators that follow it."""
    for stage in pipeline:
        if not isinstance(stage, Mapping) or any(k in stage for k in ("$sort", "$limit", "$skip")):
            return True
        accumulators = stage["$group"].values() if isinstance(stage.get("$group"), Mapping) else ()
        if any(isinstance(a, Mapping) and next(iter(a), None) in ("$first", "$last", "$push", "$addToSet") for a in accumulators):
            return True
    return False


def _leading_matches(pipeline: Sequence[Mapping]) -> list[Mapping]:
    out = []
    for stage in pipeline:
        if not isinstance(stage, Mapping) or "$match" not in stage:
            break
        out.append(stage)
    return out


def _metadata(schema: T.StructType, partitions: Sequence[str], configuration: Mapping[str, str]) -> dict:
    return {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": schema.json(), "partitionColumns": list(partitions), "configuration": dict(configuration), "createdTime": now_ms()}


def _partition_value(path: str, hidden: str) -> str | None:
    found = re.search(rf"/{re.escape(hidden)}=([^/]*)/", path)
    text = unquote(found[1])
    return None if text == "__HIVE_DEFAULT_PARTITION__" else text


def _plain(value: object, kind: T.DataType | None = None) -> object:
    """A bound as the log holds it; an instant in UTC with its offset, so that it means the same in every session."""
    if isinstance(kind, T.TimestampType):
        return value.astimezone(dt.UTC).isoformat()
    return value if isinstance(value, (int, float, str, bool)) else value.isoformat() if isinstance(value, dt.date) else str(value)


def unfolded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, dead row) of compressed deletion vectors."""
    for pdf in batches:
        for path, bitmap, n in zip(pdf["dead"], pdf["bitmap"], pdf["cardinality"], strict=True):
            rows = parse_vector(bytes(bitmap), None if pd.isna(n) else int(n))
            yield pd.DataFrame({"dead": path, f"{ROW}_dead": rows.astype("int64")})


def changed(df: DataFrame, hit: Column, values: Mapping[str, object], schema: T.StructType) -> DataFrame:
    """The frame with columns set where ``hit`` holds. Values see the row as it was."""
    out = []
    for f in schema.fields:
        old = F.col(quoted(f.name)) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in values:
            v = values[f.name]
            if isinstance(v, (dict, list)):
                new = F.from_json(F.lit(json.dumps(v)), f.dataType) if not isinstance(f.dataType, T.VariantType) else F.parse_json(F.lit(json.dumps(v)))
            else:
                new = v if isinstance(v, Column) else F.lit(v)
            old = F.when(hit, new.cast(f.dataType)).otherwise(old)
        out.append(old.alias(f.name))
    return df.select(*out, *[F.col(c) for c in (FILE, ROW) if c in df.columns])


def merge_changes(table: DataFrame, incoming: DataFrame, schema: T.StructType, when_matched, when_not_matched, delete_when, insert_when=None) -> DataFrame:
    """Per row of either side: action (keep, update, delete, insert), before, after, and the table row's file. ``incoming``:
    with file and ordinal of the row that each matches."""
    if isinstance(when_matched, str) and when_matched not in ("update", "delete") or isinstance(when_not_matched, str) and when_not_matched != "insert":
        raise ValidationError("unknown merge action", "when_matched", (when_matched, when_not_matched))
    dst = table.withColumn("__dst", F.lit(True)).alias("dst")
    src = incoming.withColumn("__src", F.lit(True)).alias("src")
    both = dst.join(src, [F.col(f"dst.{k}") == F.col(f"src.{k}") for k in (FILE, ROW)], "full_outer")
    matched, new = F.col("dst.__dst").isNotNull() & F.col("src.__src").isNotNull(), F.col("dst.__dst").isNull()
    names = {"src": [c for c in incoming.columns if c not in (FILE, ROW)], "dst": table.columns}

    def typed(side: str, f: T.StructField) -> Column:
        return (F.col(f"{side}.{quoted(f.name)}") if f.name in names[side] else F.lit(None)).cast(f.dataType)

    def made(given, f: T.StructField, side: str) -> Column:
        """A column of a changed or new row: as ``given``, else as ``side`` has it."""
        if isinstance(given, Mapping) and f.name in given:
            v = given[f.name]
            return (v if isinstance(v, Column) else F.lit(v)).cast(f.dataType)
        return typed(side, f)

    updated = lambda f: made(when_matched, f, "src" if not isinstance(when_matched, Mapping) and f.name in names["src"] else "dst")
    row = lambda one: F.struct(*[one(f).alias(f.name) for f in schema.fields])
    hit = F.lit("keep") if when_matched is None else F.lit("delete" if when_matched == "delete" else "update")
    if delete_when is not None:
        hit = F.when(delete_when, "delete").otherwise(hit)
    miss = F.lit("insert" if when_not_matched is not None else "skip")
    if insert_when is not None:
        miss = F.when(insert_when, miss).otherwise("skip")
    action = F.when(matched, hit).when(new, miss).otherwise("keep")
    before = row(lambda f: typed("dst", f))
    after = F.when(action == "update", row(updated)).when(action == "insert", row(lambda f: made(when_not_matched, f, "src"))).when(action == "keep", before)
    columns = [action.alias("action"), F.when(~new, before).alias("before"), after.alias("after"), F.col(f"dst.{FILE}").alias(FILE), F.col(f"dst.{ROW}").alias(ROW)]
    return both.select(*columns).where("action <> 'skip'")
