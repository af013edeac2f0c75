"""Change data feed of a table.

An update, delete or merge writes its change rows before the commit and publishes data and changes together, so the feed can
neither lag behind the table nor run ahead of it. Plain appends write nothing extra: their added files are the changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CDCError, ValidationError
from ..functions.paths import quoted
from ..operators.filters import compile_filter, validate_filter
from ..sources.log import Action, Snapshot, now_ms
from ..sources.table import FILE, ROW, Rows, Table, changed

FOLDER, ENABLED = "_changes", "changeFeed.enabled"
INSERT, PRE, POST, DELETE = "insert", "update_preimage", "update_postimage", "delete"
META = ["_change_type", "_commit_version", "_commit_timestamp"]
_AT = "__at"  # order of changes inside a commit


class ChangeTable(Table):
    """A table with a change feed. ``update``, ``delete`` and ``merge`` change the data and feed in one commit; without a match
    they commit nothing and return None."""

    def enabled(self) -> bool:
        return self.configuration().get(ENABLED, "true") == "true"

    def enable(self) -> int:
        return self.set_configuration(**{ENABLED: "true"})

    def disable(self) -> int:
        return self.set_configuration(**{ENABLED: "false"})

    def append(self, rows: Rows, partition_columns: Sequence[str] | None = None, configuration: Mapping[str, str] | None = None) -> int:
        if not isinstance(rows, DataFrame) and not rows:
            raise CDCError("a write needs one row at least", "EMPTY_WRITE")
        return super().append(rows, partition_columns, {ENABLED: "true", **(configuration or {})})

    def _write_changes(self, snap: Snapshot, changes: DataFrame) -> list[Action]:
        """Stage change rows (``_change_type``, data columns, ``__at``) for the commit after ``snap``."""
        if snap.configuration.get(ENABLED, "true") != "true":
            return []
        folder = f"{FOLDER}/{uuid.uuid4().hex}"
        stamped = changes.withColumn("_commit_version", F.lit(snap.version + 1)).withColumn("_commit_timestamp", F.timestamp_millis(F.lit(now_ms())))
        stamped.write.option("compression", self.compression).parquet(f"{self.root}/{folder}")
        return [{"cdc": {"path": p, "size": self.storage.stat(p).size}} for p in self.storage.list(folder) if p.endswith(".parquet")]

    @staticmethod
    def _images(df: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
        place = F.struct(F.col(FILE).alias("f"), F.col(ROW).alias("r"), F.lit(int(kind == POST)).alias("k"))
        columns = [(F.col(quoted(f.name)) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
        return df.select(F.lit(kind).alias("_change_type"), *columns, place.alias(_AT))

    def update(self, spec: Mapping, values: Mapping[str, object]) -> int | None:
        validate_filter(spec)
        if not isinstance(values, Mapping) or not values:
            raise ValidationError("an update needs columns and values", "values", values)
        snap = self.snapshot(self._base())
        files, df = self._touched(snap, spec)
        if not files:
            return None
        hit = compile_filter(df, spec, total=True)
        wide, extra = self.with_new_columns(snap, values)
        after = changed(df, hit, values, wide.schema)
        before = self._images(df.where(hit), PRE, wide.schema)
        feed = self._write_changes(snap, before.unionByName(self._images(changed(df.where(hit), F.lit(True), values, wide.schema), POST, wide.schema)))
        return self.overwrite_files(wide, files, after.drop(FILE, ROW), "UPDATE", extra=[*extra, *feed])

    def delete(self, spec: Mapping) -> int | None:
        validate_filter(spec)
        snap = self.snapshot(self._base())
        files, df = self._touched(snap, spec)
        if not files:
            return None
        hit = compile_filter(df, spec, total=True)
        feed = self._write_changes(snap, self._images(df.where(hit), DELETE, snap.schema))
        return self.overwrite_files(snap, files, df.where(~hit).drop(FILE, ROW), "DELETE", extra=feed)

    def _commit_merge(self, snap: Snapshot, actions: list[Action], files: list[dict], changes: DataFrame) -> int | None:
        place = F.struct(F.col(FILE).alias("f"), F.col(ROW).alias("r"))
        sides = [("update", "before", PRE, 0), ("update", "after", POST, 1), ("delete", "before", DELETE, 0), ("insert", "after", INSERT, 0)]
        images = [changes.where(F.col("action") == action).select(F.lit(kind).alias("_change_type"), f"{side}.*", F.struct(place["f"].alias("f"), place["r"].alias("r"), F.lit(k).alias("k")).alias(_AT)) for action, side, kind, k in sides]
        feed = reduce(DataFrame.unionByName, images)
        if feed.isEmpty():
            return None
        return super()._commit_merge(snap, [*actions, *self._write_changes(snap, feed)], files, changes)

    # Reading the feed

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Changes of versions ``start`` to ``end``, both included: the three meta columns, then the data columns. Versions that
        don't exist have none."""
        latest = self.log.version()
        if latest < 0:
            raise CDCError("the table doesn't exist", "TABLE_NOT_FOUND")
        end = latest if end is None else end
        if start < 0 or end < start:
            raise CDCError(f"invalid range {start} to {end}", "INVALID_VERSION_RANGE")
        return self._changes_of([v for v in self.log.versions() if start <= v <= end])

    def changes_between(self, start_ms: int, end_ms: int) -> DataFrame:
        """Changes committed in a time range, both ends included."""
        if end_ms < start_ms:
            raise CDCError(f"invalid range {start_ms} to {end_ms}", "INVALID_TIME_RANGE")
        stamp = lambda v: next((a["commitInfo"]["timestamp"] for a in self.log.read(v) if "commitInfo" in a), -1)
        return self._changes_of([v for v in self.log.versions() if start_ms <= stamp(v) <= end_ms])

    def _changes_of(self, versions: Sequence[int]) -> DataFrame:
        snap = self.snapshot()
        schema = snap.schema
        written: list[str] = []
        parts: list[DataFrame] = []
        for v in versions:
            actions = self.log.read(v)
            feed = [a["cdc"]["path"] for a in actions if "cdc" in a]
            if feed:
                written += feed
                continue
            info = next((a["commitInfo"] for a in actions if "commitInfo" in a), {})
            if info.get("operation") in ("UPDATE", "DELETE", "MERGE"):
                continue  # made while the feed was off
            added = [a["add"] for a in actions if "add" in a and a["add"]["dataChange"]]
            gone = {a["remove"]["path"] for a in actions if "remove" in a and a["remove"]["dataChange"]}
            if gone:  # such as a plain deduplication: whole files came and went
                before = self.snapshot(v - 1)
                parts.append(self._file_changes(snap, [before.files[p] for p in gone if p in before.files], DELETE, v, info))
            if added:
                parts.append(self._file_changes(snap, added, INSERT, v, info))
        if written:
            full = T.StructType([T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType()), T.StructField("_commit_timestamp", T.TimestampType()), *schema.fields])
            parts.append(self.spark.read.schema(full).parquet(*[f"{self.root}/{p}" for p in written]))
        if not parts:
            empty = T.StructType([T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType()), T.StructField("_commit_timestamp", T.TimestampType()), *schema.fields])
            return self.spark.createDataFrame([], empty)
        columns = [*META, *[quoted(f.name) for f in schema.fields]]
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])

    def _file_changes(self, snap: Snapshot, files: Sequence[Mapping], kind: str, version: int, info: Mapping) -> DataFrame:
        meta = [F.lit(kind).alias("_change_type"), F.lit(version).cast("long").alias("_commit_version"), F.timestamp_millis(F.lit(info.get("timestamp", 0))).alias("_commit_timestamp")]
        return self._scan(snap, files).select(*meta, "*")

    def tail(self, checkpoint: str, handler: Callable[[DataFrame, int], None], *, starting_version: int = 0, versions_per_batch: int = 10, on_error: Callable[[Exception], None] | None = None, once: bool = False):
        """A streaming query that hands the changes of new commits to ``handler(changes, batch_id)``. It watches the log with
        Structured Streaming, whose checkpoint holds the position: after a crash the last batch comes again (at least once).
        ``on_error`` keeps the query alive when the handler fails; else it stops with the error."""
        log = self.spark.readStream.schema("value string").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", versions_per_batch).text(f"{self.root}/_log")
        found = log.select(F.regexp_extract(F.input_file_name(), r"(\d{20})\.json", 1).cast("long").alias("v")).where(F.col("v") >= starting_version)

        def hand(batch: DataFrame, batch_id: int) -> None:
            versions = sorted(r["v"] for r in batch.distinct().collect())  # a row per commit
            if not versions:
                return
            try:
                handler(self._changes_of(versions), batch_id)
            except Exception as e:
                if on_error is None:
                    raise
                on_error(e)

        writer = found.writeStream.foreachBatch(hand).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
