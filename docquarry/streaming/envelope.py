"""Change envelopes: producers that wrap rows, and consumers that track their position.

An envelope row is ``_id, _seq, _op, _before, _after, _ts`` (nanoseconds), ``_source, _txn``; ``_op`` is c, u, d or r
(create, update, delete, read of a snapshot).
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CDCError, FileNotFoundInStorage, ValidationError
from ..functions.paths import quoted
from ..sources.storage import Storage

OPS = {"c": "create", "u": "update", "d": "delete", "r": "snapshot"}
SYSTEMS = ("docquarry", "mongodb", "postgres", "mysql", "kafka", "custom")


@dataclass(frozen=True)
class Source:
    system: str
    database: str | None = None
    collection: str | None = None
    partition: int | None = None
    server_id: str | None = None

    def __post_init__(self):
        if self.system not in SYSTEMS:
            raise ValidationError(f"system is one of {', '.join(SYSTEMS)}", "system", self.system)

    def column(self) -> Column:
        types = {"system": "string", "database": "string", "collection": "string", "partition": "int", "server_id": "string"}
        return F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in asdict(self).items()])


def dense_numbers(df: DataFrame, order: Sequence[str], start: int, name: str) -> tuple[DataFrame, int]:
    """The frame with gapless numbers in the given order, and the next free number. Counts per partition (one small job)
    turn each row's place in its partition into its global place; no task sees all rows."""
    ranged = df.orderBy(*[quoted(c) for c in order]) if order else df
    kept = ranged.withColumn(name, F.monotonically_increasing_id()).persist()
    part = F.shiftright(name, 33)
    counts = {r["p"]: r["n"] for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    first, bounds = start, []
    for p in sorted(counts):
        bounds += [F.lit(p), F.lit(first)]
        first += counts[p]
    if not counts:
        return kept.withColumn(name, F.lit(start)), start
    offsets = F.create_map(*bounds)
    return kept.withColumn(name, offsets[part] + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))), first


class Producer:
    """Wraps rows into envelopes with growing sequence numbers."""

    def __init__(self, source: Source, sequence: int = 0, clock: Callable[[], int] = time.time_ns):
        self.source, self._sequence, self.clock = source, sequence, clock

    @property
    def sequence(self) -> int:
        return self._sequence

    def reset(self, sequence: int = 0) -> None:
        if sequence < 0:
            raise ValidationError("a sequence number is non-negative", "sequence", sequence)
        self._sequence = sequence

    def _wrap(self, df: DataFrame, op: str, ids: Column, before: Column | None, after: Column | None, order: Sequence[str], txn: str | None) -> DataFrame:
        image = next(c for c in (before, after) if c is not None)
        numbered, self._sequence = dense_numbers(df, order, self._sequence, "__seq")
        return numbered.select(
            ids.cast("string").alias("_id"),
            F.col("__seq").cast("long").alias("_seq"),
            F.lit(op).alias("_op"),
            (F.when(F.lit(before is not None), before if before is not None else image)).alias("_before"),
            (F.when(F.lit(after is not None), after if after is not None else image)).alias("_after"),
            F.lit(self.clock()).alias("_ts"),
            self.source.column().alias("_source"),
            F.lit(txn).cast("string").alias("_txn"),
        )

    @staticmethod
    def _row(df: DataFrame) -> Column:
        return F.struct(*[F.col(quoted(c)) for c in df.columns])

    def create(self, df: DataFrame, id_column: str, txn: str | None = None) -> DataFrame:
        return self._wrap(df, "c", F.col(quoted(id_column)), None, self._row(df), [id_column], txn)

    def snapshot(self, df: DataFrame, id_column: str, txn: str | None = None) -> DataFrame:
        return self._wrap(df, "r", F.col(quoted(id_column)), None, self._row(df), [id_column], txn)

    def delete(self, df: DataFrame, id_column: str, txn: str | None = None) -> DataFrame:
        return self._wrap(df, "d", F.col(quoted(id_column)), self._row(df), None, [id_column], txn)

    def update(self, before: DataFrame, after: DataFrame, id_column: str, txn: str | None = None) -> DataFrame:
        """Rows of both sides meet by id; ids on one side only are left out."""
        b = before.select(F.col(quoted(id_column)).alias("__id"), self._row(before).alias("__b"))
        a = after.select(F.col(quoted(id_column)).alias("__id"), self._row(after).alias("__a"))
        return self._wrap(b.join(a, "__id"), "u", F.col("__id"), F.col("__b"), F.col("__a"), ["__id"], txn)

    def changes(self, feed: DataFrame, id_column: str, txn: str | None = None) -> DataFrame:
        """Envelopes of a table's change feed (see ``changes.ChangeTable``)."""
        data = [c for c in feed.columns if c not in ("_change_type", "_commit_version", "_commit_timestamp")]
        row = F.struct(*[F.col(quoted(c)) for c in data])
        plain = feed.select("*", row.alias("__row"), F.col(quoted(id_column)).alias("__id"))
        group = plain.where("_change_type <> 'update_preimage'").select("_commit_version", "_change_type", "__id", F.col("__row").alias("__after"))
        pre = plain.where("_change_type = 'update_preimage'").select("_commit_version", "__id", F.col("__row").alias("__before"))
        both = group.join(pre, ["_commit_version", "__id"], "left")
        op = F.when(F.col("_change_type") == "insert", "c").when(F.col("_change_type") == "delete", "d").otherwise("u")
        numbered, self._sequence = dense_numbers(both, ["_commit_version", "__id", "_change_type"], self._sequence, "__seq")
        gone = F.col("_change_type") == "delete"
        return numbered.select(
            F.col("__id").cast("string").alias("_id"),
            F.col("__seq").cast("long").alias("_seq"),
            op.alias("_op"),
            F.when(gone, F.col("__after")).otherwise(F.col("__before")).alias("_before"),
            F.when(~gone, F.col("__after")).alias("_after"),
            F.lit(self.clock()).alias("_ts"),
            self.source.column().alias("_source"),
            F.lit(txn).cast("string").alias("_txn"),
        )


def select_changes(df: DataFrame, operations: Iterable[str] = (), from_sequence: int | None = None, from_ms: int | None = None) -> DataFrame:
    """Envelopes of some operations (codes or names), from a sequence number or a time on."""
    codes = [k for k, v in OPS.items() if k in set(operations) or v in set(operations)]
    out = df.where(F.col("_op").isin(codes)) if codes else df
    if from_sequence is not None:
        out = out.where(F.col("_seq") >= from_sequence)
    return out if from_ms is None else out.where(F.col("_ts") >= F.lit(from_ms * 1_000_000))


# Offsets


@dataclass(frozen=True)
class Offset:
    offset: int
    committed_at: int
    partition: int | None = None
    metadata: dict = field(default_factory=dict)


class Offsets:
    """Committed positions by group, topic and partition; in memory, or as one JSON file each in a storage."""

    def __init__(self, storage: Storage | None = None):
        self.storage, self._held = storage, {}

    @staticmethod
    def _key(group: str, topic: str, partition: int | None) -> str:
        for part in (group, topic):
            if not part or "/" in part or part.startswith("."):
                raise ValidationError("group and topic are names without '/'", "group", part)
        return f"{group}/{topic}/{'all' if partition is None else partition}.json"

    def get(self, group: str, topic: str, partition: int | None = None) -> Offset | None:
        key = self._key(group, topic, partition)
        if self.storage is None:
            return self._held.get(key)
        try:
            return Offset(**json.loads(self.storage.read(f"_offsets/{key}")))
        except FileNotFoundInStorage:
            return None

    def commit(self, group: str, topic: str, offset: Offset) -> None:
        key = self._key(group, topic, offset.partition)
        if self.storage is None:
            self._held[key] = offset
        else:
            self.storage.write(f"_offsets/{key}", json.dumps(asdict(offset)).encode())

    def delete(self, group: str, topic: str, partition: int | None = None) -> None:
        key = self._key(group, topic, partition)
        if self.storage is None:
            self._held.pop(key, None)
        else:
            self.storage.delete(f"_offsets/{key}")

    def list(self, group: str) -> dict[str, Offset]:
        if self.storage is None:
            found = {k: v for k, v in self._held.items() if k.startswith(f"{group}/")}
        else:
            found = {p.removeprefix("_offsets/"): Offset(**json.loads(self.storage.read(p))) for p in self.storage.list(f"_offsets/{group}")}
        return {k.split("/", 1)[1].removesuffix(".json"): v for k, v in found.items()}

    def clear(self) -> None:
        self._held.clear()
        if self.storage is not None:
            self.storage.delete("_offsets")


@dataclass(frozen=True)
class ConsumerConfig:
    group: str | None = None
    topic: str | None = None
    operations: tuple[str, ...] = ()
    from_sequence: int = 0
    from_ms: int | None = None
    auto_commit: bool = False
    auto_commit_every: float = 0.0
    partition: int | None = None


def is_valid_config(config: object) -> bool:
    return isinstance(config, ConsumerConfig) and all(o in OPS or o in OPS.values() for o in config.operations) and config.from_sequence >= 0 and config.auto_commit_every >= 0


class Consumer:
    """Hands envelope frames to its subscribers. The position moves on when all of them have succeeded, so a failure makes the
    same changes come again."""

    def __init__(self, config: ConsumerConfig = ConsumerConfig(), offsets: Offsets | None = None):
        if not is_valid_config(config):
            raise CDCError("invalid consumer configuration", "INVALID_CONSUMER_CONFIG")
        self.config, self.offsets = config, offsets
        self._position, self._from_ms = config.from_sequence, config.from_ms
        self._handlers: dict[int, Callable[[DataFrame], None]] = {}
        self._next, self._last_commit = 0, 0.0

    @property
    def position(self) -> int:
        return self._position

    def subscribe(self, handler: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Returns the function that ends the subscription."""
        number, self._next = self._next, self._next + 1
        self._handlers[number] = handler
        return lambda: self._handlers.pop(number, None) and None

    def select(self, df: DataFrame) -> DataFrame:
        return select_changes(df, self.config.operations, self._position, self._from_ms)

    def process(self, df: DataFrame) -> int:
        """Hand on what is new; the new position."""
        last = df.where(F.col("_seq") >= self._position).agg(F.max("_seq")).collect()[0][0]  # one row
        if last is None:
            return self._position
        part = self.select(df)
        for handler in list(self._handlers.values()):
            handler(part)
        self._position = last + 1
        if self.config.auto_commit and time.monotonic() - self._last_commit >= self.config.auto_commit_every:
            self.commit()
        return self._position

    def seek(self, sequence: int) -> None:
        if isinstance(sequence, bool) or not isinstance(sequence, int) or sequence < 0:
            raise ValidationError("a position is a non-negative integer", "sequence", sequence)
        self._position = sequence

    def seek_to_timestamp(self, ms: int) -> None:
        self._position, self._from_ms = 0, ms

    def _group(self) -> tuple[str, str, Offsets]:
        if not self.config.group or not self.config.topic or self.offsets is None:
            raise CDCError("offsets need a group, a topic and a storage", "INVALID_CONSUMER_CONFIG")
        return self.config.group, self.config.topic, self.offsets

    def commit(self, metadata: Mapping | None = None) -> Offset:
        group, topic, offsets = self._group()
        offset = Offset(self._position, time.time_ns() // 1_000_000, self.config.partition, dict(metadata or {}))
        try:
            offsets.commit(group, topic, offset)
        except Exception as e:
            raise CDCError(f"the offset could not be committed: {e}", "OFFSET_COMMIT_FAILED") from e
        self._last_commit = time.monotonic()
        return offset

    def commit_async(self, done: Callable[[Offset | None, Exception | None], None] = lambda *_: None) -> threading.Thread:
        def work() -> None:
            try:
                done(self.commit(), None)
            except Exception as e:
                done(None, e)

        thread = threading.Thread(target=work)
        thread.start()
        return thread

    def committed(self) -> Offset | None:
        group, topic, offsets = self._group()
        return offsets.get(group, topic, self.config.partition)

    def resume(self) -> int:
        """Go on at the committed position, if there is one."""
        found = self.committed()
        self._position = found.offset if found else self.config.from_sequence
        return self._position

    def reset(self) -> None:
        group, topic, offsets = self._group()
        offsets.delete(group, topic, self.config.partition)
        self._position = self.config.from_sequence


def union_envelopes(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


ENVELOPE_META = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_ts", T.LongType()), T.StructField("_txn", T.StringType())])
