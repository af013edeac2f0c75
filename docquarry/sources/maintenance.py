"""Table maintenance: compaction, deduplication, clustering and vacuum. Each job is one commit."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConcurrencyError, StorageError, ValidationError
from ..functions.morton import hilbert, interleave, spread
from ..functions.paths import quoted
from ..log import logger
from ..operators.dedup import deduplicate_by_key, deduplicate_exact, duplicate_histogram
from .log import now_ms, parse_stats, remove_action
from .schema import physical_names
from .table import DATA, FILE, ROW, Table

STRATEGIES = ("greedy", "sort-by-size", "bin-packing")
Progress = Callable[[str, float], None]


def bins(sizes: Sequence[tuple[str, int]], target: int) -> list[list[str]]:
    """First-fit decreasing: files into bins of at most ``target`` bytes."""
    out: list[tuple[int, list[str]]] = []
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        for i, (used, names) in enumerate(out):
            if used + size <= target:
                out[i] = (used + size, [*names, path])
                break
        else:
            out.append((size, [path]))
    return [names for _, names in out]


def plan_bins(files: Sequence[Mapping], target: int, strategy: str = "greedy") -> list[list[Mapping]]:
    """Groups of files to become one file each. Greedy and sort-by-size fill one bin after the other, in log order or by
    ascending size."""
    if strategy not in STRATEGIES:
        raise ValidationError(f"strategy is one of {', '.join(STRATEGIES)}", "strategy", strategy)
    by_path = {f["path"]: f for f in files}
    if strategy == "bin-packing":
        groups = bins([(f["path"], f["size"]) for f in files], target)
    else:
        ordered = sorted(files, key=lambda f: (f["size"], f["path"])) if strategy == "sort-by-size" else list(files)
        groups, used = [], 0
        for f in ordered:
            if not groups or used + f["size"] > target:
                groups.append([])
                used = 0
            groups[-1].append(f["path"])
            used += f["size"]
    return [[by_path[p] for p in g] for g in groups]


@dataclass
class CompactionResult:
    version: int | None = None
    files_before: int = 0
    files_removed: int = 0
    files_added: int = 0
    rows: int = 0
    bytes_before: int = 0
    dry_run: bool = False
    bins: list[list[str]] = field(default_factory=list)
    skipped: str | None = None


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-independent sum of row hashes."""
    columns = [F.to_json(F.col(quoted(f.name))) if isinstance(f.dataType, (T.VariantType, T.MapType)) else F.col(quoted(f.name)) for f in df.schema.fields]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns) % F.lit(1 << 40)).alias("h")).collect()[0]
    return r["n"], r["h"] or 0


def compact(table: Table, target_bytes: int = 128 << 20, min_files: int = 2, strategy: str = "greedy", *, dry_run: bool = False, verify: bool = False, base_version: int | None = None, progress: Progress | None = None) -> CompactionResult:
    """Rewrite small files into larger ones, partition by partition. Rows don't change (``dataChange`` is false)."""
    if target_bytes <= 0 or min_files < 1:
        raise ValidationError("target_bytes and min_files must be positive", "target_bytes", target_bytes)
    if strategy not in STRATEGIES:
        raise ValidationError(f"strategy is one of {', '.join(STRATEGIES)}", "strategy", strategy)
    note = progress or (lambda *_: None)
    snap = table.snapshot()
    if base_version is not None and base_version != snap.version:
        raise ConcurrencyError(f"the table is at version {snap.version}, not {base_version}", base_version, snap.version)
    note("plan", 0.0)
    groups: dict[tuple, list[Mapping]] = defaultdict(list)
    for f in snap.files.values():
        if f["size"] < target_bytes or f.get("deletionVector"):
            groups[tuple(sorted((f.get("partitionValues") or {}).items(), key=str))].append(f)
    planned = [b for files in groups.values() if len(files) >= min_files for b in plan_bins(files, target_bytes, strategy) if len(b) > 1 or b[0].get("deletionVector")]
    result = CompactionResult(files_before=len(snap.files), dry_run=dry_run, bins=[[f["path"] for f in b] for b in planned], files_removed=sum(map(len, planned)), bytes_before=sum(f["size"] for b in planned for f in b))
    if not planned:
        result.skipped = "no partition has enough small files"
        return result
    if dry_run:
        result.files_added = len(planned)
        return result
    note("rewrite", 0.2)
    sources = [f for b in planned for f in b]
    place = {path: i for i, path in enumerate(snap.files)}
    planned.sort(key=lambda b: min(place[f["path"]] for f in b))
    bin_of = table.spark.createDataFrame([(f["path"], i, place[f["path"]]) for i, b in enumerate(planned) for f in b], "__name string, __bin int, __seq long")
    df = table._scan(snap, sources, hidden=True).withColumn("__name", table._relative(F.col(FILE))).join(F.broadcast(bin_of), "__name")  # a row per small file
    before = fingerprint(df.drop("__name", "__bin", "__seq", FILE, ROW)) if verify else None
    # one task, and so one file, per bin; rows keep the table's order in it
    dealt = df.repartitionById(len(planned), F.col("__bin")).sortWithinPartitions("__seq", ROW).drop("__name", "__bin", "__seq", FILE, ROW)
    added = _stage_as_is(table, snap, dealt)
    if verify:
        note("verify", 0.8)
        after = fingerprint(table._scan(snap, [a["add"] for a in added]))
        if after != before:
            raise StorageError(f"compaction would change rows: {before} before, {after} after", table.root, "compact")
    result.version = table._commit([*[remove_action(f["path"], False) for f in sources], *added], "COMPACTION", snap.version)
    result.files_added = len(added)
    result.rows = sum(parse_stats(a["add"]["stats"])["numRecords"] for a in added)
    note("done", 1.0)
    return result


def _stage_as_is(table: Table, snap, df: DataFrame):
    """Stage without moving rows between tasks; rows of a task may only be of one partition."""
    partitions, names = snap.partition_columns, physical_names(snap.schema, snap.configuration)
    if not partitions:
        return table._stage(df, snap.schema, [], names, data_change=False)
    return table._stage(df, snap.schema, partitions, names, data_change=False, keep_layout=True)


@dataclass
class DedupResult:
    version: int | None
    rows_before: int
    rows_after: int
    duplicates: int
    distribution: dict[int, int]
    largest: int

    @property
    def ratio(self) -> float:
        return self.duplicates / self.rows_before if self.rows_before else 0.0


def deduplicate(table: Table, keys: Sequence[str] | None = None, keep: str = "first", order_by: str | None = None) -> DedupResult:
    """Keep one row per key (or of equal rows) of the whole table. Commits only if there are duplicates."""
    snap = table.snapshot()
    df, order = table.ordered(snap)
    plain = df.drop(*order)
    distribution = {r["extra_copies"]: r["n_keys"] for r in duplicate_histogram(plain, list(keys or plain.columns)).collect()}  # a row per count
    before = sum((k + 1) * n for k, n in distribution.items())
    extra = sum(k * n for k, n in distribution.items())
    result = DedupResult(None, before, before - extra, extra, {k: n for k, n in sorted(distribution.items()) if k}, max(distribution, default=0) + 1 if distribution else 0)
    if extra:
        kept = deduplicate_by_key(df, keys, keep, order, order_by).drop(*order) if keys else deduplicate_exact(plain)
        result.version = table.overwrite_files(snap, list(snap.files.values()), kept, "DEDUPLICATE")
    return result


@dataclass
class ClusterResult:
    version: int | None
    files_before: int
    files_after: int
    #: Mean width of the files' value ranges, as a share of the whole range, by column: measured, before and after.
    widths_before: dict[str, float]
    widths_after: dict[str, float]


def zone_widths(files: Sequence[Mapping], columns: Sequence[str]) -> dict[str, float]:
    out = {}
    for c in columns:
        zones = [(s["minValues"][c], s["maxValues"][c]) for f in files if f.get("stats") for s in [parse_stats(f["stats"])] if isinstance(s["minValues"].get(c), (int, float))]
        if zones:
            whole = max(h for _, h in zones) - min(low for low, _ in zones)
            out[c] = sum(h - low for low, h in zones) / len(zones) / whole if whole else 0.0
    return out


def cluster(table: Table, columns: Sequence[str], curve: str = "z-order", files: int | None = None, *, dry_run: bool = False) -> ClusterResult:
    """Rewrite the table along a space-filling curve over ``columns``, so that files cover small ranges of each."""
    if not columns:
        raise ValidationError("clustering needs columns", "columns", list(columns))
    if curve not in ("z-order", "hilbert"):
        raise ValidationError("curve is z-order or hilbert", "curve", curve)
    snap = table.snapshot()
    old = list(snap.files.values())
    df = table._scan(snap, old)
    bits = min(21, 63 // len(columns)) if curve == "z-order" else 16
    cells = spread(df, columns, bits)
    key = interleave(cells, bits) if curve == "z-order" else hilbert(cells, bits)
    result = ClusterResult(None, len(old), len(old), zone_widths(old, columns), {})
    if dry_run or not old:
        return result
    n = files or max(1, len(old))
    sorted_ = df.withColumn("__key", key).repartitionByRange(n, *[quoted(p) for p in snap.partition_columns], "__key").sortWithinPartitions(*[quoted(p) for p in snap.partition_columns], "__key").drop("__key")
    added = _stage_as_is(table, snap, sorted_)
    result.version = table._commit([*[remove_action(f["path"], False) for f in old], *added], "CLUSTER", snap.version)
    result.files_after = len(added)
    result.widths_after = zone_widths([a["add"] for a in added], columns)
    return result


LEAST_RETENTION_HOURS, RETENTION_HOURS = 1, 168


@dataclass
class VacuumResult:
    dry_run: bool
    scanned: int
    deleted: list[str]
    bytes: int
    errors: dict[str, str]


def vacuum(table: Table, retention_hours: float = RETENTION_HOURS, *, dry_run: bool = False, now: int | None = None, check: bool = True) -> VacuumResult:
    """Delete data files that no version within the retention needs: files are kept if they are live, were removed after the
    cutoff, or are younger than it. Change files of the feed and the log itself are never touched."""
    if check and retention_hours < LEAST_RETENTION_HOURS:
        raise ValidationError(f"retention is {LEAST_RETENTION_HOURS} hour at least", "retention_hours", retention_hours)
    cutoff = (now_ms() if now is None else now) - int(retention_hours * 3_600_000)
    snap = table.snapshot()
    protected = set(snap.files)
    for v in table.log.versions():
        for action in table.log.read(v):
            if "remove" in action and action["remove"]["deletionTimestamp"] >= cutoff:
                protected.add(action["remove"]["path"])
    found = [p for p in table.storage.list(DATA) if not p.endswith(".crc")]
    result = VacuumResult(dry_run, len(found), [], 0, {})
    for path in found:
        stat = table.storage.stat(path)
        if path in protected or stat is None or stat.modified_ms >= cutoff:
            continue
        if not dry_run:
            try:
                table.storage.delete(path)
            except Exception as e:  # one file must not stop the others
                logger().warning("%s can't be deleted: %s", path, e)
                result.errors[path] = str(e)
                continue
        result.deleted.append(path)
        result.bytes += stat.size
    return result


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(n) < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def format_duration(ms: float) -> str:
    if ms < 1000:
        return f"{ms:.0f}ms"
    seconds = ms / 1000
    if seconds < 60:
        return f"{seconds:.1f}s"
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes}m {rest}s" if minutes < 60 else f"{minutes // 60}h {minutes % 60}m"
