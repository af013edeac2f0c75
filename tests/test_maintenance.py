"""Compaction, deduplication, clustering, vacuum, zone maps, storage, retry, writers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from docquarry.errors import AbortError, ConcurrencyError, FileNotFoundInStorage, StorageError, ValidationError, VersionMismatchError
from docquarry.functions.morton import hilbert, interleave
from docquarry.functions.variant import decode, decode_json, encode, encode_json, shred
from docquarry.operators.dedup import deduplicate_by_key, deduplicate_exact
from docquarry.plans.pushdown import ColumnPredicate, ZoneMap, can_skip, column_predicates, partition_predicates, shredded_statistics_paths, statistics_path
from docquarry.retry import RetryMetrics, RetryPolicy, with_retry
from docquarry.sources.log import add_action, parse, parse_stats, remove_action, serialize, validate_action
from docquarry.sources.maintenance import bins, cluster, compact, deduplicate, format_bytes, format_duration, plan_bins, vacuum
from docquarry.sources.storage import HadoopStorage, LocalStorage, MemoryStorage, parse_location
from docquarry.sources.table import Table
from docquarry.sources.writer import PartsWriter, WriterOptions


@pytest.fixture
def small(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    for i in range(4):
        t.append(spark.range(i * 10, i * 10 + 10).select("id", (F.col("id") % 3).cast("int").alias("k")).coalesce(1))
    return t


@pytest.mark.parametrize("strategy", ["greedy", "sort-by-size", "bin-packing"])
def test_compact(small, strategy):
    before = small.snapshot()
    plan = compact(small, strategy=strategy, dry_run=True)
    assert plan.files_removed == len(before.files) and plan.version is None and small.log.version() == before.version
    result = compact(small, strategy=strategy, verify=True)
    assert len(small.snapshot().files) == result.files_added == 1 and result.rows == 40
    assert sorted(r["id"] for r in small.find().collect()) == list(range(40))
    assert small.find(version=before.version).count() == 40
    assert compact(small).skipped


def test_compact_keeps_partitions_and_checks_its_base(spark, tmp_path):
    t = Table(spark, str(tmp_path / "p"))
    for i in range(3):
        t.append([{"i": i, "p": "a"}, {"i": i + 10, "p": "b"}, {"i": i + 20, "p": None}], ["p"])
    compact(t)
    assert len(t.snapshot().files) == 3 and t.count() == 9
    assert sorted(r["i"] for r in t.find({"p": "b"}).collect()) == [10, 11, 12]
    with pytest.raises(ConcurrencyError):
        compact(t, base_version=0)
    with pytest.raises(ValidationError):
        compact(t, strategy="magic")
    with pytest.raises(ValidationError):
        compact(t, 0)


def test_bins():
    assert bins([("a", 6), ("b", 5), ("c", 4), ("d", 4), ("e", 1)], 10) == [["a", "c"], ["b", "d", "e"]]
    files = [{"path": p, "size": s} for p, s in [("a", 6), ("b", 5), ("c", 4)]]
    assert [[f["path"] for f in b] for b in plan_bins(files, 10)] == [["a"], ["b", "c"]]


def test_deduplicate(spark, tmp_path):
    t = Table(spark, str(tmp_path / "d"))
    t.append([{"k": "a", "v": 1}, {"k": "b", "v": 2}])
    t.append([{"k": "a", "v": 3}, {"k": None, "v": 4}, {"k": "a", "v": 0}, {"k": None, "v": 5}])
    for keep, expected in (("first", {"a": 1, "b": 2, None: 4}), ("last", {"a": 0, "b": 2, None: 5}), ("latest", {"a": 3, "b": 2, None: 5})):
        df, order = t.ordered()
        got = {r["k"]: r["v"] for r in deduplicate_by_key(df, ["k"], keep, order, "v").collect()}
        assert got == expected, keep
    r = deduplicate(t, ["k"], "latest", "v")
    assert (r.rows_before, r.rows_after, r.duplicates, r.distribution, r.largest, r.ratio) == (6, 3, 3, {1: 1, 2: 1}, 3, 0.5)
    assert deduplicate(t, ["k"]).version is None
    same = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None)], "a int, b string")
    assert deduplicate_exact(same).count() == 2
    for bad in ({"keep": "best"}, {"keep": "latest"}):
        with pytest.raises(ValidationError):
            deduplicate_by_key(same, ["a"], **bad)


def test_curves(spark):
    df = spark.createDataFrame([(x, y) for x in range(8) for y in range(8)], "x int, y int")
    z = {(r["x"], r["y"]): r["z"] for r in df.select("x", "y", interleave([F.col("x"), F.col("y")]).alias("z")).collect()}
    assert z[(1, 0)] == 1 and z[(0, 1)] == 2 and z[(3, 5)] == 0b100111 and len(set(z.values())) == 64
    path = [(r["x"], r["y"]) for r in df.select("x", "y", hilbert([F.col("x"), F.col("y")], 3).alias("h")).orderBy("h").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))
    with pytest.raises(ValidationError):
        interleave([F.col("x")] * 4)


@pytest.mark.parametrize("curve", ["z-order", "hilbert"])
def test_cluster_narrows_files(spark, tmp_path, curve):
    t = Table(spark, str(tmp_path / curve))
    t.append(spark.range(4000).select((F.col("id") * 7919 % 4001).alias("x"), (F.col("id") * 104729 % 4003).alias("y"), F.col("id").cast("string").alias("s")).repartition(8))
    r = cluster(t, ["x", "y"], curve, files=16)
    assert t.count() == 4000 and all(r.widths_after[c] < 0.6 < r.widths_before[c] for c in "xy")
    t.find({"x": {"$lt": 100}}).count()
    assert t.last_skipped_files > 4
    assert cluster(t, ["x"], dry_run=True).version is None
    with pytest.raises(ValidationError):
        cluster(t, ["nope"])


def test_vacuum(small):
    compact(small)
    later = int(os.path.getmtime(f"{small.root}/{next(iter(small.snapshot().files))}") * 1000) + 1000
    assert vacuum(small).deleted == []
    plan = vacuum(small, 1, dry_run=True, now=later + 2 * 3_600_000)
    assert len(plan.deleted) == 4 and small.find(version=3).count() == 40
    assert len(vacuum(small, 1, now=later + 2 * 3_600_000).deleted) == 4
    assert small.count() == 40
    with pytest.raises(ValidationError):
        vacuum(small, 0.5)


def test_formats():
    assert [format_bytes(n) for n in (5, 2048, 3 << 20)] == ["5 B", "2.00 KB", "3.00 MB"]
    assert [format_duration(n) for n in (5, 1500, 61_000, 3_660_000)] == ["5ms", "1.5s", "1m 1s", "1h 1m"]


def test_zone_maps():
    zone = ZoneMap("a", 10, 20)
    skip = lambda op, v, z=zone: can_skip(z, ColumnPredicate("a", op, v))
    assert [skip("eq", v) for v in (9, 10, 20, 21)] == [True, False, False, True]
    assert [skip("gt", v) for v in (19, 20)] == [False, True] and [skip("gte", v) for v in (20, 21)] == [False, True]
    assert [skip("lt", v) for v in (10, 11)] == [True, False] and [skip("lte", v) for v in (9, 10)] == [True, False]
    assert [skip("in", v) for v in ([1, 30], [1, 15], [])] == [True, False, True]
    assert [skip("between", v) for v in ((21, 30), (1, 9), (5, 15))] == [True, True, False]
    assert skip("ne", 5, ZoneMap("a", 5, 5)) and not skip("ne", 5, ZoneMap("a", 5, 5, 1)) and not skip("ne", 5)
    assert not skip("eq", "x") and not skip("eq", 1, ZoneMap("a", None, None)) and not skip("gt", float("nan"))
    assert skip("lt", dt.date(2020, 1, 1), ZoneMap("a", dt.datetime(2021, 1, 1), dt.datetime(2022, 1, 1)))


def test_predicate_lists():
    assert column_predicates({"a": 1, "b.c": {"$gt": 2}, "$or": [{"x": 1}]}) == [ColumnPredicate("a", "eq", 1), ColumnPredicate("b.c", "gt", 2)]
    assert partition_predicates({"p": {"$in": [1, None]}, "q": "x", "$and": [{"p": 1}]}, ["p"]) == {"p": {"1"}}
    assert shredded_statistics_paths("v", ["a", "b.c"]) == ["v.typed_value.a.typed_value", "v.typed_value.b.typed_value.c.typed_value"]
    assert statistics_path("v.a", {"v": ["a"]}) == "v.typed_value.a.typed_value" and statistics_path("v.z", {"v": ["a"]}) is None


def test_actions():
    assert parse(serialize([add_action("data/x", 5, {"p": None}, {"numRecords": 1}), remove_action("data/y")]))[1]["remove"]["path"] == "data/y"
    for bad in ({}, {"add": {}, "remove": {}}, {"quux": {}}, {"add": {"path": "/abs"}}, 5):
        with pytest.raises(ValidationError):
            validate_action(bad)
    for path in ("", "/x", "a/../b", "s3://b/x"):
        with pytest.raises(ValidationError):
            add_action(path, 1)
    for data in (b"", b"\n", b"{x}", b'{"add": 5}'):
        with pytest.raises(ValidationError):
            parse(data)
    for text in ("[]", "{}", "x", '{"numRecords": -1}'):
        with pytest.raises(ValidationError):
            parse_stats(text)


@pytest.mark.parametrize("kind", ["local", "memory", "hadoop"])
def test_storage_contract(spark, tmp_path, kind):
    s = {"local": lambda: LocalStorage(str(tmp_path)), "memory": MemoryStorage, "hadoop": lambda: HadoopStorage(spark, f"file://{tmp_path}")}[kind]()
    s.write("a/b.txt", b"hello")
    assert s.read("a/b.txt") == b"hello" and s.exists("a/b.txt") and s.stat("a/b.txt").size == 5
    assert s.read_range("a/b.txt", 1, 3) == b"el" and s.open_range("a/b.txt").slice(3) == b"lo"
    with pytest.raises(VersionMismatchError):
        s.create("a/b.txt", b"x")
    s.create("a/c.txt", b"x")
    assert s.list("a") == ["a/b.txt", "a/c.txt"] and s.list("nope") == []
    version = s.version("a/c.txt")
    s.write_conditional("a/c.txt", b"yy", version)
    with pytest.raises(VersionMismatchError):
        s.write_conditional("a/c.txt", b"z", "other")
    s.delete("a/c.txt")
    s.delete("a/c.txt")
    assert s.version("a/c.txt") is None and s.stat("a/c.txt") is None
    with pytest.raises(FileNotFoundInStorage):
        s.read("a/c.txt")
    for bad in ("../x", "a/../../x", "a\0"):
        with pytest.raises(ValidationError):
            s.read(bad)


def test_memory_storage_extras():
    s = MemoryStorage(capacity=4)
    s.write("a", b"1234")
    with pytest.raises(StorageError):
        s.write("b", b"5")
    state = s.snapshot()
    s.delete("a")
    s.restore(state)
    assert s.read("a") == b"1234" and ("delete", "a") in s.history


@pytest.mark.parametrize(
    "url, scheme, uri, bucket, key",
    [
        ("/x/y", "file", "/x/y", None, ""),
        ("file:///x%20y", "file", "/x y", None, ""),
        ("s3://b/k/l", "s3", "s3a://b/k/l", "b", "k/l"),
        ("https://b.s3.eu-west-1.amazonaws.com/k", "s3", "s3a://b/k", "b", "k"),
        ("https://s3.eu-west-1.amazonaws.com/b/k", "s3", "s3a://b/k", "b", "k"),
        ("r2://b/k", "r2", "s3a://b/k", "b", "k"),
        ("memory://n/t", "memory", "memory://n/t", None, "n/t"),
        ("hdfs://h/p", "hdfs", "hdfs://h/p", None, ""),
    ],
)
def test_locations(url, scheme, uri, bucket, key):
    at = parse_location(url)
    assert (at.scheme, at.uri, at.bucket, at.key) == (scheme, uri, bucket, key)


def test_bad_locations():
    for bad in ("", None, "s3:///k", "https://example.com/x", "/a\0b"):
        with pytest.raises(ValidationError):
            parse_location(bad)


def test_retry():
    tries, slept, m = [], [], RetryMetrics()

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise ConcurrencyError("busy")
        return "ok"

    assert with_retry(work, RetryPolicy(jitter=0), sleep=slept.append, metrics=m) == "ok"
    assert slept == [0.1, 0.2] and m.retries == 2 and m.succeeded
    with pytest.raises(ValidationError):
        with_retry(lambda: (_ for _ in ()).throw(ValidationError("no")), sleep=slept.append)
    with pytest.raises(ConcurrencyError):
        with_retry(lambda: (_ for _ in ()).throw(ConcurrencyError("x")), on_retry=lambda *_: False, sleep=slept.append)
    with pytest.raises(AbortError):
        with_retry(work, aborted=lambda: True)
    assert RetryPolicy(cap=1).delay(10) <= 1
    with pytest.raises(ValidationError):
        RetryPolicy(factor=0)


def test_variants(spark):
    doc = {"a": [1, None, "x"], "b": {"c": 2.5}}
    assert decode(encode(doc)) == doc
    df = spark.createDataFrame([('{"a": {"b": 5}, "s": "t"}',), ("nope",), ('{"a": {"b": "x"}}',)], "j string").select(encode_json(F.col("j")).alias("v"))
    assert [r[0] for r in df.select(decode_json(F.col("v"))).collect()] == ['{"a":{"b":5},"s":"t"}', None, '{"a":{"b":"x"}}']
    assert [(r["a_b"], r["s"]) for r in df.select(*shred(F.col("v"), {"a.b": "int", "s": "string"})).collect()] == [(5, "t"), (None, None), (None, None)]


def test_parts_writer(spark, tmp_path):
    w = PartsWriter(spark, str(tmp_path / "w"), WriterOptions(group_rows=3, codec="ZSTD", distinct=True))
    w.write([{"i": i, "s": "x" if i % 2 else None} for i in range(4)])
    assert not (tmp_path / "w" / "parts").exists()
    w.write([{"i": 9}])
    done = w.finish()
    assert done["rows"] == 5 and done["files"] == 2
    assert done["statistics"]["i"] == {"min": 0, "max": 9, "null_count": 0, "distinct_count": 5} and done["statistics"]["s"]["null_count"] == 3
    with pytest.raises(StorageError):
        w.write([{"i": 1}])
    other = PartsWriter(spark, str(tmp_path / "x"), WriterOptions(group_rows=1))
    other.write([{"i": 1}])
    other.abort()
    assert not list((tmp_path / "x").rglob("*.parquet"))
    with pytest.raises(ValidationError):
        WriterOptions(codec="rar")


def test_files_in_memory(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from docquarry.errors import CDCError
    from docquarry.sources.files import read_change_file, read_parquet_bytes

    pq.write_table(pa.table({"a": [1, 2], "b": ["x", None]}), tmp_path / "f")
    data = (tmp_path / "f").read_bytes()
    assert read_parquet_bytes(data, ["a"]) == [{"a": 1}, {"a": 2}] and read_change_file(data)[1] == {"a": 2, "b": None}
    assert read_change_file(b'[{"t": {"$date": 0}, "n": {"$bigint": "5"}}]') == [{"t": dt.datetime(1970, 1, 1), "n": 5}]
    assert read_change_file(b'{"a": [1]}\n{"a": {}}\n') == [{"a": [1]}, {"a": {}}]
    with pytest.raises(ValidationError):
        read_parquet_bytes(b"nope")
    with pytest.raises(CDCError):
        read_change_file(b"{")


def test_logger_can_be_replaced():
    from docquarry.log import logger, set_logger

    seen = []

    class Mine:
        def warning(self, msg, *args):
            seen.append(msg % args)

    set_logger(Mine())
    logger().warning("x %s", 1)
    set_logger(None)
    assert seen == ["x 1"]
