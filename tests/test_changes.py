"""Change feed, envelopes, consumers, and the streaming tail."""

import pytest
from pyspark.sql import functions as F

from docquarry.errors import CDCError, ValidationError
from docquarry.sources.storage import LocalStorage
from docquarry.streaming.changes import ChangeTable
from docquarry.streaming.envelope import Consumer, ConsumerConfig, Offset, Offsets, Producer, Source, select_changes


@pytest.fixture
def table(spark, tmp_path):
    t = ChangeTable(spark, str(tmp_path / "t"))
    t.append([{"id": "a", "v": 1}, {"id": "b", "v": 2}])
    return t


def flat(df):
    return sorted((r["_commit_version"], r["_change_type"], r["id"], r["v"]) for r in df.collect())


def test_feed_follows_the_table(table):
    assert table.update({"id": "a"}, {"v": 10}) == 1
    assert table.merge([{"id": "b", "v": 20}, {"id": "c", "v": 3}], ["id"]) == 2
    assert table.delete({"v": {"$gte": 20}}) == 3
    assert sorted((r["id"], r["v"]) for r in table.find().collect()) == [("a", 10), ("c", 3)]
    assert flat(table.changes(0)) == [
        (0, "insert", "a", 1),
        (0, "insert", "b", 2),
        (1, "update_postimage", "a", 10),
        (1, "update_preimage", "a", 1),
        (2, "insert", "c", 3),
        (2, "update_postimage", "b", 20),
        (2, "update_preimage", "b", 2),
        (3, "delete", "b", 20),
    ]
    assert flat(table.changes(3, 9)) == [(3, "delete", "b", 20)] and flat(table.changes(7, 9)) == []
    stamp = table.log.read(1)[0]["commitInfo"]["timestamp"]
    assert (1, "update_postimage", "a", 10) in flat(table.changes_between(stamp, stamp))


def test_no_match_commits_nothing(table):
    assert table.update({"id": "z"}, {"v": 0}) is None and table.delete({"id": "z"}) is None
    assert table.merge([{"id": "zz", "v": 1}], ["id"], when_not_matched=None) is None
    assert table.log.version() == 0


def test_errors(table, spark, tmp_path):
    for start, end in ((-1, 2), (3, 1)):
        with pytest.raises(CDCError) as e:
            table.changes(start, end)
        assert e.value.code == "INVALID_VERSION_RANGE"
    with pytest.raises(CDCError):
        table.changes_between(5, 4)
    with pytest.raises(CDCError):
        ChangeTable(spark, str(tmp_path / "none")).changes(0)
    with pytest.raises(CDCError):
        table.append([])


def test_feed_survives_new_columns_and_can_be_off(table):
    table.update({"id": "a"}, {"note": "n"})
    got = {(r["_change_type"], r["id"]): r["note"] for r in table.changes(0).collect()}
    assert got[("update_postimage", "a")] == "n" and got[("update_preimage", "a")] is None and got[("insert", "b")] is None
    table.disable()
    assert not table.enabled()
    table.update({"id": "a"}, {"v": 5})
    assert table.changes(3, 3).count() == 0
    table.enable()
    table.update({"id": "a"}, {"v": 6})
    assert table.changes(5, 5).count() == 2


def test_tail_streams_new_commits(table, tmp_path):
    seen = []
    hand = lambda df, _: seen.extend(flat(df))
    q = table.tail(str(tmp_path / "cp"), hand, once=True)
    q.awaitTermination()
    table.update({"id": "b"}, {"v": 7})
    q = table.tail(str(tmp_path / "cp"), hand, once=True)
    q.awaitTermination()
    assert seen == [(0, "insert", "a", 1), (0, "insert", "b", 2), (1, "update_postimage", "b", 7), (1, "update_preimage", "b", 2)]
    errors = []
    q = table.tail(str(tmp_path / "cp2"), lambda *_: 1 / 0, once=True, on_error=errors.append)
    q.awaitTermination()
    assert errors


def test_envelopes(spark):
    p = Producer(Source("docquarry", "db", "c"), sequence=5, clock=lambda: 7_000_000_000)
    before = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    after = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    made = p.create(before, "id", txn="t1").orderBy("_seq").collect()
    assert [(r["_id"], r["_seq"], r["_op"], r["_before"], r["_after"]["v"], r["_txn"]) for r in made] == [("a", 5, "c", None, 1, "t1"), ("b", 6, "c", None, 2, "t1")]
    up = p.update(before, after, "id").collect()
    assert [(r["_id"], r["_seq"], r["_before"]["v"], r["_after"]["v"]) for r in up] == [("b", 7, 2, 3)]
    gone = p.delete(after, "id").collect()
    assert [r["_after"] for r in gone] == [None, None] and p.sequence == 10
    p.reset()
    assert p.snapshot(before, "id").collect()[0]["_op"] == "r" and p.sequence == 2
    assert p.create(before.where("false"), "id").count() == 0 and p.sequence == 2
    with pytest.raises(ValidationError):
        Source("fax")


def test_envelopes_of_a_feed(table):
    table.update({"id": "a"}, {"v": 9})
    table.delete({"id": "b"})
    rows = Producer(Source("docquarry")).changes(table.changes(1), "id").orderBy("_seq").collect()
    assert [(r["_op"], r["_id"], r["_before"] and r["_before"]["v"], r["_after"] and r["_after"]["v"]) for r in rows] == [("u", "a", 1, 9), ("d", "b", 2, None)]


def test_dense_numbers_over_many_partitions(spark):
    df = spark.range(1000).withColumn("id", F.col("id").cast("string")).repartition(7)
    seqs = sorted(r["_seq"] for r in Producer(Source("custom"), 3).create(df, "id").collect())
    assert seqs == list(range(3, 1003))


def test_consumer(spark, tmp_path):
    p = Producer(Source("docquarry"), clock=lambda: 5_000_000)
    df = p.create(spark.createDataFrame([("a",), ("b",)], "id string"), "id").unionByName(p.delete(spark.createDataFrame([("c",)], "id string"), "id"))
    got = []
    offsets = Offsets(LocalStorage(str(tmp_path)))
    c = Consumer(ConsumerConfig("g", "t", operations=("create",), auto_commit=True), offsets)
    stop = c.subscribe(lambda part: got.extend(r["_id"] for r in part.orderBy("_seq").collect()))
    assert c.process(df) == 3 and got == ["a", "b"]
    assert c.process(df) == 3 and got == ["a", "b"]
    assert c.committed().offset == 3 and offsets.list("g")["t/all"].offset == 3
    c.seek(1)
    c.process(df)
    assert got == ["a", "b", "b"]
    stop()
    c.subscribe(lambda part: 1 / 0)
    c.seek(0)
    with pytest.raises(ZeroDivisionError):
        c.process(df)
    assert c.position == 0
    again = Consumer(ConsumerConfig("g", "t"), offsets)
    assert again.resume() == 3
    again.reset()
    assert again.committed() is None and again.position == 0
    done = []
    again.commit_async(lambda o, e: done.append((o, e))).join()
    assert done[0][0].offset == 0
    assert select_changes(df, from_ms=6).count() == 0 and select_changes(df, from_ms=5).count() == 3
    with pytest.raises(CDCError):
        Consumer().commit()
    with pytest.raises(CDCError):
        Consumer(ConsumerConfig(operations=("zap",)))
    with pytest.raises(ValidationError):
        again.seek(-1)
    memory = Offsets()
    memory.commit("g", "t", Offset(4, 0))
    memory.clear()
    assert memory.get("g", "t") is None
