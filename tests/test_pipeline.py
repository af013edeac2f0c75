"""Stages and accumulators on small documents."""

import datetime as dt

import pytest

from docquarry.errors import ValidationError
from docquarry.operators.pipeline import aggregate, aggregate_with_stats
from docquarry.operators.projection import parse_projection, project, projection_columns

SALES = [
    {"product": "A", "region": "N", "quantity": 10, "price": 2.5, "tags": ["x", "y"]},
    {"product": "B", "region": "S", "quantity": 5, "price": None, "tags": ["y"]},
    {"product": "A", "region": "S", "quantity": None, "price": 4.0, "tags": []},
    {"product": "C", "region": "N", "quantity": 7, "price": 1.0, "tags": None},
    {"product": "B", "region": "N", "quantity": 1, "price": 3.0, "tags": ["x"]},
]


def run(spark, pipeline, docs=SALES, **more):
    return [r.asDict(True) for r in aggregate(docs, pipeline, spark=spark, **more).collect()]


def group(spark, acc, docs=SALES, key="$product"):
    return {r["_id"]: r["v"] for r in run(spark, [{"$group": {"_id": key, "v": acc}}], docs)}


@pytest.mark.parametrize(
    "acc, expected",
    [
        ({"$sum": "$quantity"}, {"A": 10, "B": 6, "C": 7}),
        ({"$sum": 2}, {"A": 4, "B": 4, "C": 2}),
        ({"$sum": "$region"}, {"A": 0, "B": 0, "C": 0}),
        ({"$sum": {"$avg": "$quantity"}}, {"A": 10, "B": 6, "C": 7}),
        ({"$sum": {"$count": {}}}, {"A": 2, "B": 2, "C": 1}),
        ({"$sum": {"$push": "$quantity"}}, {"A": 0, "B": 0, "C": 0}),
        ({"$avg": "$price"}, {"A": 3.25, "B": 3.0, "C": 1.0}),
        ({"$avg": "$region"}, {"A": None, "B": None, "C": None}),
        ({"$min": "$price"}, {"A": 2.5, "B": 3.0, "C": 1.0}),
        ({"$max": "$region"}, {"A": "S", "B": "S", "C": "N"}),
        ({"$first": "$price"}, {"A": 2.5, "B": None, "C": 1.0}),
        ({"$last": "$quantity"}, {"A": None, "B": 1, "C": 7}),
        ({"$push": "$quantity"}, {"A": [10, None], "B": [5, 1], "C": [7]}),
        ({"$addToSet": "$region"}, {"A": ["N", "S"], "B": ["S", "N"], "C": ["N"]}),
        ({"$count": {}}, {"A": 2, "B": 2, "C": 1}),
        ({"$stdDevPop": "$quantity"}, {"A": 0.0, "B": 2.0, "C": 0.0}),
        ({"$stdDevSamp": "$quantity"}, {"A": None, "B": 8**0.5, "C": None}),
        ({"$sum": "$missing"}, {"A": 0, "B": 0, "C": 0}),
        ({"$first": "$missing"}, {"A": None, "B": None, "C": None}),
    ],
)
def test_accumulators(spark, acc, expected):
    assert group(spark, acc) == pytest.approx(expected) if not any(isinstance(v, list) for v in expected.values()) else group(spark, acc) == expected


def test_add_to_set_keeps_one_null(spark):
    docs = [{"g": 1, "v": None}, {"g": 1, "v": 3}, {"g": 1, "v": None}]
    assert group(spark, {"$addToSet": "$v"}, docs, "$g") == {1: [None, 3]}


def test_group_keys(spark):
    assert run(spark, [{"$group": {"_id": None, "n": {"$count": {}}}}]) == [{"_id": None, "n": 5}]
    assert run(spark, [{"$match": {"product": "Z"}}, {"$group": {"_id": None, "n": {"$count": {}}}}]) == []
    got = run(spark, [{"$group": {"_id": {"p": "$product", "r": "$region"}, "n": {"$sum": 1}}}])
    assert {"_id": {"p": "A", "r": "N"}, "n": 1} in got and len(got) == 5
    assert group(spark, {"$count": {}}, key="$missing") == {None: 5}
    assert [r["_id"] for r in run(spark, [{"$group": {"_id": "$product"}}])] == ["A", "B", "C"]  # as first seen


def test_sort_is_stable_and_puts_nulls_low(spark):
    assert [r["quantity"] for r in run(spark, [{"$sort": {"quantity": 1}}])] == [None, 1, 5, 7, 10]
    assert [r["quantity"] for r in run(spark, [{"$sort": {"quantity": -1}}])] == [10, 7, 5, 1, None]
    assert [r["quantity"] for r in run(spark, [{"$sort": {"product": -1}}])] == [7, 5, 1, 10, None]
    assert [r["price"] for r in run(spark, [{"$sort": {"region": 1, "price": -1}}, {"$skip": 1}, {"$limit": 2}])] == [2.5, 1.0]
    names = [{"n": x} for x in ["b", "A", "a", "_", "B"]]
    assert [r["n"] for r in run(spark, [{"$sort": {"n": 1}}], names)] == ["A", "B", "_", "a", "b"]
    assert [r["n"] for r in run(spark, [{"$sort": {"n": 1}}], names, collation="UNICODE")] == ["_", "a", "A", "b", "B"]


def test_first_after_a_descending_sort(spark):
    got = run(spark, [{"$sort": {"region": -1, "quantity": -1}}, {"$group": {"_id": "$product", "q": {"$first": "$quantity"}, "all": {"$push": "$region"}}}])
    assert {r["_id"]: (r["q"], r["all"]) for r in got} == {"A": (None, ["S", "N"]), "B": (5, ["S", "N"]), "C": (7, ["N"])}


def test_unwind(spark):
    assert [(r["product"], r["tags"]) for r in run(spark, [{"$unwind": "$tags"}])] == [("A", "x"), ("A", "y"), ("B", "y"), ("B", "x")]
    keep = [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}}]
    assert [(r["product"], r["tags"]) for r in run(spark, keep)] == [("A", "x"), ("A", "y"), ("B", "y"), ("A", None), ("C", None), ("B", "x")]
    assert run(spark, [{"$unwind": "$product"}]) == []
    nested = [{"i": 1, "d": {"a": [1, 2], "b": 0}}]
    assert run(spark, [{"$unwind": "$d.a"}], nested) == [{"i": 1, "d": {"a": 1, "b": 0}}, {"i": 1, "d": {"a": 2, "b": 0}}]


def test_limits_and_project(spark):
    assert len(run(spark, [{"$limit": 2}])) == 2 and run(spark, [{"$limit": 0}]) == []
    assert [r["product"] for r in run(spark, [{"$skip": 3}])] == ["C", "B"]
    assert run(spark, [{"$match": {"product": "C"}}, {"$project": {"tags": 0, "price": 0}}]) == [{"product": "C", "region": "N", "quantity": 7}]
    assert run(spark, [{"$count": "n"}]) == [{"n": 5}] and run(spark, [{"$match": {"product": 1}}, {"$count": "n"}]) == []


@pytest.mark.parametrize(
    "pipeline",
    [
        [{"$limit": -1}],
        [{"$skip": 1.5}],
        [{"$nope": 1}],
        [{"$group": {"n": {"$sum": 1}}}],
        [{"$group": {"_id": "$a", "n": {"$median": "$x"}}}],
        [{"$group": {"_id": "$a", "n": 5}}],
        [{"$group": {"_id": 5}}],
        [{"$sort": {"a": 2}}],
        [{"$unwind": "tags"}],
        [{"$match": {"a": {"$foo": 1}}}],
        [{"$match": {}, "$limit": 1}],
        {"$match": {}},
        [{"$group": {"_id": None, "n": {"$sum": "plain"}}}],
    ],
)
def test_bad_pipelines_are_refused(spark, pipeline):
    with pytest.raises(ValidationError):
        aggregate(SALES, pipeline, spark=spark)


def test_stats_and_empty_input(spark):
    r = aggregate_with_stats(SALES, [{"$match": {"region": "N"}}, {"$group": {"_id": "$product"}}], spark=spark)
    assert (r.documents_processed, r.groups_created, len(r.documents)) == (5, 3, 3)
    assert run(spark, [{"$match": {"a": 1}}, {"$group": {"_id": "$a", "n": {"$sum": "$b"}}}], []) == []


def test_projection_rules(spark):
    df = spark.createDataFrame([(1, (2, (3, 4)), dt.datetime(2024, 1, 1))], "a int, b struct<c:int,d:struct<e:int,f:int>>, t timestamp")
    row = lambda spec: project(df, spec).collect()[0].asDict(True)
    assert row(["b.d.f", "a"]) == {"b": {"d": {"f": 4}}, "a": 1}
    assert row({"b.d.e": 0, "t": 0}) == {"a": 1, "b": {"c": 2, "d": {"f": 4}}}
    assert row(["a", "zzz", "a.x"]) == {"a": 1}
    assert row({}) == row(None) and set(row(None)) == {"a", "b", "t"}
    assert row({"a": 1, "t": 0}) == {"a": 1}
    assert projection_columns(["b.c", "b.d", "a"]) == ["b", "a"] and projection_columns({"a": 0}) == []
    for bad in ({"a": 5}, "a", [1]):
        with pytest.raises(ValidationError):
            parse_projection(bad)
