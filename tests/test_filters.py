"""Truth tables of the filter language."""

import datetime as dt
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


from docquarry.errors import ValidationError
from docquarry.operators.filters import compile_filter, find, get_nested_value, validate_filter

SCHEMA = "_id string, name string, age int, score double, active boolean, created timestamp, tags array<string>, meta struct<source:string,tier:string>"
ROWS = [
    ("1", "Alice", 30, 85.5, True, dt.datetime(2024, 1, 1), ["a", "b"], ("web", "gold")),
    ("2", "Bob", 25, float("nan"), False, dt.datetime(2024, 2, 1), [], ("app", None)),
    ("3", "Cara", None, 70.0, True, None, None, None),
    ("4", None, 40, None, None, dt.datetime(2024, 3, 1), ["c"], ("web", "silver")),
    ("5", "dan", 30, -1.5, False, dt.datetime(2024, 4, 1), ["a"], (None, "gold")),
]
CASES = [
    ({}, "12345"),
    ({"age": 30}, "15"),
    ({"age": "30"}, ""),
    ({"age": None}, "3"),
    ({"nope": None}, "12345"),
    ({"nope": 1}, ""),
    ({"age": {"$eq": 25}}, "2"),
    ({"age": {"$ne": 30}}, "234"),
    ({"age": {"$ne": "30"}}, "12345"),
    ({"age": {"$gt": 25, "$lte": 30}}, "15"),
    ({"score": {"$gt": 0}}, "13"),
    ({"score": {"$lt": 0}}, "5"),
    ({"score": float("nan")}, ""),
    ({"score": {"$ne": float("nan")}}, "12345"),
    ({"score": {"$in": [float("nan"), 70.0]}}, "23"),
    ({"name": {"$gte": "B"}}, "235"),
    ({"name": {"$lt": 3}}, ""),
    ({"age": {"$in": [25, 40, None]}}, "234"),
    ({"age": {"$in": []}}, ""),
    ({"age": {"$in": 5}}, ""),
    ({"age": {"$in": ["30", 25]}}, "2"),
    ({"age": {"$nin": [30]}}, "234"),
    ({"age": {"$nin": [30, None]}}, "24"),
    ({"age": {"$nin": []}}, "12345"),
    ({"age": {"$nin": 5}}, "12345"),
    ({"age": {"$exists": True}}, "1245"),
    ({"age": {"$exists": False}}, "3"),
    ({"nope": {"$exists": False}}, "12345"),
    ({"name": {"$regex": "^[A-C]"}}, "123"),
    ({"name": {"$regex": re.compile("^D", re.I)}}, "5"),
    ({"age": {"$regex": "3"}}, ""),
    ({"age": {"$type": "number"}}, "1245"),
    ({"age": {"$type": "string"}}, ""),
    ({"age": {"$type": ["null", "string"]}}, "3"),
    ({"active": True}, "13"),
    ({"active": 1}, ""),
    ({"created": {"$gte": dt.datetime(2024, 2, 1), "$lt": dt.datetime(2024, 4, 1)}}, "24"),
    ({"meta.source": "web"}, "14"),
    ({"meta.tier": {"$exists": False}}, "23"),
    ({"meta.source.x": 1}, ""),
    ({"tags.0": "a"}, "15"),
    ({"tags.5": {"$exists": False}}, "12345"),
    ({"$and": [{"age": 30}, {"active": False}]}, "5"),
    ({"$and": []}, "12345"),
    ({"$or": [{"age": 25}, {"name": "Cara"}]}, "23"),
    ({"$or": []}, ""),
    ({"$nor": [{"age": 30}, {"active": True}]}, "24"),
    ({"$nor": []}, "12345"),
    ({"$not": {"age": 30}}, "234"),
    ({"$not": {"age": {"$gt": 26}}}, "23"),
    ({"$not": {"score": {"$gt": 0}}}, "245"),
    ({"$not": {"$not": {"age": 30}}}, "15"),
    ({"$not": {"name": {"$regex": "a"}}}, "124"),
    ({"$not": {"$or": [{"age": None}, {"age": {"$lt": 30}}]}}, "145"),
    ({"$not": {"nope": 1}}, "12345"),
    ({"$not": {"age": {"$in": [30]}}}, "234"),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.mark.parametrize("spec, expected", CASES, ids=[str(c[0]) for c in CASES])
def test_truth_table(people, spec, expected):
    assert "".join(sorted(r["_id"] for r in find(people, spec).select("_id").collect())) == expected


def test_all_cases_and_their_negations_are_total(people):
    columns = []
    for i, (spec, _) in enumerate(CASES):
        columns += [compile_filter(people, spec, total=True).alias(f"p{i}"), compile_filter(people, {"$not": spec}, total=True).alias(f"n{i}")]
    for row in people.select(*columns).collect():
        for i in range(len(CASES)):
            assert row[f"p{i}"] is (not row[f"n{i}"]), CASES[i]


@pytest.mark.parametrize(
    "spec",
    [
        [],
        {"$and": {}},
        {"$not": []},
        {"$xor": []},
        {"age": {"$near": 1}},
        {"age": {"$not": {"$gt": 1}}},
        {"age": {"x": 1}},
        {"$or": [{"a": {"$size": 2}}]},
    ],
)
def test_malformed_filters_are_refused(spec):
    with pytest.raises(ValidationError):
        validate_filter(spec)


def test_operand_checks(people):
    for spec in ({"name": {"$regex": "x" * 1001}}, {"name": {"$regex": 5}}, {"tags": ["a"]}, {"age": {"$exists": 1}}, {"age": {"$type": "quux"}}):
        with pytest.raises(ValidationError):
            compile_filter(people, spec)


def test_long_input_never_matches_a_pattern(spark):
    df = spark.createDataFrame([("x" * 10_000,), ("x" * 10_001,), ("😀" * 5_001,)], "s string")
    assert find(df, {"s": {"$regex": "."}}).count() == 1


def test_variant_documents_keep_null_and_missing_apart(spark):
    df = spark.createDataFrame([(1, '{"a": 5, "b": {"c": "x"}}'), (2, '{"a": null}'), (3, "{}"), (4, '{"a": "5"}')], "i int, j string").select("i", F.parse_json("j").alias("d"))
    ids = lambda spec: [r["i"] for r in find(df, spec).orderBy("i").collect()]
    assert ids({"d.a": 5}) == [1]
    assert ids({"d.a": "5"}) == [4]
    assert ids({"d.a": None}) == [2]
    assert ids({"d.a": {"$exists": True}}) == [1, 2, 4]
    assert ids({"d.b.c": "x"}) == [1]
    assert ids({"d.a": {"$gt": 1}}) == [1]
    assert ids({"d.a": {"$type": "string"}}) == [4]
    assert ids({"$not": {"d.a": {"$gt": 1}}}) == [2, 3, 4]


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    from docquarry.plans.pushdown import scan_details

    df = find(spark.read.parquet(str(tmp_path / "t")), {"age": {"$gte": 26}, "meta.source": "web"}).select("_id")
    found = scan_details(df)
    assert "GreaterThanOrEqual(age,26)" in found["pushed_filters"][0] and "meta.source" in found["pushed_filters"][0]
    assert "tags" not in found["read_schema"][0]


def test_nested_value_of_documents():
    doc = {"a": {"b": [1, {"c": 2}]}, "s": "x"}
    assert get_nested_value(doc, "a.b.1.c") == 2
    assert get_nested_value(doc, "a.b.7") is None
    assert get_nested_value(doc, "s.length") is None


def model(spec, row):
    """The language on one flat document."""

    def one(value, op, v):
        same = lambda a, b: isinstance(a, bool) == isinstance(b, bool) and isinstance(a, str) == isinstance(b, str) and a == b
        if op == "$eq":
            return value is None if v is None else value is not None and same(value, v)
        if op == "$ne":
            return not one(value, "$eq", v)
        if op == "$in":
            return any(one(value, "$eq", x) for x in v)
        if op == "$nin":
            return not one(value, "$in", v)
        if op == "$exists":
            return (value is not None) == v
        if value is None or isinstance(value, str) != isinstance(v, str) or isinstance(value, float) and math.isnan(value):
            return False
        return {"$gt": value > v, "$gte": value >= v, "$lt": value < v, "$lte": value <= v}[op]

    for key, value in spec.items():
        if key == "$and":
            ok = all(model(x, row) for x in value)
        elif key == "$or":
            ok = any(model(x, row) for x in value)
        elif key == "$nor":
            ok = not any(model(x, row) for x in value)
        elif key == "$not":
            ok = not model(value, row)
        else:
            ok = all(one(row.get(key), op, v) for op, v in value.items())
        if not ok:
            return False
    return True


scalars = st.one_of(st.integers(-2, 2), st.sampled_from(["a", "b"]))
leaf = st.builds(
    lambda f, op, v, vs, e: {f: {op: vs if op in ("$in", "$nin") else e if op == "$exists" else v}},
    st.sampled_from(["x", "y", "z"]),
    st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists"]),
    scalars,
    st.lists(st.one_of(scalars, st.none()), max_size=3),
    st.booleans(),
)
specs = st.recursive(leaf, lambda s: st.one_of(st.builds(lambda k, v: {k: v}, st.sampled_from(["$and", "$or", "$nor"]), st.lists(s, max_size=3)), st.builds(lambda v: {"$not": v}, s)), max_leaves=5)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(specs, min_size=8, max_size=8))
def test_against_a_model(spark, some):
    rows = [{"i": i, "x": x, "y": y, "z": z} for i, (x, y, z) in enumerate([(1, "a", 1.0), (None, "b", float("nan")), (-1, None, None), (2, "a", -2.0), (0, "", 0.5)])]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "i int, x int, y string, z double")
    got = df.select("i", *[compile_filter(df, s, total=True).alias(f"c{k}") for k, s in enumerate(some)]).collect()
    for r in got:
        for k, s in enumerate(some):
            assert r[f"c{k}"] == model(s, rows[r["i"]]), (s, rows[r["i"]])
