"""Registered queries of the document engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import functools
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.morton import interleave
from .functions.variant import decode_json, encode_json, shred
from .operators.dedup import deduplicate_by_key, deduplicate_exact, duplicate_histogram
from .operators.filters import find
from .operators.pipeline import aggregate
from .operators.projection import project
from .plans.pushdown import ColumnPredicate, ZoneMap, can_skip, column_predicates
from .sources.log import add_action, now_ms, parse_stats
from .sources.maintenance import cluster, compact, deduplicate, vacuum
from .sources.storage import open_storage
from .sources.table import Table
from .sources.vectors import inline_vector
from .sources.writer import PartsWriter, WriterOptions
from .streaming.changes import ChangeTable
from .streaming.envelope import Consumer, ConsumerConfig, Offsets, Producer, Source, select_changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a fixed number of digits: sums of doubles depend on their order in the last ones."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Filters

_FILTERS: dict[str, tuple[str, Sequence[str], Mapping, str]] = {
    "f_eq": ("orders", ["o_orderkey", "o_orderstatus"], {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    "f_eq_mismatch": ("orders", ["o_orderkey"], {"$or": [{"o_orderkey": "1"}, {"o_orderstatus": 1}, {"o_orderkey": 7}]}, "o_orderkey = 7"),
    "f_ne": ("orders", ["o_orderkey", "o_orderpriority"], {"o_orderpriority": {"$ne": "1-URGENT"}}, "o_orderpriority IS DISTINCT FROM '1-URGENT'"),
    "f_gt": ("lineitem", ["l_orderkey", "l_linenumber"], {"l_quantity": {"$gt": 45}}, "l_quantity > 45"),
    "f_gte": ("lineitem", ["l_orderkey", "l_linenumber"], {"l_discount": {"$gte": 0.08}}, "l_discount >= 0.08"),
    "f_lt": ("lineitem", ["l_orderkey", "l_linenumber"], {"l_extendedprice": {"$lt": 2000}}, "l_extendedprice < 2000"),
    "f_lte": ("lineitem", ["l_orderkey", "l_linenumber"], {"l_tax": {"$lte": 0.01}}, "l_tax <= 0.01"),
    "f_range_string": ("customer", ["c_custkey", "c_mktsegment"], {"c_mktsegment": {"$gte": "B", "$lt": "G"}}, "c_mktsegment >= 'B' AND c_mktsegment < 'G'"),
    "f_in": ("orders", ["o_orderkey"], {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", None]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL"),
    "f_nin": ("orders", ["o_orderkey"], {"o_orderstatus": {"$nin": ["F", "O"]}}, "o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')"),
    "f_exists": ("events", ["event_id"], {"value": {"$exists": True}, "missing_field": {"$exists": False}}, "value IS NOT NULL"),
    "f_type": ("events", ["event_id"], {"event_type": {"$type": "string"}, "value": {"$type": "number"}}, "event_type IS NOT NULL AND value IS NOT NULL"),
    "f_regex": ("documents", ["doc_id"], {"text": {"$regex": "th[aeiou]+n"}}, "length(text) <= 10000 AND regexp_matches(text, 'th[aeiou]+n')"),
    "f_regex_flags": ("documents", ["doc_id"], {"text": {"$regex": re.compile("^the ", re.IGNORECASE)}}, "length(text) <= 10000 AND regexp_matches(text, '^the ', 'i')"),
    "f_and": ("lineitem", ["l_orderkey", "l_linenumber"], {"$and": [{"l_returnflag": "R"}, {"l_quantity": {"$gte": 10, "$lte": 20}}]}, "l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20"),
    "f_or": ("lineitem", ["l_orderkey", "l_linenumber"], {"$or": [{"l_quantity": {"$lt": 3}}, {"l_discount": 0.1}]}, "l_quantity < 3 OR l_discount = 0.1"),
    "f_not": ("orders", ["o_orderkey"], {"$not": {"o_totalprice": {"$gt": 100000}}}, "NOT coalesce(o_totalprice > 100000, false)"),
    "f_nor": ("orders", ["o_orderkey"], {"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$lt": 50000}}]}, "NOT (coalesce(o_orderstatus = 'F', false) OR coalesce(o_totalprice < 50000, false))"),
    "f_not_nested": ("orders", ["o_orderkey"], {"$not": {"$and": [{"o_orderstatus": "O"}, {"$or": [{"o_custkey": {"$lt": 50}}, {"o_orderpriority": {"$in": ["5-LOW"]}}]}]}}, "NOT coalesce(o_orderstatus = 'O' AND (o_custkey < 50 OR o_orderpriority IN ('5-LOW')), false)"),
    "f_empty_logic": ("region", ["r_regionkey"], {"$and": [], "$nor": []}, "true"),
    "f_empty_or": ("region", ["r_regionkey"], {"$or": []}, "false"),
}


def _filter_query(table: str, columns: Sequence[str], spec: Mapping) -> Query:
    return lambda spark, sf_dir: find(read(spark, sf_dir, table), spec).select(*columns)


for _name, (_table, _columns, _spec, _where) in _FILTERS.items():
    query(_name, f"SELECT {', '.join(_columns)} FROM {_table} WHERE {_where}")(_filter_query(_table, _columns, _spec))


def _with_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their JSON properties as a struct."""
    return read(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k bigint"))


@query("f_nested", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def f_nested(spark, sf_dir):
    return find(_with_props(spark, sf_dir), {"props.k": {"$gte": 50}, "props.k.x": {"$exists": False}}).select("event_id", F.col("props.k").alias("k"))


@query("f_variant", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 20 AND json_extract(props, '$.nope') IS NULL")
def f_variant(spark, sf_dir):
    docs = read(spark, sf_dir, "events").withColumn("props", F.try_parse_json("props"))
    return find(docs, {"props.k": {"$lt": 20, "$type": "number"}, "props.nope": {"$exists": False}}).select("event_id")


# Predicates and zone maps


@query("p_predicates", "SELECT * FROM (VALUES ('a', 'gte', '1'), ('a', 'lte', '9'), ('a', 'between', '(1, 9)'), ('b', 'eq', 'x'), ('c', 'in', '[1, 2]'), ('d', 'ne', '3')) t(column_name, op, operand)")
def p_predicates(spark, sf_dir):
    spec = {"a": {"$gte": 1, "$lte": 9}, "$and": [{"b": "x"}, {"c": {"$in": [1, 2]}}], "d": {"$ne": 3, "$exists": True}, "$or": [{"e": 1}], "f": {"$regex": "x"}}
    return spark.createDataFrame([(p.column, p.operator, str(p.value)) for p in column_predicates(spec)], "column_name string, op string, operand string")


@query(
    "p_zone_skip",
    """SELECT date_trunc('month', l_shipdate) AS zone, NOT (max(l_shipdate) >= TIMESTAMP '1995-01-01' AND min(l_shipdate) <= TIMESTAMP '1995-06-30') AS skipped_by_date,
    NOT (max(l_quantity) > 49) AS skipped_by_quantity FROM lineitem GROUP BY 1""",
)
def p_zone_skip(spark, sf_dir):
    zones = read(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("zone")).agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"), F.min("l_quantity").alias("ql"), F.max("l_quantity").alias("qh"))
    import datetime as dt

    @F.udf("struct<d:boolean,q:boolean>")
    def skip(lo, hi, ql, qh):  # a row per zone
        window = ColumnPredicate("l_shipdate", "between", (dt.datetime(1995, 1, 1), dt.datetime(1995, 6, 30)))
        return can_skip(ZoneMap("l_shipdate", lo, hi), window), can_skip(ZoneMap("l_quantity", ql, qh), ColumnPredicate("l_quantity", "gt", 49))

    return zones.select("zone", skip("lo", "hi", "ql", "qh").alias("s")).select("zone", F.col("s.d").alias("skipped_by_date"), F.col("s.q").alias("skipped_by_quantity"))


# Projections


@query("j_include", "SELECT c_custkey, c_name FROM customer")
def j_include(spark, sf_dir):
    return project(read(spark, sf_dir, "customer"), ["c_custkey", "c_name", "nope"])


@query("j_include_object", "SELECT c_name, c_acctbal FROM customer")
def j_include_object(spark, sf_dir):
    return project(read(spark, sf_dir, "customer"), {"c_name": 1, "c_acctbal": 1, "c_custkey": 0})


@query("j_exclude", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def j_exclude(spark, sf_dir):
    return project(read(spark, sf_dir, "orders"), {"o_orderdate": 0, "o_orderpriority": 0})


@query("j_nested", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def j_nested(spark, sf_dir):
    return project(_with_props(spark, sf_dir), ["event_id", "props.k"]).select("event_id", F.col("props.k").alias("k"))


@query("j_exclude_nested", "SELECT event_id, user_id AS u FROM events")
def j_exclude_nested(spark, sf_dir):
    docs = read(spark, sf_dir, "events").select("event_id", F.struct("user_id", "event_type").alias("who"))
    return project(docs, {"who.event_type": 0}).select("event_id", F.col("who.*")).withColumnRenamed("user_id", "u")


# Pipelines: (table, order, pipeline, flat columns, SQL)

_P = [
    ("g_sum", "lineitem", (), [{"$group": {"_id": "$l_returnflag", "v": {"$sum": "$l_quantity"}, "none": {"$sum": "$l_linestatus"}}}], "SELECT l_returnflag AS _id, round(sum(l_quantity), 4) AS v, CAST(0 AS BIGINT) AS none FROM lineitem GROUP BY 1"),
    ("g_sum_const", "lineitem", (), [{"$group": {"_id": "$l_linestatus", "v": {"$sum": 2}}}], "SELECT l_linestatus AS _id, 2 * count(*) AS v FROM lineitem GROUP BY 1"),
    ("g_sum_nested", "lineitem", (), [{"$group": {"_id": "$l_linestatus", "a": {"$sum": {"$max": "$l_quantity"}}, "b": {"$sum": {"$count": {}}}, "c": {"$sum": {"$stdDevPop": "$l_tax"}}}}], "SELECT l_linestatus AS _id, round(sum(l_quantity), 4) AS a, count(*) AS b, CAST(0 AS BIGINT) AS c FROM lineitem GROUP BY 1"),
    ("g_avg", "lineitem", (), [{"$group": {"_id": "$l_returnflag", "v": {"$avg": "$l_extendedprice"}}}], "SELECT l_returnflag AS _id, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1"),
    ("g_min_max", "orders", (), [{"$group": {"_id": "$o_orderstatus", "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"}, "first_day": {"$min": "$o_orderdate"}, "last_prio": {"$max": "$o_orderpriority"}}}], "SELECT o_orderstatus AS _id, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi, min(o_orderdate) AS first_day, max(o_orderpriority) AS last_prio FROM orders GROUP BY 1"),
    ("g_count", "events", (), [{"$group": {"_id": "$event_type", "n": {"$count": {}}}}], "SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1"),
    ("g_std", "lineitem", (), [{"$group": {"_id": "$l_returnflag", "p": {"$stdDevPop": "$l_quantity"}, "s": {"$stdDevSamp": "$l_quantity"}}}], "SELECT l_returnflag AS _id, round(stddev_pop(l_quantity), 4) AS p, round(stddev_samp(l_quantity), 4) AS s FROM lineitem GROUP BY 1"),
    ("g_first_last", "orders", ("o_orderkey",), [{"$group": {"_id": "$o_orderstatus", "f": {"$first": "$o_custkey"}, "l": {"$last": "$o_orderpriority"}}}], "SELECT o_orderstatus AS _id, arg_min(o_custkey, o_orderkey) AS f, arg_max(o_orderpriority, o_orderkey) AS l FROM orders GROUP BY 1"),
    ("g_null_id", "orders", (), [{"$group": {"_id": None, "n": {"$count": {}}, "v": {"$avg": "$o_totalprice"}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n, round(avg(o_totalprice), 4) AS v FROM orders HAVING count(*) > 0"),
    ("g_empty", "orders", (), [{"$match": {"o_orderkey": {"$lt": 0}}}, {"$group": {"_id": None, "n": {"$count": {}}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0"),
    ("s_topk", "orders", (), [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 10}, {"$project": ["o_orderkey", "o_totalprice"]}], "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 10"),
    ("s_sort_multi", "customer", (), [{"$sort": {"c_mktsegment": 1, "c_acctbal": -1, "c_custkey": 1}}, {"$limit": 50}, {"$project": ["c_custkey", "c_mktsegment"]}], "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50"),
    ("s_limit", "part", ("p_partkey",), [{"$limit": 7}, {"$project": ["p_partkey"]}], "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7"),
    ("s_skip", "supplier", ("s_suppkey",), [{"$skip": 5}, {"$limit": 20}, {"$project": ["s_suppkey"]}], "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 5"),
    ("s_skip_past_end", "region", ("r_regionkey",), [{"$skip": 100}, {"$project": ["r_regionkey"]}], "SELECT r_regionkey FROM region WHERE false"),
    ("s_count_stage", "events", (), [{"$match": {"event_type": "click"}}, {"$count": "n"}], "SELECT count(*) AS n FROM events WHERE event_type = 'click' HAVING count(*) > 0"),
    ("slice", "lineitem", (), [{"$match": {"l_quantity": {"$gte": 10}}}, {"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "n": {"$count": {}}}}, {"$sort": {"qty": -1}}, {"$limit": 10}], "SELECT l_returnflag AS _id, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1"),
    # analytics: counts, filtered counts, sums, bounds, and groups by size
    ("q0_count", "events", (), [{"$group": {"_id": None, "n": {"$count": {}}}}, {"$project": ["n"]}], "SELECT count(*) AS n FROM events"),
    ("q1_filtered_count", "events", (), [{"$match": {"value": {"$ne": 0}}}, {"$group": {"_id": None, "n": {"$count": {}}}}, {"$project": ["n"]}], "SELECT count(*) AS n FROM events WHERE value IS DISTINCT FROM 0"),
    ("q2_sum_avg", "lineitem", (), [{"$group": {"_id": None, "s": {"$sum": "$l_tax"}, "n": {"$sum": 1}, "a": {"$avg": "$l_quantity"}}}, {"$project": {"_id": 0}}], "SELECT round(sum(l_tax), 4) AS s, count(*) AS n, round(avg(l_quantity), 4) AS a FROM lineitem"),
    ("q6_bounds", "orders", (), [{"$group": {"_id": None, "lo": {"$min": "$o_orderdate"}, "hi": {"$max": "$o_orderdate"}}}, {"$project": ["lo", "hi"]}], "SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders"),
    ("q7_group_filtered", "lineitem", (), [{"$match": {"l_discount": {"$ne": 0}}}, {"$group": {"_id": "$l_linenumber", "n": {"$count": {}}}}, {"$sort": {"n": -1}}], "SELECT l_linenumber AS _id, count(*) AS n FROM lineitem WHERE l_discount IS DISTINCT FROM 0 GROUP BY 1"),
    ("q8_group_top", "events", (), [{"$group": {"_id": "$user_id", "n": {"$count": {}}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 10}], "SELECT user_id AS _id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"),
    ("q15_group_keys", "lineitem", (), [{"$group": {"_id": "$l_suppkey", "n": {"$count": {}}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 10}], "SELECT l_suppkey AS _id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"),
    ("q33_group_text", "documents", (), [{"$group": {"_id": "$source", "n": {"$count": {}}, "size": {"$sum": "$n_chars"}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 10}], "SELECT source AS _id, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"),
    # point queries
    ("pq_scan", "customer", (), [{"$project": ["c_custkey"]}], "SELECT c_custkey FROM customer"),
    ("pq_by_group", "customer", (), [{"$match": {"c_nationkey": 3}}, {"$project": ["c_custkey"]}], "SELECT c_custkey FROM customer WHERE c_nationkey = 3"),
    ("pq_flag", "lineitem", (), [{"$match": {"l_linestatus": "O", "l_linenumber": 1}}, {"$project": ["l_orderkey"]}], "SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber = 1"),
]


def _pipeline_query(table: str, order: Sequence[str], pipeline: Sequence[Mapping]) -> Query:
    return lambda spark, sf_dir: rounded(aggregate(read(spark, sf_dir, table), pipeline, order=order))


for _name, _table, _order, _pipeline, _sql in _P:
    query(_name, _sql)(_pipeline_query(_table, _order, _pipeline))


@query("pq_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01'")
def pq_date_range(spark, sf_dir):
    import datetime as dt

    return find(read(spark, sf_dir, "orders"), {"o_orderdate": {"$gte": dt.datetime(1995, 1, 1), "$lt": dt.datetime(1995, 3, 1)}}).select("o_orderkey")


@query("g_compound", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def g_compound(spark, sf_dir):
    return aggregate(read(spark, sf_dir, "lineitem"), [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$count": {}}}}]).select("_id.*", "n")


@query("g_push", "SELECT o_custkey AS _id, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1")
def g_push(spark, sf_dir):
    out = aggregate(read(spark, sf_dir, "orders"), [{"$group": {"_id": "$o_custkey", "v": {"$push": "$o_orderpriority"}}}], order=["o_orderkey"])
    return out.select("_id", F.array_join("v", ",").alias("v"))


@query("g_add_to_set", "SELECT o_custkey AS _id, string_agg(p, ',' ORDER BY k) AS v FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
def g_add_to_set(spark, sf_dir):
    out = aggregate(read(spark, sf_dir, "orders"), [{"$group": {"_id": "$o_custkey", "v": {"$addToSet": "$o_orderpriority"}}}], order=["o_orderkey"])
    return out.select("_id", F.array_join("v", ",").alias("v"))


@query("g_sorted_first", "SELECT o_custkey AS _id, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS top FROM orders GROUP BY 1")
def g_sorted_first(spark, sf_dir):
    return aggregate(read(spark, sf_dir, "orders"), [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "top": {"$first": "$o_orderkey"}}}])


@query("u_unwind", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def u_unwind(spark, sf_dir):
    docs = read(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    return aggregate(docs, [{"$unwind": "$words"}, {"$group": {"_id": "$words", "n": {"$count": {}}}}]).withColumnRenamed("_id", "word")


_LONG = "CASE WHEN r_regionkey < 2 THEN string_split(r_name, 'A') WHEN r_regionkey = 2 THEN [] ELSE NULL END"


@query("u_unwind_preserve", f"SELECT r_regionkey, w FROM (SELECT r_regionkey, unnest({_LONG}) AS w FROM region) UNION ALL SELECT r_regionkey, NULL FROM region WHERE r_regionkey >= 2")
def u_unwind_preserve(spark, sf_dir):
    words = F.when(F.col("r_regionkey") < 2, F.split("r_name", "A")).when(F.col("r_regionkey") == 2, F.array().cast("array<string>"))
    docs = read(spark, sf_dir, "region").withColumn("w", words)
    return aggregate(docs, [{"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}, {"$project": ["r_regionkey", "w"]}])


@query("u_unwind_nested", "SELECT r_regionkey, unnest(string_split(r_name, 'A')) AS w FROM region")
def u_unwind_nested(spark, sf_dir):
    docs = read(spark, sf_dir, "region").withColumn("d", F.struct(F.split("r_name", "A").alias("w"), F.col("r_name").alias("n")))
    return aggregate(docs, [{"$unwind": "$d.w"}]).select("r_regionkey", F.col("d.w").alias("w"))


# Deduplication and curves

_EV = "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY {}) = 1"


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@query("m_dedup_first", _EV.format("event_id"))
def m_dedup_first(spark, sf_dir):
    return deduplicate_by_key(_events(spark, sf_dir), ["user_id", "event_type"], "first", ["event_id"]).drop("value")


@query("m_dedup_last", _EV.format("event_id DESC"))
def m_dedup_last(spark, sf_dir):
    return deduplicate_by_key(_events(spark, sf_dir), ["user_id", "event_type"], "last", ["event_id"]).drop("value")


@query("m_dedup_latest", _EV.format("value DESC NULLS LAST, event_id"))
def m_dedup_latest(spark, sf_dir):
    return deduplicate_by_key(_events(spark, sf_dir), ["user_id", "event_type"], "latest", ["event_id"], "value").drop("value")


@query("m_dedup_exact", "SELECT DISTINCT user_id, event_type FROM events")
def m_dedup_exact(spark, sf_dir):
    return deduplicate_exact(read(spark, sf_dir, "events").select("user_id", "event_type"))


@query("m_dedup_hist", "SELECT c - 1 AS extra_copies, count(*) AS n_keys FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type) GROUP BY 1")
def m_dedup_hist(spark, sf_dir):
    return duplicate_histogram(read(spark, sf_dir, "events"), ["user_id", "event_type"])


_BITS = " | ".join(f"(((l_partkey >> {i}) & 1) << {2 * i}) | (((l_suppkey >> {i}) & 1) << {2 * i + 1})" for i in range(21))


@query("m_zorder_key", f"SELECT l_orderkey, l_linenumber, {_BITS} AS z FROM lineitem")
def m_zorder_key(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", interleave([F.col("l_partkey"), F.col("l_suppkey")]).alias("z"))


# Tables: scratch copies under the shared folder, made anew by each call


def scratch(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='docquarry-')}/table-{uuid.uuid4().hex}"


def _orders_table(spark: SparkSession, sf_dir: str, kind: type[Table] = Table, partitions: Sequence[str] | None = None) -> Table:
    table = kind(spark, scratch(spark))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    table.append(orders.where("o_orderkey % 2 = 0"), partitions)
    table.append(orders.where("o_orderkey % 2 = 1"))
    return table


_HALF = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@query("t_append", _HALF)
def t_append(spark, sf_dir):
    return _orders_table(spark, sf_dir).find()


@query("t_time_travel", f"{_HALF} WHERE o_orderkey % 2 = 0")
def t_time_travel(spark, sf_dir):
    return _orders_table(spark, sf_dir).find(version=0)


@query("t_partitioned", f"{_HALF} WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 1000")
def t_partitioned(spark, sf_dir):
    return _orders_table(spark, sf_dir, partitions=["o_orderstatus"]).find({"o_orderstatus": {"$in": ["F", "P"]}, "o_totalprice": {"$gt": 1000}})


@query("t_delete", f"{_HALF} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def t_delete(spark, sf_dir):
    table = _orders_table(spark, sf_dir)
    table.delete({"o_orderstatus": "F", "o_totalprice": {"$lt": 100000}})
    return table.find()


@query("t_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey < 100 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def t_update(spark, sf_dir):
    table = _orders_table(spark, sf_dir)
    table.update({"o_custkey": {"$lt": 100}}, {"o_orderstatus": "X", "o_totalprice": 0.0})
    return table.find()


_MERGE_SRC = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey, 'M' AS o_orderstatus, 1.0 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0"


@query("t_merge", f"WITH src AS ({_MERGE_SRC}) {_HALF} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src) UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) FROM src")
def t_merge(spark, sf_dir):
    table = _orders_table(spark, sf_dir)
    table.merge(_merge_source(spark, sf_dir), ["o_orderkey"])
    return table.find()


def _merge_source(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(key.alias("o_orderkey"), "o_custkey", F.lit("M").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))


@query("t_evolve", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS note FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def t_evolve(spark, sf_dir):
    table = Table(spark, scratch(spark))
    customers = read(spark, sf_dir, "customer")
    table.append(customers.where("c_custkey % 2 = 0").select("c_custkey"))
    table.append(customers.where("c_custkey % 2 = 1").select("c_custkey", F.col("c_mktsegment").alias("note")))
    return table.find()


@query("t_compact", _HALF)
def t_compact(spark, sf_dir):
    table = _orders_table(spark, sf_dir)
    compact(table, strategy="bin-packing", verify=True)
    return table.find()


@query("t_cluster", _HALF)
def t_cluster(spark, sf_dir):
    table = _orders_table(spark, sf_dir)
    cluster(table, ["o_custkey", "o_totalprice"], files=4)
    return table.find()


@query("t_dedup", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def t_dedup(spark, sf_dir):
    table = Table(spark, scratch(spark))
    table.append(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"))
    deduplicate(table, ["o_custkey"], "latest", "o_orderkey")
    return table.find()


@query("t_pipeline", "SELECT o_orderstatus AS _id, count(*) AS n, round(sum(o_totalprice), 4) AS v FROM orders WHERE o_totalprice >= 1000 GROUP BY 1")
def t_pipeline(spark, sf_dir):
    return rounded(_orders_table(spark, sf_dir).aggregate([{"$match": {"o_totalprice": {"$gte": 1000}}}, {"$group": {"_id": "$o_orderstatus", "n": {"$count": {}}, "v": {"$sum": "$o_totalprice"}}}]))


# A user's column names, first matches, order, and the maintenance strategies


@query("t_merge_names", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS action, o_custkey AS before, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE o_totalprice END AS after FROM orders")
def t_merge_names(spark, sf_dir):
    table = Table(spark, scratch(spark))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("action"), F.col("o_custkey").alias("before"), F.col("o_totalprice").alias("after"))
    table.append(rows)
    table.merge(rows.where("id % 5 = 0").select("id", F.lit("new").alias("action"), "before", F.lit(1.0).alias("after")), ["id"])
    return table.find()


@query("t_merge_first", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AND o_custkey % 2 = 0 THEN 'first' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def t_merge_first(spark, sf_dir):
    """Each incoming row changes the first row of its key."""
    table = Table(spark, scratch(spark))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    table.append(orders.coalesce(1).sortWithinPartitions("o_orderkey"))
    table.merge(orders.where("o_custkey % 2 = 0").select("o_custkey").distinct(), ["o_custkey"], {"o_orderstatus": F.lit("first")})
    return table.find()


@query("t_merge_insert_when", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_mktsegment) || '!' FROM customer WHERE c_custkey % 4 = 1")
def t_merge_insert_when(spark, sf_dir):
    """Unmatched rows are skipped or come changed, row by row."""
    table = Table(spark, scratch(spark))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    table.append(customers.where("c_custkey % 2 = 0"))
    table.merge(customers, ["c_custkey"], None, {"c_mktsegment": F.concat(F.upper("src.c_mktsegment"), F.lit("!"))}, insert_when=F.col("src.c_custkey") % 4 == 1)
    return table.find()


def _many_files(spark: SparkSession, sf_dir: str) -> Table:
    """Four files of customers, in the order of their keys."""
    table = Table(spark, scratch(spark))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    most = customers.agg(F.max("c_custkey")).collect()[0][0]
    for k in range(4):
        part = customers.where(F.floor(F.col("c_custkey") * 4 / F.lit(most + 1)) == k)
        table.append(part.coalesce(1).sortWithinPartitions("c_custkey"))
    return table


_CUSTOMERS = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"


@query("t_compact_order", "SELECT c_nationkey AS _id, min(c_custkey) AS f, max(c_custkey) AS l FROM customer GROUP BY 1")
def t_compact_order(spark, sf_dir):
    """Compaction keeps the table's own order."""
    table = _many_files(spark, sf_dir)
    compact(table, verify=True)
    return table.aggregate([{"$group": {"_id": "$c_nationkey", "f": {"$first": "$c_custkey"}, "l": {"$last": "$c_custkey"}}}])


@query("t_compact_by_size", _CUSTOMERS)
def t_compact_by_size(spark, sf_dir):
    table = _many_files(spark, sf_dir)
    compact(table, strategy="sort-by-size", verify=True)
    return table.find()


@query("t_compact_dry_run", "SELECT 4 AS files_before, 4 AS files_removed, 1 AS files_added, CAST(NULL AS BIGINT) AS version, 4 AS files_now")
def t_compact_dry_run(spark, sf_dir):
    table = _many_files(spark, sf_dir)
    r = compact(table, dry_run=True)
    return spark.createDataFrame([(r.files_before, r.files_removed, r.files_added, r.version, len(table.snapshot().files))], "files_before int, files_removed int, files_added int, version long, files_now int")


@query("t_cluster_hilbert", _CUSTOMERS)
def t_cluster_hilbert(spark, sf_dir):
    table = _many_files(spark, sf_dir)
    cluster(table, ["c_nationkey", "c_acctbal"], "hilbert", files=4)
    return table.find()


@query("t_vacuum", "SELECT 'kept' AS what, count(*) AS n FROM customer UNION ALL SELECT 'deleted files', 4 UNION ALL SELECT 'planned', 4")
def t_vacuum(spark, sf_dir):
    """After a compaction the four files that it replaced go."""
    table = _many_files(spark, sf_dir)
    compact(table)
    later = now_ms() + 10 * 3_600_000
    planned = vacuum(table, 2, dry_run=True, now=later)
    gone = vacuum(table, 2, now=later)
    return spark.createDataFrame([("kept", table.count()), ("deleted files", len(gone.deleted)), ("planned", len(planned.deleted))], "what string, n long")


# The log: checkpoints, cleanup, time travel, snapshots, raw commits


def _nations(spark: SparkSession, sf_dir: str, commits: int) -> Table:
    """A commit per nation key below ``commits``; checkpoints every ten versions."""
    table = Table(spark, scratch(spark))
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for k in range(commits):
        table.append(nations.where(F.col("n_nationkey") == k).coalesce(1))
    return table


@query("l_checkpoint", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 12")
def l_checkpoint(spark, sf_dir):
    """Read from the checkpoint and the commits after it, with the commits before it gone."""
    table = _nations(spark, sf_dir, 12)
    at = table.log.last_checkpoint()
    if at is None or not table.log.validate_checkpoint(at):
        raise AssertionError("no valid checkpoint")
    table.log.clean_log(at)
    return Table(spark, table.root).find()


@query("l_versions", "SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3)) t(v, n)")
def l_versions(spark, sf_dir):
    table = _nations(spark, sf_dir, 3)
    return spark.createDataFrame([(v, table.find(version=v).count()) for v in table.log.versions()], "v int, n int")


@query("l_as_of_time", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 2")
def l_as_of_time(spark, sf_dir):
    table = _nations(spark, sf_dir, 2)
    stamp = next(a["commitInfo"]["timestamp"] for a in table.log.read(1) if "commitInfo" in a)
    time.sleep(0.02)
    table.delete({"n_nationkey": 1})
    return table.find(timestamp_ms=stamp)


@query("l_snapshot", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 2")
def l_snapshot(spark, sf_dir):
    """A pinned snapshot doesn't move with the table."""
    table = _nations(spark, sf_dir, 2)
    pinned = table.snapshot()
    table.delete({"n_nationkey": {"$gte": 0}})
    return table.find(snapshot=pinned)


@query("l_metadata", "SELECT 'nations' AS name, 'x' AS description, 'on' AS setting, 3 AS version")
def l_metadata(spark, sf_dir):
    table = _nations(spark, sf_dir, 2)
    table.update_metadata(name="nations", description="x")
    table.set_configuration(setting="on")
    meta = table.snapshot().metadata
    return spark.createDataFrame([(meta["name"], meta["description"], table.configuration()["setting"], table.version())], "name string, description string, setting string, version int")


@query("l_deletion_vector", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 3)")
def l_deletion_vector(spark, sf_dir):
    """A file is committed again with its first three rows dead."""
    table = _many_files(spark, sf_dir)
    path, body = next(iter(table.snapshot().files.items()))
    table.commit([add_action(path, body["size"], body["partitionValues"], deletion_vector=inline_vector(np.arange(3)))])
    return table.find()


@query("l_column_mapping", "SELECT n_nationkey, n_name FROM nation WHERE n_name >= 'J'")
def l_column_mapping(spark, sf_dir):
    """The files hold ``col-1`` where the table says n_name."""
    table = Table(spark, scratch(spark))
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("n_name", metadata={"columnMapping.physicalName": "col-1"}))
    table.append(nations, configuration={"columnMapping.mode": "name"})
    return table.find({"n_name": {"$gte": "J"}})


@query("l_skipped_by_time", "SELECT o_orderkey, 1 AS skipped FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01'")
def l_skipped_by_time(spark, sf_dir):
    """Files are skipped by the bounds of a time column: the older of two here."""
    table = Table(spark, scratch(spark))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    for part in ("o_orderdate < '1996-01-01'", "o_orderdate >= '1996-01-01'"):
        table.append(orders.where(part).coalesce(1))
    found = table.find({"o_orderdate": {"$gte": datetime.datetime(1997, 1, 1), "$lt": datetime.datetime(1997, 3, 1)}}, ["o_orderkey"])
    return found.withColumn("skipped", F.lit(table.last_skipped_files))


@query("l_batches", "SELECT 10 AS size, 2 AS n UNION ALL SELECT 5, 1")
def l_batches(spark, sf_dir):
    table = Table(spark, scratch(spark))
    table.append(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    sizes = [len(b) for b in table.batches(size=10)]
    return spark.createDataFrame([(s, sizes.count(s)) for s in sorted(set(sizes))], "size int, n int")


@query("l_partition_paths", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def l_partition_paths(spark, sf_dir):
    """Rows by the partition values that the log gives their files."""
    table = _orders_table(spark, sf_dir, partitions=["o_orderstatus"])
    files = [(f["partitionValues"]["o_orderstatus"], parse_stats(f["stats"])["numRecords"]) for f in table.snapshot().files.values()]
    return spark.createDataFrame(files, "value string, n long").groupBy("value").agg(F.sum("n").alias("n"))


@query("l_parts_writer", "SELECT n_nationkey, n_name FROM nation")
def l_parts_writer(spark, sf_dir):
    """Documents written in parts of ten."""
    folder = scratch(spark)
    writer = PartsWriter(spark, folder, WriterOptions(group_rows=10))
    rows = [r.asDict() for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]  # 25 rows
    for k in range(0, len(rows), 7):
        writer.write(rows[k : k + 7])
    writer.finish()
    return spark.read.parquet(f"{folder}/parts").select("n_nationkey", "n_name")


@query("w_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS again FROM events")
def w_variant(spark, sf_dir):
    """Encoded as a variant, shredded by path, and decoded."""
    docs = read(spark, sf_dir, "events").select("event_id", encode_json(F.col("props")).alias("v"))
    return docs.select("event_id", *shred(F.col("v"), {"k": "bigint"}), F.get_json_object(decode_json(F.col("v")), "$.k").alias("again"))


# Change feed


@functools.cache
def _feed_sql() -> str:
    insert = "SELECT 'insert' AS kind, CAST(o_orderkey % 2 AS BIGINT) AS v, o_orderkey, o_orderstatus FROM orders"
    pre = "SELECT 'update_preimage', CAST(2 AS BIGINT), o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'"
    post = "SELECT 'update_postimage', CAST(2 AS BIGINT), o_orderkey, 'Q' FROM orders WHERE o_orderstatus = 'P'"
    delete = "SELECT 'delete', CAST(3 AS BIGINT), o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Q' ELSE o_orderstatus END FROM orders WHERE o_custkey < 50"
    return f"{insert} UNION ALL {pre} UNION ALL {post} UNION ALL {delete}"


def _feed_table(spark, sf_dir) -> ChangeTable:
    table = _orders_table(spark, sf_dir, ChangeTable)
    table.update({"o_orderstatus": "P"}, {"o_orderstatus": "Q"})
    table.delete({"o_custkey": {"$lt": 50}})
    return table


def _flat(feed: DataFrame) -> DataFrame:
    return feed.select(F.col("_change_type").alias("kind"), F.col("_commit_version").alias("v"), "o_orderkey", "o_orderstatus")


@query("c_feed", _feed_sql())
def c_feed(spark, sf_dir):
    return _flat(_feed_table(spark, sf_dir).changes(0))


@query("c_feed_range", f"SELECT * FROM ({_feed_sql()}) WHERE v BETWEEN 2 AND 3")
def c_feed_range(spark, sf_dir):
    return _flat(_feed_table(spark, sf_dir).changes(2, 3))


@query("c_feed_time", f"SELECT * FROM ({_feed_sql()}) WHERE v BETWEEN 1 AND 2")
def c_feed_time(spark, sf_dir):
    table = _feed_table(spark, sf_dir)
    first, last = (next(a["commitInfo"]["timestamp"] for a in table.log.read(v) if "commitInfo" in a) for v in (1, 2))
    return _flat(table.changes_between(first, last))


@query("c_offsets", "SELECT * FROM (VALUES ('processed', 5), ('position', 15), ('resumed', 15), ('after seek', 3), ('after reset', 0)) t(what, n)")
def c_offsets(spark, sf_dir):
    """A consumer reads, commits, and another one goes on where it stopped."""
    made = Producer(Source("docquarry"), sequence=10).create(read(spark, sf_dir, "region"), "r_regionkey")
    offsets = Offsets(open_storage(scratch(spark), spark))
    first = Consumer(ConsumerConfig("readers", "regions"), offsets)
    seen: list[int] = []
    first.subscribe(lambda part: seen.append(part.count()))
    first.process(made)
    first.commit()
    second = Consumer(ConsumerConfig("readers", "regions"), offsets)
    found = [("processed", seen[0]), ("position", first.position), ("resumed", second.resume())]
    second.seek(3)
    found.append(("after seek", second.position))
    second.reset()
    return spark.createDataFrame([*found, ("after reset", second.position)], "what string, n int")


@query("c_feed_merge", f"""WITH src AS ({_MERGE_SRC}) SELECT 'update_preimage' AS kind, o.o_orderkey, o.o_orderstatus FROM orders o JOIN src USING (o_orderkey)
    UNION ALL SELECT 'update_postimage', o_orderkey, 'M' FROM src WHERE o_orderkey >= 0 UNION ALL SELECT 'insert', o_orderkey, 'M' FROM src WHERE o_orderkey < 0""")
def c_feed_merge(spark, sf_dir):
    table = _orders_table(spark, sf_dir, ChangeTable)
    version = table.merge(_merge_source(spark, sf_dir), ["o_orderkey"])
    return _flat(table.changes(version, version)).drop("v")


@query("c_producer", "SELECT CAST(event_id AS VARCHAR) AS id, row_number() OVER (ORDER BY event_id) + 99 AS seq, 'c' AS op, user_id FROM events")
def c_producer(spark, sf_dir):
    producer = Producer(Source("docquarry", "db", "events"), sequence=100)
    out = producer.create(_events(spark, sf_dir), "event_id")
    return out.select(F.col("_id").alias("id"), F.col("_seq").alias("seq"), F.col("_op").alias("op"), F.col("_after.user_id").alias("user_id"))


@query("c_consumer_filter", "SELECT CAST(event_id AS VARCHAR) AS id, 'd' AS op FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS s FROM events WHERE event_type = 'error') WHERE s >= 10")
def c_consumer_filter(spark, sf_dir):
    producer = Producer(Source("docquarry"))
    gone = producer.delete(_events(spark, sf_dir).where("event_type = 'error'"), "event_id")
    made = producer.create(_events(spark, sf_dir).where("event_type = 'click'"), "event_id")
    return select_changes(gone.unionByName(made), ["delete"], from_sequence=10).select(F.col("_id").alias("id"), F.col("_op").alias("op"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["slice"](spark, sf_dir)


