"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from docquarry.llm import queries as Q
from docquarry.llm.byte_bpe import encode_documents
from docquarry.llm.compression_bands import compression_bands
from docquarry.llm.cross_entropy import cross_entropy_difference, learn_pair
from docquarry.llm.gam_quality import learn_quality, score_quality
from docquarry.llm.jaccard_join import jaccard_components
from docquarry.llm.nn_descent import nearest
from docquarry.llm.packing import best_fit_packing
from docquarry.llm.ppm_language import identify_languages, learn_languages
from docquarry.llm.sharding import byte_shards
from docquarry.llm.substring_dedup import drop_repeated_spans, repeated_spans

LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, score string, v int, n_words string, cut_id int, cut int, piece int, shard int, component_id string, digest string, bits string, draw int, hi int"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from all of the hunters in the wood today"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "one"),
    (6, "one"),
    (None, "a row without an id"),
    (None, None),
    (7, "der schnelle braune fuchs springt über den faulen hund und läuft vor allen jägern im walde davon"),
    (8, "12345 67890 !!"),
    (9, "日本語のテキスト 😀😀"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 3 else ("de" if i == 7 else "en"), "s", len(t or ""), *[None] * 13) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 0), (7, 1, None), (None, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def operators(labels):
    bpe = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    words = public_tokenizers.path("word_bpe_49k.json")
    return {
        "bands": compression_bands,
        "languages": lambda d: identify_languages(d, learn_languages(d, F.lit(True))),
        "bpe": lambda d: encode_documents(d, bpe, public_tokenizers.PATTERN, digests=True),
        "entropy": lambda d: cross_entropy_difference(d, learn_pair(d, labels.where("quality = 1").select("doc_id"))),
        "quality": lambda d: score_quality(d, learn_quality(d, labels, F.lit(True))),
        "shards": byte_shards,
    }


@pytest.mark.parametrize("name", ["bands", "languages", "bpe", "entropy", "quality", "shards"])
def test_one_row_for_each_row(odd, labels, name):
    run = operators(labels)[name]
    got = by_id(run(odd))
    assert sorted((str(k), len(v)) for k, v in got.items()) == sorted((str(k), len(v)) for k, v in by_id(odd).items())
    assert len(set(map(str, [tuple(r) for r in got[6]]))) == (2 if name == "shards" else 1)
    assert run(odd.where("false")).count() == 0


def test_defined_values(odd, labels):
    ops = operators(labels)
    bands = by_id(ops["bands"](odd))
    assert bands[2][0]["n_words"] == 0 and bands[2][0]["base_failed"] and not bands[2][0]["kept"] and bands[1][0]["kept"]
    langs = by_id(ops["languages"](odd))
    assert [langs[i][0]["lang_pred"] for i in (1, 2, 3, 4, 7, 8)] == ["en", "und", "und", "und", "de", "und"]
    bpe = by_id(ops["bpe"](odd))
    assert bpe[2][0]["n_tokens"] == 0 and bpe[2][0]["ids_sha256"] == bpe[3][0]["ids_sha256"]
    entropy = by_id(ops["entropy"](odd))
    assert entropy[3][0]["n_tokens"] == 0 and entropy[2][0]["score"] is None and entropy[1][0]["score"] < entropy[5][0]["score"]
    quality = by_id(ops["quality"](odd))
    assert all(0 <= r["score"] <= 1 for rows in quality.values() for r in rows) and quality[2][0]["score"] == quality[3][0]["score"]


def test_nothing_to_learn_from(odd, labels, spark):
    none = labels.where("false")
    assert {r["score"] for r in score_quality(odd, learn_quality(odd, none, F.lit(True))).collect()} == {0.5}
    assert {r["lang_pred"] for r in identify_languages(odd, learn_languages(odd, F.lit(False))).collect()} == {"und"}
    assert all(r["score"] is None for r in cross_entropy_difference(odd, learn_pair(odd, none.select("doc_id"))).collect())


def test_packing(odd):
    rows = best_fit_packing(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len([r for r in rows if r["doc_id"] == 6]) == 2 and [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert max(r["piece"] for r in rows if r["doc_id"] == 5) > 20
    assert best_fit_packing(odd.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_jaccard(odd):
    got = by_id(jaccard_components(odd))
    assert None not in got and len(got[6]) == 2 and got[6][0]["n_shingles"] == 1
    assert all(got[i][0]["n_shingles"] == 0 and got[i][0]["component_id"] == i for i in (2, 3, 4))
    assert jaccard_components(odd.where("false")).count() == 0


def test_substrings(odd, spark):
    assert repeated_spans(odd).count() == 0 and repeated_spans(odd.where("false")).count() == 0
    same = drop_repeated_spans(odd)
    assert same.columns == odd.columns and sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    twice = odd.unionByName(odd.where("doc_id = 5").withColumn("doc_id", F.lit(50).cast("bigint")))
    assert {r["doc_id"] for r in repeated_spans(twice).collect()} == {5, 50}
    left = by_id(drop_repeated_spans(twice))
    assert left[5][0]["text"] == LONG and left[50][0]["text"] == ""


def test_nearest(spark):
    rows = [(i, [1.0, i / 10, 0.0]) for i in range(6)] + [(6, None), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 2.0]), (9, [float("nan"), 1.0, 1.0]), (10, [1.0]), (None, [1.0, 1.0, 1.0]), (3, [1.0, 0.3, 0.0]), (11, [1.0, 0.5, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, id int, score int")
    got = nearest(df, F.col("vec_id") % 2 == 0, k=20).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 2, 4}
    first = [(r["vec_id"], round(r["score"], 6)) for r in got if r["query_id"] == 4]
    assert first == [(5, 1.2), (11, 1.2), (3, 1.12), (2, 1.08), (1, 1.04), (0, 1.0)]
    assert nearest(df.where("false"), F.lit(True)).count() == 0


def test_registered_names():
    assert [int(n[2:].split("_")[0]) for n in Q.QUERIES] == list(range(1, 11))
