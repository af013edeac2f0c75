"""Registered queries against plain versions on whole small tables, and bounds of what workers hold."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import public_tokenizers
from docquarry.llm import queries as Q
from docquarry.llm.byte_bpe import ByteBPE
from docquarry.llm.packing import best_fit_packing
from docquarry.llm.ppm_language import PPM, Walker, grams
from docquarry.llm.word_tokens import WordTokens

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@needs_tables
def test_base_counts(spark, texts):
    rows = Q.op1_compression_bands(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n) and not (r["base_failed"] and r["kept"])


@needs_tables
def test_digests_are_those_of_the_library(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = Q.op4_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


@needs_tables
def test_pieces_cover_every_document(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = Q.op8_best_fit_packing(spark, SF).collect()
    want, held = set(), {}
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["one", "two", "three"], k=rng.choice([3, 3, 3, 40, 700])))) for i in range(60)]
    path = public_tokenizers.path("word_bpe_49k.json")
    some = [{tuple(r) for r in best_fit_packing(spark.createDataFrame(x, "doc_id bigint, text string").coalesce(1), path).collect()} for x in (rows, rows[::-1])]
    assert some[0] == some[1]


def test_long_words_leave_the_caches():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh", k=5000)) + f" und das {i}" for i in range(30)]
    bpe = ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    words = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    for codec in (bpe, words):
        first = codec.encode_slice(texts)
        assert max(map(len, codec.cache)) <= codec.LONGEST and codec.encode_slice(texts) == first


def test_sorted_child_tables_give_the_same_bits():
    rng = random.Random(5)
    raws = [bytes(rng.choices(b"abcdef ", k=300)) for _ in range(6)]
    key, n = np.unique(grams(raws, 4), return_counts=True)
    model = PPM.learn(["x"], 4, key, np.zeros(len(key), np.int64), n.astype(float))
    texts = [*raws[:2], b"abc xyz", b"f"]
    assert np.array_equal(Walker(model).bits(texts), Walker(model, dense=0).bits(texts))
