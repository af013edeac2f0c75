"""Document operators against brute-force versions, and held-out accuracy, on the small tables."""

import itertools
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.llm import queries as Q
from docquarry.llm.components import connected_components
from docquarry.llm.compression_bands import repeated_window_words
from docquarry.llm.cross_entropy import learn_pair
from docquarry.llm.gam_quality import fit
from docquarry.llm.jaccard_join import Bands, JoinRules, bitmap, folded, jaccard_components, shingles, signatures
from docquarry.llm.nn_descent import GraphRules, nearest
from docquarry.llm.ppm_language import PPM, grams
from docquarry.llm.substring_dedup import Chunking, cuts, drop_repeated_spans, repeated_spans

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


# Compression bands


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_windows(words):
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    assert repeated_window_words(words) == len(covered)


@pytest.mark.parametrize("tail", [b"\0" * 1900, random.Random(2).randbytes(1900)])
def test_the_end_of_a_text_is_judged(tail):
    import zstandard

    from docquarry.llm.compression_bands import BandRules, ratios

    rules = BandRules()
    text = prose(random.Random(3), 2000).encode()
    head = text[: rules.chunk_bytes]
    packer = zstandard.ZstdCompressor(level=rules.level)
    assert ratios(head + text[rules.chunk_bytes :][:1900], rules, packer)[1:] == (2, 0)
    assert ratios(head + tail, rules, packer)[1:] == (2, 1)


@needs_tables
def test_bands_keep_clean_text(spark):
    kept = Q.op1_compression_bands(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("n_words >= 20")
    rates = {r["quality"]: r["rate"] for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] == 1.0 and rates[0] < 0.6


# Languages


def test_code_lengths_are_exact():
    rng = random.Random(0)
    texts = {"x": [bytes(rng.choices(b"abcd ", k=200)) for _ in range(5)], "y": [bytes(rng.choices(b"cdef ", k=200)) for _ in range(5)]}
    order, rows = 3, []
    for i, some in enumerate(texts.values()):
        key, n = np.unique(grams(some, order), return_counts=True)
        rows.append((key, np.full(len(key), i), n.astype(float)))
    model = PPM.learn(["x", "y"], order, *[np.concatenate(c) for c in zip(*rows, strict=True)], least=1)
    for text in (b"abc cde fff", b"", b"zz~a", b"a" * 50):
        if text:
            got = model.walker().bits([b"ab", text])[1]
            assert got == pytest.approx([brute_bits(some, text, order) for some in texts.values()], rel=1e-5)


def brute_bits(train, text, order):
    trees = [{} for _ in range(order + 1)]
    for t in train:
        s = b"\n" * order + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                trees[k].setdefault(s[i - k : i], Counter())[s[i]] += 1
    s, total = b"\n" * order + text, 0.0
    for i in range(order, len(s)):
        for k in range(order, -1, -1):
            seen = trees[k].get(s[i - k : i])
            if seen is None:
                continue
            n, q = sum(seen.values()), len(seen)
            if s[i] in seen:
                total -= math.log2(seen[s[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


@needs_tables
def test_language_accuracy(spark):
    got = Q.op2_ppm_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).collect()[0]
    assert r["a"] > 0.97 and r["n"] > 200


# Quality


@needs_tables
def test_quality_accuracy(spark):
    rows = Q.op7_gam_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 30
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_model_is_additive_and_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x, y, rounds=20)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert np.mean((model.score(x) > 0.5) == (y > 0.5)) > 0.9
    one = x[:1]
    total = model.intercept + sum(t[np.searchsorted(e, one[0, f])] for f, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    total += sum(t[model.coarse[f][np.searchsorted(model.edges[f], one[0, f])], model.coarse[g][np.searchsorted(model.edges[g], one[0, g])]] for f, g, t in model.pairs)
    assert model.logit(one)[0] == pytest.approx(total)


# Cross-entropy difference


def test_target_text_scores_lower(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abc ", k=400)) if i % 4 == 0 else "".join(rng.choices("cdefgh ", k=400))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    from docquarry.llm.cross_entropy import cross_entropy_difference

    model = learn_pair(docs, docs.where("doc_id % 4 = 0 and doc_id < 60").select("doc_id"), order=2)
    got = {r["doc_id"]: r["score"] for r in cross_entropy_difference(docs, model).collect()}
    assert max(got[i] for i in range(60, 80, 4)) < min(got[i] for i in range(61, 80, 4))


def test_pruned_strings_still_count_for_shorter_ones(spark):
    docs = spark.createDataFrame([(1, "abcabcabcabd"), (2, "xyzxyz")], "doc_id bigint, text string")
    full, small = (learn_pair(docs, docs.where("doc_id = 1").select("doc_id"), order=2, max_grams=m) for m in (1000, 4))
    assert len(small.keys[2]) < len(full.keys[2])
    assert np.allclose(small.cost[0][np.isin(small.keys[0], full.keys[0])], full.cost[0][np.isin(full.keys[0], small.keys[0])])


def test_background_is_every_document(spark):
    from docquarry.llm.cross_entropy import cross_entropy_difference

    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcd ", k=60)) + f" {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in cross_entropy_difference(docs, learn_pair(docs, docs.where("doc_id < 3").select("doc_id"), order=2)).collect()}
    raws = [t.encode() for _, t in rows]
    for i in (0, 1, 30, 59):
        assert got[i]["background_loss"] * len(raws[i]) == pytest.approx(brute_bits(raws, raws[i], 2), rel=1e-5)
        assert got[i]["target_loss"] * len(raws[i]) == pytest.approx(brute_bits(raws[:3], raws[i], 2), rel=1e-5)


def test_no_string_is_cut_from_the_model(spark):
    from docquarry.llm.cross_entropy import cross_entropy_difference

    rng = random.Random(9)
    letters = [chr(c) for c in range(33, 127)]
    rows = [(i, "".join(rng.choices(letters, k=9000))) for i in range(70)]  # about 630,000 distinct strings of five bytes
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    model = learn_pair(docs, docs.where("doc_id < 35").select("doc_id"))
    fresh = spark.createDataFrame([(100, "abc abc unseen \u00e9"), (101, ""), (None, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in cross_entropy_difference(docs.where("doc_id in (3, 60)").union(fresh), model).collect()}
    raws = [t.encode() for _, t in rows]
    key, n = np.unique(grams(raws, 4), return_counts=True)
    target, m = np.unique(grams(raws[:35], 4), return_counts=True)
    assert len(key) > 500_000
    both = np.stack([np.zeros(len(key)), n], axis=1)
    both[np.searchsorted(key, target), 0] = m
    whole = PPM.learn_sides(["target", "background"], 4, key, both, key[:0], both[:0])
    texts = {3: raws[3], 60: raws[60], 100: "abc abc unseen \u00e9".encode()}
    want = whole.walker().bits(list(texts.values()))
    for (i, raw), bits in zip(texts.items(), want, strict=True):
        assert got[i]["n_tokens"] == len(raw)
        assert [got[i]["target_loss"] * len(raw), got[i]["background_loss"] * len(raw)] == pytest.approx(bits, rel=1e-4)
    assert all((got[i]["n_tokens"], got[i]["score"], got[i]["target_loss"]) == (0, None, None) for i in (101, None))


# Substrings


def test_chunks_follow_the_content():
    rng = random.Random(7)
    text = prose(rng, 2000).encode()
    chunks = lambda b: [b[x:y] for e in cuts([b], Chunking()) for x, y in zip([0, *e], e, strict=False)]
    a, b = chunks(text), chunks(text[:5000] + b" inserted words " + text[5000:])
    assert b"".join(a) == text and len(set(a) - set(b)) < 12
    sizes = [len(c) for c in a[:-1]]
    assert min(sizes) >= 16 and max(sizes) <= 160
    for raw in ("é" * 3000, "日" * 500):
        assert all(c.decode() for c in chunks(raw.encode()))


def brute_gear(raw, rules):
    from docquarry.llm.substring_dedup import gear_table

    table, h, last, ends = gear_table(rules.seed), 0, 0, []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(table[b])) & 0xFFFF
        if i + 1 - last >= rules.least and (h >> (16 - rules.zero_bits) == 0 or i + 1 - last == rules.most):
            ends.append(i + 1)
            last = i + 1
    return ends if ends and ends[-1] == len(raw) else [*ends, len(raw)] if raw else []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=2000).map(lambda b: bytes(x & 127 for x in b)), max_size=4))
def test_cuts_are_those_of_a_rolling_hash(raws):
    assert cuts(raws, Chunking()) == [brute_gear(r, Chunking()) for r in raws]


def test_planted_passages_are_found_and_clean_text_left_alone(spark):
    rng = random.Random(11)
    passages = [prose(rng, 55) for _ in range(10)]
    rows, planted = [], set()
    for i in range(120):
        text = prose(rng, 300)
        if i % 4 == 0:
            at = rng.randrange(len(text))
            text, _ = text[:at] + " " + passages[i // 4 % 10] + " " + text[at:], planted.add(i)
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = repeated_spans(docs).collect()
    assert {r["doc_id"] for r in spans} == planted
    assert all(r["first_doc_id"] == r["doc_id"] % 40 for r in spans)
    left = {r["doc_id"]: r["text"] for r in drop_repeated_spans(docs).collect()}
    assert all(left[i] == t for i, t in rows if i not in planted or i < 40)
    assert all(len(left[i]) < len(t) - 150 for i, t in rows if i in planted and i >= 40)


# Jaccard join


def linked(x, y, percent=85):
    return bool(x and y) and 100 * len(x & y) >= percent * len(x | y)


def brute_sets(text, width=4):
    w = (text or "").encode().lower().split()
    return ({tuple(w)} if w and len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}) if w else set()


def brute_components(rows, width=4, percent=85):
    sets = {i: brute_sets(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if linked(sets[a], sets[b], percent):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(rng, n):
    rows, i = [], 0
    while i < n:
        base = prose(rng, rng.choice([3, 5, 8, 12, 40, 150, 400])).split()
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                k = rng.randrange(len(words))
                rng.choice([lambda: words.insert(k, "new"), lambda: words.__setitem__(k, "other"), lambda: len(words) > 1 and words.pop(k)])()
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
            i += 1
    return rows


@pytest.mark.parametrize("cell", [1024, 4])
def test_join_is_exact(spark, cell):
    rows = near_copies(random.Random(cell), 400)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, JoinRules(cell_docs=cell)).collect()}
    assert got == brute_components(rows)
    assert sum(v[1] != k for k, v in got.items()) > 50


def test_join_is_exact_with_hot_signatures(spark):
    """Signatures of more than three classes go by class, not by bucket."""
    rows = near_copies(random.Random(2), 250)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, JoinRules(bucket=3, cell_docs=8)).collect()}
    assert got == brute_components(rows)


def test_unrelated_sets_share_no_signature():
    rng = np.random.default_rng(6)
    rules = JoinRules()
    bands = Bands(rules)
    for size in (20, 100, 320, 800, 1100, 1600, 3000):
        sets = [np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1)) for _ in range(150)]
        got = Counter(x for s in sets for x in signatures(s, bands, rules).tolist())
        assert sum(n > 1 for n in got.values()) <= 1


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1 << 30), st.data())
def test_linked_sets_share_a_signature(size, seed, data):
    rng = np.random.default_rng(seed)
    rules = JoinRules()
    base = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
    x = np.unique(base[:size])
    gone, new = data.draw(st.integers(0, size // 6 + 1)), data.draw(st.integers(0, size // 6 + 1))
    y = np.unique(np.concatenate([x[min(gone, size - 1) :], base[size : size + new]]))
    if linked(set(x.tolist()), set(y.tolist())):
        bands = Bands(rules)
        assert set(signatures(x, bands, rules).tolist()) & set(signatures(y, bands, rules).tolist())
    a, b = bitmap(x, 64), bitmap(y, 64)
    n = min(len(a), len(b))
    assert np.bitwise_count(folded(a, n) ^ folded(b, n)).sum() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_shingle_counts():
    for text in (None, "", "a b", "a b c d", "A b c d a B c d", "x " * 9):
        assert len(shingles(text, 4)) == len(brute_sets(text))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Nearest neighbours


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:720] = x[3]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = nearest(docs, F.col("vec_id") % 20 == 0, 20, GraphRules(block=300, index_block=256, rounds=6, beam=120)).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
    hits = []
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20].tolist()
        ids = [v for _, v in sorted(found[q])]
        assert len(ids) == 20 and len(set(ids)) == 20
        hits.append(len(set(ids) & set(best)) / 20)
    assert np.mean(hits) > 0.9


def exact_neighbours(x, q, k=20):
    s = x @ x[q]
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k].tolist()


def recall(spark, x, every, rules=GraphRules()):
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in nearest(docs, F.col("vec_id") % every == 0, 20, rules).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sorted(found) == list(range(0, len(x), every))
    return np.mean([len(found[q] & set(exact_neighbours(x, q))) / 20 for q in found])


def test_rounds_run_on_small_tables_too(spark, monkeypatch):
    from docquarry.llm import nn_descent as N

    calls = []
    real = N._offers
    monkeypatch.setattr(N, "_offers", lambda *a: calls.append(1) or real(*a))
    x = np.random.default_rng(1).normal(size=(500, 32))
    assert recall(spark, x, 20) > 0.98 and len(calls) >= 2


def test_one_long_vector_changes_nothing_for_the_others(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1e7
    assert recall(spark, x, 40, GraphRules(block=128)) > 0.95


def test_rows_of_one_id(spark):
    rows = [(i, [1.0, float(i)]) for i in range(40)] + [(3, [5.0, 5.0]), (3, [2.0, 9.0])]
    runs = [{tuple(r) for r in nearest(spark.createDataFrame(some, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()} for some in (rows, rows[::-1])]
    assert runs[0] == runs[1]


def test_rounds_move_little(spark):
    """Bytes shuffled a vector, which decide the time of large tables."""
    x = np.random.default_rng(4).normal(size=(3000, 32))

    def moved():
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = moved()
    assert recall(spark, x, 20) > 0.95
    assert moved() - before < 20_000 * len(x)


# Sharding


@needs_tables
def test_shards(spark):
    rows = Q.op10_byte_shards(spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(text)
    total = sum(len(t.encode()) + 1 for t in text.values())
    sizes, slots, at = Counter(), {}, 0
    for r in sorted(rows, key=lambda r: (r["text_crc32"], r["size"], r["doc_id"])):
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert r["shard"] == (2 * at + r["size"]) * 16 // (2 * total)
        at += r["size"]
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


# Pipeline


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, known, single, cut = kept
    assert all(i in good for i in before if labels.get(i) == 1) and sum(i not in good for i in before if labels.get(i) == 0) >= 50
    assert set(known) <= set(good) and len(known) >= 0.99 * len(good)
    components = brute_components(list(known.items()), 5, 80)  # near-duplicate stages take five words and 80 percent
    assert set(single) == {c for _, c in components.values()}
    assert set(cut) == set(single) and all(len(cut[i]) <= len(single[i]) for i in cut) and sum(cut[i] != single[i] for i in cut) > 10
    packed = P.packing(spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(cut)
