"""The pipeline as a whole against a plain version of each stage, and its stages on odd and empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from test_documents import WORDS, brute_components
from test_edge_cases import SCHEMA, TEXTS
from tokenizers import Tokenizer

import corpus_pipeline as P
import public_tokenizers
from docquarry.llm.gam_quality import features, fit
from docquarry.llm.substring_dedup import Chunking, gear_table

ORDER = 4
BLANK = b" \t\n\r\x0b\x0c"
NORTH = "der die das und nicht mit auf eine schnelle fuchs wald berg haus fluss stern nacht kalt warm lang kurz".split()


def crc(i):
    return zlib.crc32(str(i).encode())


def corpus():
    rng = random.Random(13)
    shared = " ".join(rng.choices(WORDS, k=70))
    rows = []
    for i in range(90):
        words = WORDS if i % 2 else NORTH
        text = " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randrange(60, 160)))
        if i % 9 == 4:
            text = text + " " + shared + " " + " ".join(rng.choices(words, k=30))
        if i % 10 == 5:
            text = rows[-2][1] + " nachsatz"
        if i % 10 == 7:
            text = "#$% click <> " * rng.randrange(20, 60)
        rows.append((i, text, "en" if i % 2 else "de", "web", len(text)))
    rows += [(90, "Это предложение написано совсем на другом языке и стоит много битов", None, "web", 60), (91, "12345 678", "en", "web", 9), (92, None, "en", "web", 0), (93, "", "de", "web", 0)]
    return rows, [(i, int(i % 10 != 7), 0) for i in range(90)]


def language_models(rows):
    """Per language: strings of five bytes with counts, and followers by context. Strings seen once in all don't count at full
    length."""
    by, full = {}, Counter()
    for i, t, lang, *_ in rows:
        if crc(i) % 3 != 1 and lang is not None and t is not None:
            s = b"\n" * ORDER + t.lower().encode()
            found = [s[k - ORDER : k + 1] for k in range(ORDER, len(s))]
            by.setdefault(lang, Counter()).update(found)
            full.update(found)
    trees = {}
    for lang, grams in by.items():
        trees[lang] = [{} for _ in range(ORDER + 1)]
        for g, n in grams.items():
            for k in range(ORDER + (full[g] >= 2)):
                trees[lang][k].setdefault(g[ORDER - k : ORDER], Counter())[g[-1]] += n
    return trees, by


def cost(tree, gram):
    """Bits of the last byte after the others."""
    total = 0.0
    for k in range(ORDER, -1, -1):
        seen = tree[k].get(gram[ORDER - k : ORDER])
        if seen is None:
            continue
        n, q = sum(seen.values()), len(seen)
        if gram[-1] in seen:
            return total - np.log2(seen[gram[-1]] / (n + q))
        total -= np.log2(q / (n + q))
    return total + 8


def plain_chunks(raw, rules):
    table, h, last, ends = gear_table(rules.seed), 0, 0, []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(table[b])) & 0xFFFF
        inside = i + 1 < len(raw) and raw[i + 1] & 0xC0 == 0x80
        if i + 1 - last >= rules.least and (h >> (16 - rules.zero_bits) == 0 and not inside or i + 1 - last == rules.most):
            ends.append(i + 1)
            last = i + 1
    if raw and (not ends or ends[-1] != len(raw)):
        ends.append(len(raw))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def words_begun(raw, a, b):
    return sum(raw[k] not in BLANK and (k == 0 or raw[k - 1] in BLANK) for k in range(a, b))


def without_repeats(texts, rules=Chunking()):
    raws = {i: t.encode() for i, t in texts.items()}
    chunks = {i: plain_chunks(raw, rules) for i, raw in raws.items()}
    holders = {}
    for i, some in chunks.items():
        for a, b in some:
            holders.setdefault(raws[i][a:b], set()).add(i)
    out = {}
    for i, raw in raws.items():
        runs = [[]]
        for a, b in chunks[i]:
            if len(holders[raw[a:b]]) > 1:
                runs[-1].append((a, b))
            else:
                runs.append([])
        gone = set()
        for run in runs:
            if run and (words_begun(raw, run[0][0], run[-1][1]) >= rules.least_words or run[-1][1] - run[0][0] >= rules.least_bytes):
                for a, b in run:
                    if min(holders[raw[a:b]]) < i:
                        gone.update(range(a, b))
        out[i] = bytes(x for k, x in enumerate(raw) if k not in gone).decode()
    return out


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    packer = zstandard.ZstdCompressor(level=1)
    x = {i: features(t, packer) for i, t, *_ in rows}
    train = sorted((tuple(x[i]), y) for i, y, _ in labels if crc(i) % 5 != 0)
    model = fit(np.array([f for f, _ in train]), np.array([y for _, y in train], float))
    good = [r for r in rows if model.score(np.array([x[r[0]]]))[0] >= P.LEAST_QUALITY]
    assert 50 < len(good) < len(rows)

    trees, by = language_models(good)
    typical = {lang: sum(n * cost(trees[lang], g) for g, n in grams.items() if g[-1] in trees[lang][ORDER].get(g[:ORDER], ())) / sum(n for g, n in grams.items() if g[-1] in trees[lang][ORDER].get(g[:ORDER], ())) for lang, grams in by.items()}
    known = {}
    for i, t, *_ in good:
        if t is None or not any(c.isalpha() for c in t):
            continue
        raw = t.lower().encode()
        s = b"\n" * ORDER + raw
        mean = {lang: sum(cost(trees[lang], s[k - ORDER : k + 1]) for k in range(ORDER, len(s))) / len(raw) for lang in sorted(trees)}
        best = min(mean, key=mean.get)
        sure = 1 / sum(2 ** -((m - mean[best]) * min(len(raw), 50)) for m in mean.values())
        if sure >= P.LEAST_CERTAINTY and (mean[best] - P.FOREIGN * typical[best]) * len(t.encode()) <= P.FOREIGN_BITS:
            known[i] = t
    assert 90 not in known and 91 not in known and len(known) > 50

    single = {c: known[c] for _, c in brute_components(list(known.items()), 5, 80).values()}
    assert len(single) < len(known)
    cut = without_repeats(single)
    assert sum(cut[i] != single[i] for i in cut) >= 3

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in cut.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_and_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.createDataFrame([(i, t, None if i == 3 else "en", "s", len(t or ""), *[None] * 13) for i, t in TEXTS], SCHEMA)
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, str(tmp_path))
    rows = out.collect()
    ids, all_ids = Counter(r["doc_id"] for r in rows), Counter(i for i, _ in TEXTS)
    if name != "packing":
        assert out.columns == odd.columns and all(n <= all_ids[i] for i, n in ids.items()) and ids[1] == 1
    if name == "near_duplicates":
        assert ids[6] == 1 and ids[None] == 2 and {2, 3, 4, 5, 7} <= set(ids)
    if name == "repeated_passages":
        assert sorted(str(r["text"]) for r in rows) == sorted(str(t) for _, t in TEXTS)
    if name == "packing":
        assert set(ids) == set(all_ids)
    empty = stage(spark, odd.where("false"), str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns
