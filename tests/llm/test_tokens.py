"""Byte-level BPE and packing against the public libraries and brute force."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from docquarry.llm.byte_bpe import ByteBPE, RankBitmap
from docquarry.llm.packing import pack, sum_of_squares
from docquarry.llm.word_tokens import WordTokens

BPE = ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
WORDS = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY.encode_special_tokens = True

MIXED = st.text(st.one_of(st.sampled_from(list("abcdeABÄéß .,!?'\n\t 0123日本語😀ΣσİÅ")), st.characters(codec="utf-8", exclude_categories=["Cs"])), max_size=200)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_bpe_is_tiktoken(text):
    ids = BPE.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert BPE.decode(np.array(ids, "<u4").tobytes()) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 3000, "the" * 2000, "".join(random.Random(1).choices("abcdefgh", k=20_000)), "é" * 999, "0" * 777])
def test_very_long_pre_tokens(piece):
    assert BPE.encode(piece) == TIKTOKEN.encode_ordinary(piece)


def naive(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        found = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.randoms(use_true_random=False), st.lists(st.text("abc", max_size=40), max_size=5))
def test_any_vocabulary_keeps_the_order_of_merges(rng, texts):
    """Ranks in no order of training, where merges make pairs of lower rank."""
    tokens = {bytes([b]) for b in range(256)} | {"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(40)}
    listed = sorted(tokens)
    rng.shuffle(listed)
    ranks = {t: i for i, t in enumerate(listed)}
    codec = ByteBPE(ranks, r"\S+|\s+")
    for text, got in zip(texts, codec.merge([t.encode() for t in texts]) if texts else [], strict=True):
        assert got.tolist() == naive(ranks, text.encode())


def test_rank_bitmap():
    bits, held, rng = RankBitmap(50_000), set(), random.Random(2)
    for _ in range(5000):
        r = rng.randrange(50_000)
        if r in held and rng.random() < 0.7:
            bits.discard(r)
            held.discard(r)
        else:
            bits.add(r)
            held.add(r)
        assert bits.first() == min(held, default=-1)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_word_tokens_are_the_library_s(text):
    got = np.frombuffer(WORDS.encode_slice([text])[0], "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def brute_pack(lengths, capacity):
    """The rule as it reads: try every place, take the one with the smallest sum of squares, of equal ones the tightest."""
    fill, places = [], []
    for size in lengths:
        def cost(fills):
            gaps = [capacity - f for f in fills if f < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = []
        for gap in {capacity - f for f in fill if f + size <= capacity}:
            i = next(k for k in range(len(fill)) if capacity - fill[k] == gap)
            options.append((cost(fill[:i] + [fill[i] + size] + fill[i + 1 :]), gap))
        options.append((cost([*fill, size]), capacity))
        gap = min(options)[1]
        places.append(gap)
        if gap == capacity:
            fill.append(size)
        else:
            fill[next(k for k in range(len(fill)) if capacity - fill[k] == gap)] += size
    return places, len(fill)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_rule(lengths):
    bins, offsets, used = sum_of_squares(np.array(lengths, np.int64), 12)
    places, expected = brute_pack(lengths, 12)
    assert used == expected and [12 - o for o in offsets.tolist()] == places
    for order in (bins, pack(np.array(lengths, np.int64), 12)[0]):
        assert not lengths or np.bincount(order, weights=lengths).max() <= 12


def test_packing_wastes_little():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6.5, 1, 5000).astype(np.int64) + 1)
    assert pack(lengths, 2048)[2] <= 1.02 * -(-lengths.sum() // 2048)


@pytest.mark.parametrize("text", ["hello <|endoftext|> you", "a<|startoftext|>b <|endoftext|>", "<|endoftext|>", "hello <|ENDOFTEXT|> you", "no < |endoftext|> here"])
def test_added_tokens_are_those_of_the_plain_call(text):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [np.frombuffer(x, "<u4").tolist() for x in WORDS.encode_slice([text, "hello you"])]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in (text, "hello you")]
