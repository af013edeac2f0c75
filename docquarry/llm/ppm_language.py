"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree with frozen counts. The code length of a byte is that of the longest
context in which the language has seen it, after an escape from every longer context it knows (method C: a context with
n occurrences and q distinct followers escapes with q / (n + q)); a byte never seen costs eight bits after the last
escape. A text belongs to the language that codes it in the fewest bits; lengths are exact sums over the whole text.

All languages share one trie, so a text is walked once: the node of depth d at a position is the child of the node of
depth d - 1 at the position before, one array lookup per order for all positions together. Costs of every node are
computed beforehand for all languages.

Training uses a bounded sample: at most about ``per_language`` documents of each language, drawn by a hash of the id,
each whole. Counting runs on the executors; the driver gets n-gram counts, whose number that bound limits.

Defined results: ``und`` with score 0 where the text is null or has no letter, or if nothing could be learned; rows with
a null language teach nothing; repeated rows are scored one by one; of equal code lengths the first language by name wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, encoded, frugal, hash_fraction, slices_by_bytes

LETTER = regex.compile(r"\p{L}")
PAD = b"\n"


def grams(raws: list[bytes], order: int) -> np.ndarray:
    """The (order + 1)-byte strings that end at each byte of each text, as integers; texts begin after line ends."""
    if not raws:
        return np.empty(0, np.int64)
    data = np.frombuffer(b"".join(PAD * order + r for r in raws), np.uint8).astype(np.int64)
    keys = np.zeros(len(data) - order, np.int64)
    for k in range(order + 1):
        keys = keys << 8 | data[k : k + len(keys)]
    inside = np.ones(len(keys), bool)
    at = -order
    for r in raws:
        inside[max(at, 0) : max(at + order, 0)] = False
        at += order + len(r)
    return keys[inside]


@dataclass
class PPM:
    """Frozen trees. By depth d = 1..order+1: sorted byte strings ``keys[d-1]``, cost of the last byte after the others
    ``cost[d-1]`` and cost of an escape from the string as a context ``escape[d-1]``, both by language."""

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]
    bottom: np.ndarray  # escape from the empty context, then eight bits
    typical: np.ndarray  # bits a byte of each language's own training text

    @classmethod
    def learn(cls, languages: list[str], order: int, key: np.ndarray, language: np.ndarray, count: np.ndarray, least: int = 2) -> PPM:
        """From rows (string of order + 1 bytes, language, count). ``least``: strings of full length seen less often in all
        are left out; shorter ones keep their counts."""
        keys, at = np.unique(key, return_inverse=True)
        size = len(languages)
        n = np.bincount(at * size + language, weights=count, minlength=len(keys) * size).reshape(-1, size)
        often = n.sum(axis=1) >= least
        return cls.learn_sides(languages, order, keys[often], n[often], keys[~often], n[~often])

    @classmethod
    def learn_sides(cls, languages: list[str], order: int, key: np.ndarray, counts: np.ndarray, rest: np.ndarray, rest_counts: np.ndarray) -> PPM:
        """From strings of order + 1 bytes with a column of counts per language. ``rest``: strings, or only their last
        ``order`` bytes, that count for shorter strings alone."""
        size = len(languages)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        longer = np.empty(0, np.int64)
        for depth in range(order + 1, 0, -1):  # a string's context and its shorter form are strings of the trie as well
            mask = (1 << 8 * depth) - 1
            given, n_given = (key, counts) if depth == order + 1 else (np.concatenate([key, rest]), np.concatenate([counts, rest_counts]))
            keys, at = np.unique(np.concatenate([given & mask, longer & mask, longer >> 8]), return_inverse=True)
            at = at[: len(given)]
            n = np.stack([np.bincount(at, weights=n_given[:, k], minlength=len(keys)) for k in range(size)], axis=1)
            seen.insert(0, (keys, n))
            longer = keys
        cost: list[np.ndarray] = []
        escape: list[np.ndarray] = []
        bottom = np.zeros(size)
        with np.errstate(divide="ignore", invalid="ignore"):
            for depth in range(1, order + 2):
                keys, n = seen[depth - 1]
                contexts = seen[depth - 2][0] if depth > 1 else np.zeros(1, np.int64)
                at = np.searchsorted(contexts, keys >> 8) if depth > 1 else np.zeros(len(keys), np.int64)
                total, kinds = (np.zeros((len(contexts), size)) for _ in range(2))
                np.add.at(total, at, n)
                np.add.at(kinds, at, n > 0)
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(n / (total + kinds)[at])
                if depth == 1:
                    bottom = leave[0] + 8.0
                    shorter = np.broadcast_to(bottom - leave[0], n.shape)
                else:
                    escape.append(leave)
                    parent = keys & ((1 << 8 * (depth - 1)) - 1)
                    shorter = cost[depth - 2][np.searchsorted(seen[depth - 2][0], parent)]
                cost.append(np.where(n > 0, own, leave[at] + shorter))
            n = seen[-1][1]
            typical = np.where(n.sum(axis=0) > 0, (n * np.where(n > 0, cost[-1], 0.0)).sum(axis=0) / np.maximum(n.sum(axis=0), 1), 8.0)
        return cls(languages, order, [k for k, _ in seen], cost, escape, bottom, typical)

    def walker(self) -> Walker:
        return Walker(self)


class Walker:
    """Child tables of a PPM, built on the worker that scores: dense by context and symbol where that takes ``dense`` bytes at
    most, else the sorted pairs of both."""

    def __init__(self, model: PPM, dense: int = 64 << 20):
        self.model = model
        self.order = model.order
        used = model.keys[0]
        self.symbol = np.zeros(256, np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.children = []
        for depth, keys in enumerate(model.keys, 1):
            above = model.keys[depth - 2] if depth > 1 else np.zeros(1, np.int64)
            rows = np.searchsorted(above, keys >> 8) + 1 if depth > 1 else np.zeros(len(keys), np.int64)
            if 4 * (len(above) + 1) * self.width <= dense or depth == 1:
                child = np.zeros((len(above) + 1, self.width), np.int32)
                child[rows, self.symbol[keys & 255]] = np.arange(1, len(keys) + 1)
            else:  # nodes are in the order of their strings, and so of these pairs
                child = rows * self.width + self.symbol[keys & 255]
            self.children.append(child)
        zero = np.zeros((1, len(model.languages)))
        self.cost = [np.vstack([zero, c]) for c in model.cost]
        self.escape = [np.vstack([zero, e]) for e in model.escape]

    def child(self, depth: int, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        table = self.children[depth - 1]
        if table.ndim == 2:
            return table[node, symbol]
        pair = node.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(table, pair), len(table) - 1)
        return np.where((table[at] == pair) & (node > 0) & (symbol > 0), at + 1, 0).astype(np.int32)

    def bits(self, raws: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        order = self.order
        data = np.frombuffer(b"".join(PAD * order + r for r in raws), np.uint8)
        sym = self.symbol[data]
        nodes = [self.children[0][0, sym]]
        for depth in range(2, order + 2):
            nodes.append(self.child(depth, np.concatenate([[0], nodes[-1][:-1]]), sym))
        cost = self.cost[-1][nodes[-1]]
        open_ = np.flatnonzero(nodes[-1] == 0)
        open_ = open_[open_ >= order]
        extra = np.zeros((len(open_), cost.shape[1]))
        for depth in range(order, 0, -1):  # nodes of this depth after an escape from the context that long
            extra += self.escape[depth - 1][nodes[depth - 1][open_ - 1]]
            here = nodes[depth - 1][open_]
            hit = here > 0
            cost[open_[hit]] = extra[hit] + self.cost[depth - 1][here[hit]]
            open_, extra = open_[~hit], extra[~hit]
        cost[open_] = extra + self.model.bottom
        sizes = np.array([len(r) for r in raws], np.int64)
        begins = np.cumsum(sizes + order) - sizes
        for k in range(order):
            cost[begins - order + k] = 0.0
        return np.add.reduceat(cost, begins - order, axis=0, dtype=np.float64)


def learn_languages(docs: DataFrame, trains: Column, order: int = 4, per_language: int = 2000, least: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PPM | None:
    """Learn from rows where ``trains`` holds; None if there are none. ``least``: strings of full length seen less often in all
    are left out; shorter ones keep their counts."""
    rows = docs.where(trains & col(docs, lang_col).isNotNull() & col(docs, text_col).isNotNull())
    chosen = rows.select(col(docs, lang_col).alias("lang"), col(docs, text_col).alias("text"), hash_fraction(col(docs, id_col)).alias("draw"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(col(docs, lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return None
    languages = sorted(counts)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / counts[name]))).otherwise(share)

    code = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, group in pdf.groupby("lang"):
                for part in slices_by_bytes(group["text"]):
                    key, n = np.unique(grams([encoded(t.lower()) for t in part], order), return_counts=True)
                    yield pd.DataFrame({"lang": code[name], "key": key, "n": n})

    found = chosen.where(F.col("draw") < share).select("lang", "text").mapInPandas(frugal(count), "lang int, key long, n long")
    sides = [f"n{i}" for i in range(len(languages))]
    sums = cut_lineage(found.groupBy("key").agg(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(sides)]))
    # the sample bounds both; strings seen once only count for shorter ones, which keep their counts
    seen = sum((F.col(c) for c in sides[1:]), F.col(sides[0]))
    key, counts = _fetched(sums.where(seen >= least), sides)
    mask = (1 << 8 * order) - 1
    rest, rest_counts = _fetched(sums.where(seen < least).groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(*[F.sum(c).alias(c) for c in sides]), sides)
    return PPM.learn_sides(languages, order, key, counts, rest, rest_counts)


def _fetched(rows: DataFrame, sides: list[str]) -> tuple[np.ndarray, np.ndarray]:
    table = rows.select("key", *sides).toArrow()
    key = table["key"].to_numpy()
    order = np.argsort(key)
    return key[order], np.stack([table[c].to_numpy()[order] for c in sides], axis=1).astype(np.float64)


def language_udf(docs: DataFrame, model: PPM | None, certain_bytes: int = 50):
    """A column function: text -> (lang_pred, score, bits_per_byte, typical_bits). ``score``: the posterior of the best language
    after ``certain_bytes`` bytes (or the whole text, if shorter) at its mean code lengths; ``typical_bits``: what a byte of
    that language's training text takes. Of languages with equal code lengths the first by name is best."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double, typical_bits double")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        walker = shared.value.walker() if shared.value else None
        for texts in batches:
            out = [("und", 0.0, None, None)] * len(texts)
            known = np.array([walker is not None and t is not None and LETTER.search(t) is not None for t in texts], bool)
            where = np.flatnonzero(known)
            done = 0
            for part in slices_by_bytes(texts[known], 1 << 18):
                raws = [encoded(t.lower()) for t in part]
                bits = walker.bits(raws)
                sizes = np.array([len(r) for r in raws])
                mean = bits / sizes[:, None]
                best = mean.argmin(axis=1)
                gap = (mean - mean.min(axis=1, keepdims=True)) * np.minimum(sizes, certain_bytes)[:, None]
                score = 1.0 / np.exp2(-gap).sum(axis=1)
                for k in range(len(raws)):
                    out[where[done + k]] = (shared.value.languages[best[k]], float(score[k]), float(mean[k, best[k]]), float(shared.value.typical[best[k]]))
                done += len(raws)
            yield pd.DataFrame(out, columns=["lang_pred", "score", "bits_per_byte", "typical_bits"])

    return run


def identify_languages(docs: DataFrame, model: PPM | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, bits_per_byte, typical_bits."""
    return docs.select(col(docs, id_col).alias("doc_id"), language_udf(docs, model)(col(docs, text_col)).alias("v")).select("doc_id", "v.*")
