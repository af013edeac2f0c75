"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pending merges wait in one bucket per merge rank; a bucket holds positions of a linked list of tokens. A three-level
bitmap over the ranks tells which buckets have entries, so that find-first-set picks the next rank in a few steps
however many ranks exist. Entries that a later merge has made invalid stay in their bucket and are skipped when it is
opened. All pre-tokens of a slice share one list (with barriers) and one queue, and a bucket is worked off at once with
array operations, so a pre-token of a million bytes costs as much as a million bytes of short ones.

Order: the lowest rank goes first and, within a rank, the leftmost pair. Working off a whole bucket keeps that order
except where a merge of rank r makes a pair of a still lower rank beside it. For the ranks where the vocabulary allows
that, pairs so near that such merges could reach the next one wait: only the first of a run is merged at a time.

Defined results: a null text encodes as the empty text (no ids); every row is encoded by itself, whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Finder, col, newer_characters, slices_by_bytes


class RankBitmap:
    """A set of small integers as three levels of 64-bit words."""

    def __init__(self, size: int):
        self.leaf = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.leaf[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def discard(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.leaf[a] &= ~(1 << (rank & 63))
        if not self.leaf[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)

    def first(self) -> int:
        """The smallest member; -1 if empty."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) + (m & -m).bit_length() - 1
        x = self.leaf[a]
        return (a << 6) + (x & -x).bit_length() - 1


class MergeTable:
    """Rank of the token that two neighbouring tokens make, by binary search over all splits of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.values = np.array(values, np.int64)[order]
        #: For a token that a token of lower rank contains: the greatest length of those. A merge that makes the former can
        #: be followed by merges of lower rank that grow the token up to this length, and no further.
        self.reach: dict[int, int] = {}
        for token, rank in ranks.items():
            n = len(token)
            for size in range(2, n):
                for at in range(n - size + 1):
                    inner = ranks.get(token[at : at + size], -1)
                    if inner > rank and self.reach.get(inner, 0) < n:
                        self.reach[inner] = n

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the two don't merge."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


class ByteBPE:
    """Encoder and decoder for one vocabulary of byte strings and ranks, as the tiktoken library uses it."""

    #: Longer units aren't kept: a text without blanks is one unit.
    LONGEST = 64

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 300_000):
        self.ranks, self.pattern, self.cache_size = ranks, regex.compile(pattern), cache_size
        self.has_newer, self.newer = Finder(newer_characters()), regex.compile(f"[{newer_characters()}]")
        self.tokens = {r: t for t, r in ranks.items()}
        self.table = MergeTable(ranks)
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pair = np.arange(65536)
        self.first_pairs = self.table.find(self.single[pair >> 8], self.single[pair & 255])
        self.top_rank = max(ranks.values()) + 1
        self.cache: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str, **more) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern, **more)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces are merged apart from each other."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return [np.empty(0, np.uint32) for _ in pieces]
        ends = np.cumsum(sizes)
        token = self.single[data]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        starts = (ends - sizes)[sizes > 0]
        after[ends[sizes > 0] - 1] = n  # n and -1: no neighbour
        before[starts] = -1
        wait = np.full(n, -1, np.int64)  # rank of the pair that begins at a position; -1: none
        inner = np.flatnonzero(after < n)
        wait[inner] = self.first_pairs[data[inner].astype(np.int64) << 8 | data[inner + 1]]

        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap(self.top_rank)

        def push(at: np.ndarray) -> None:
            at = at[wait[at] >= 0]
            if not len(at):
                return
            order = np.argsort(wait[at], kind="stable")
            at = at[order]
            rank = wait[at]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cuts), rank[np.concatenate([[0], cuts])].tolist(), strict=True):
                buckets.setdefault(r, []).append(part)
                queue.add(r)

        push(inner)
        alive = np.ones(n, bool)
        while (rank := queue.first()) >= 0:
            queue.discard(rank)
            parts = buckets.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[wait[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                reach = self.table.reach.get(rank, 0)
                touches = at[1:] - at[:-1] <= reach if reach else at[1:] == after[at[:-1]]
                if touches.any():
                    index = np.arange(len(at))
                    begins = np.concatenate([[True], ~touches])
                    since = index - np.maximum.accumulate(np.where(begins, index, 0))
                    if reach:
                        push(at[since > 0])
                        at = at[since == 0]
                    else:
                        at = at[since % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            token[at] = rank
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            wait[gone] = -1
            alive[gone] = False
            left = before[at]
            near = np.concatenate([at, left[left >= 0]])
            if len(near) > 1:
                near = np.unique(near)
            right = after[near]
            joined = right < n
            wait[near[~joined]] = -1
            near, right = near[joined], right[joined]
            wait[near] = self.table.find(token[near], token[right])
            push(near)
        kept = token[alive].astype("<u4")
        counts = np.add.reduceat(alive, starts).astype(np.int64) if len(starts) else np.empty(0, np.int64)
        out = np.zeros(len(pieces), np.int64)
        out[sizes > 0] = counts
        return np.split(kept, np.cumsum(out)[:-1])

    def units(self, text: str) -> list[str]:
        """The text in units that the pattern matches apart from each other: white space and what follows it. The
        quick way holds where every blank stands alone between other characters; else the pattern's own matches."""
        parts = text.split(" ")
        if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
            return parts[:1] + [" " + p for p in parts[1:]]
        return self.matches(text)

    def matches(self, text: str) -> list[str]:
        """The pattern's matches, one after the other. Characters newer than the libraries count as unassigned."""
        if not self.has_newer(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.newer.sub("\u0378", text))]

    def encode_slice(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.units(t) for t in texts]
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        cache = self.cache
        new = list(set().union(*split) - cache.keys())
        matches = [self.matches(u) for u in new]
        whole = [[p.encode("utf-8", "surrogatepass") for p in m] for m in matches]
        todo = list({p for m in whole for p in m if p not in self.ranks})
        ids = dict(zip(todo, (a.tobytes() for a in self.merge(todo)), strict=True))
        for unit, m in zip(new, whole, strict=True):
            cache[unit] = b"".join(ids[p] if p in ids else self.ranks[p].to_bytes(4, "little") for p in m)
        out = [b"".join(map(cache.__getitem__, u)) for u in split]
        for unit in new:
            if len(unit) > self.LONGEST:
                del cache[unit]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_slice([text])[0], "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe_codec(make):
    """A column function: text -> (n_tokens, ids as bytes, decoded bytes). ``make``: builds the ByteBPE on a worker."""

    @F.pandas_udf("n_tokens long, ids binary, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = make()
        for texts in batches:
            out = []
            for part in slices_by_bytes(texts):
                for ids in codec.encode_slice(["" if t is None else t for t in part]):
                    out.append((len(ids) // 4, ids, codec.decode(ids)))
            yield pd.DataFrame(out, columns=["n_tokens", "ids", "decoded"])

    return run


def bpe_digests(make):
    """As ``bpe_codec``, with SHA-256 digests in place of ids and bytes, so that they needn't leave the worker."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = make()
        for texts in batches:
            out = []
            for part in slices_by_bytes(texts):
                for ids in codec.encode_slice(["" if t is None else t for t in part]):
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _maker(path: str, pattern: str):
    def make() -> ByteBPE:
        return ByteBPE.from_file(path, pattern)

    return make


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens and ids / decoded (or their SHA-256 digests). ``path``: the rank file,
    which every worker can open."""
    run = (bpe_digests if digests else bpe_codec)(_maker(path, pattern))
    return docs.select(col(docs, id_col).alias("doc_id"), run(col(docs, text_col)).alias("v")).select("doc_id", "v.*")
