"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, sorted-array intersection.

Two documents link when ``100 * |x & y| >= threshold * |x | y|`` for their sets of shingles (64-bit hashes).

1. One pass over the texts gives each document's set size, digest and bitmap, and the signatures of step 2. Documents with
   the same set form one class; its smallest id stands for it from here on.
2. Candidates, without loss: sizes fall into bands, and a band cuts the hash space into segments. A set whose linked
   partners differ from it in at most d shingles sends the signatures (band, segment, hash of the shingles in it) of its
   first d + 1 segments that aren't empty, to its own band and to the next if a partner may be there. Of two linked sets,
   take the first segment that both fill alike: each segment before it that one of them fills holds one of the at most d
   differences, so both send its signature. A band has so many segments that a set fills fewer than d + 1 of them once in
   100,000 times; such a set sends the signatures of all segments, the empty ones too.
3. Signatures go to buckets in blobs of twelve bytes each (six of the signature, six of the class); a task sends each once.
   A bucket keeps those that two classes or more share; buckets are as many as the counted signatures need. A signature with
   more classes than a bucket should hold is known from the tasks' counts and goes by class, not by bucket. Truncation adds
   candidates, never loses one.
4. The classes that share a signature are compared by their bitmaps, and those that pass the overlap bound below are
   chained; components of the chains are families. Families are then compared exactly, text by text. Both happen in tiles:
   a small group is one tile; a large one is dealt into cells by size band and hash, and a tile holds two cells of the
   same or neighbouring bands, so that no task sees more than two cells. In a tile, pairs of one component are skipped;
   for others, the differing bits of their parity bitmaps bound the overlap from above, and pairs that pass are
   intersected exactly.
5. Components of the links, over classes, give the result. A family of one tile has them at once.

What this costs beyond the input: documents that share only a passage become candidates where the passage alone fills a
segment in both; a group of g classes that takes more than one cell is compared in about (g / cell_docs) ** 2 / 2 tiles.

Defined results: lower-case is of A-Z only; fewer words than a shingle make one shingle of the whole sequence; no words or
a null text give an empty set (n_shingles 0, own component). Repeated rows are copies like others. A row with a null id
has no name to be linked by and no row in the result. An id should name one text; if rows with different texts share one,
they count as linked where any of them is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, encoded, frugal, give_back, slices_by_bytes, sorted_runs
from .components import Forest, connected_components

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class JoinRules:
    """``threshold``: percent; ``width``: words in a shingle; ``growth``: ratio of the size bands that candidates use, in
    percent; ``cell_docs`` and ``cell_bytes``: bounds of a cell of a tile; ``least_bits``: of a bitmap, a power of two, 64 at
    least; ``bucket``: signatures in a bucket, about, and classes of one signature that still go there."""

    threshold: int = 85
    width: int = 4
    growth: int = 150
    cell_docs: int = 256
    cell_bytes: int = 64 << 20
    least_bits: int = 256
    bucket: int = 1 << 21

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes sum to ``total``."""
        return total * (100 - self.threshold) // (100 + self.threshold)

    def most_changed(self, size: int) -> int:
        """Largest symmetric difference of a set of ``size`` and one linked with it."""
        return self.most_apart(size + 100 * size // self.threshold)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = encoded(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = word[:n].copy()
    for k in range(1, width):
        h = mixed(h) + word[k : k + n]
    return np.unique(mixed(h))


#: Most likely share of the sets of a band that fill too few segments.
RARE = 1e-5


def filled_tail(balls: int, cells: int, most: int) -> float:
    """Probability that ``balls`` at random fill at most ``most`` of the cells: exact for few, by the normal law for many."""
    if balls <= 300:
        p = np.zeros(most + 2)
        p[0] = 1.0
        filled = np.arange(most + 2)
        for _ in range(balls):
            into = p * (cells - filled) / cells
            p = p * filled / cells
            p[1:] += into[:-1]
        return float(p[:-1].sum())
    one, two = (1 - 1 / cells) ** balls, (1 - 2 / cells) ** balls
    mean, variance = cells * (1 - one), cells * (cells - 1) * two + cells * one - (cells * one) ** 2
    return 0.5 * math.erfc((mean - most - 0.5) / math.sqrt(2 * max(variance, 1e-9)))


class Bands:
    """Size bands and their numbers of segments."""

    def __init__(self, rules: JoinRules):
        self.rules = rules
        self.starts = [1]
        self.known: dict[int, np.ndarray] = {}

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            last = self.starts[-1]
            self.starts.append(max(last + 1, last * self.rules.growth // 100))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def limits(self, band: int) -> np.ndarray:
        """Where the segments of a band begin, besides the first."""
        if band not in self.known:
            self.of(self.starts[band])
            most = self.starts[band + 1] - 1
            least = -(-self.rules.threshold * self.starts[band] // 100)
            sizes = sorted({least, (least + most) // 2, most})
            m = self.rules.most_changed(most) + 1
            while any(filled_tail(n, m, self.rules.most_changed(n)) > RARE for n in sizes):
                m += 1 + m // 128
            self.known[band] = np.array([(k << 64) // m for k in range(1, m)], np.uint64)
        return self.known[band]


def signatures(hashes: np.ndarray, bands: Bands, rules: JoinRules) -> np.ndarray:
    """Signatures of one set for every band in which a linked set may be."""
    size = len(hashes)
    if not size:
        return np.empty(0, np.uint64)
    apart = rules.most_changed(size)
    band, out = bands.of(size), []
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ _STEP), dtype=np.uint64)])
    while not out or 100 * size >= rules.threshold * bands.starts[band]:
        limits = bands.limits(band)
        at = np.concatenate([[0], np.searchsorted(hashes, limits), [size]])
        full = np.flatnonzero(np.diff(at))
        k = full[: apart + 1] if len(full) > apart else np.arange(len(at) - 1)
        out.append(mixed(total[at[k + 1]] - total[at[k]] + mixed(np.uint64(band << 32) + k.astype(np.uint64))))
        band += 1
        bands.of(bands.starts[band])
    return np.concatenate(out)


def bitmap(hashes: np.ndarray, least: int) -> np.ndarray:
    """Parity bitmap as 64-bit words: a bit tells whether an odd number of the hashes fall on it, so sets that differ in d
    hashes differ in at most d bits. As many bits as hashes, rounded up to a power of two, ``least`` at least."""
    size = max(least, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 1)
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words: halves laid over each other."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def link_tile(size: np.ndarray, maps: list[np.ndarray], side: np.ndarray, rules: JoinRules, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links in a tile, as index pairs: of the pairs that the bitmaps ``maps`` let pass, or with
    ``sets`` of the exact links. ``side``: 0 or 1; if both occur, only pairs of different sides are compared."""
    order = np.argsort(size, kind="stable")
    size, sides = size[order], side[order]
    maps = [maps[i] for i in order.tolist()]
    crossing = bool(sides.any()) and not bool(sides.all())
    root = np.arange(len(order))
    links = []
    table = np.empty((0, 0), np.uint64)
    begin = 0  # row 0 of ``table`` in the order
    for i in range(1, len(order)):
        first = int(np.searchsorted(100 * size[:i], rules.threshold * size[i]))
        if first == i:
            continue
        words = len(maps[first])  # maps grow with the sets, so this is the shortest of those compared
        if table.shape[1] != words or begin > first:
            begin = first
            table = np.stack([folded(m, words) for m in maps[first:] if len(m) <= 4 * words])
        near = np.arange(first, i)
        near = near[root[near] != root[i]]
        if crossing:
            near = near[sides[near] != sides[i]]
        if not len(near):
            continue
        apart = np.bitwise_count(table[near - begin] ^ table[i - begin]).sum(axis=1, dtype=np.int64)
        fits = apart <= (size[near] + size[i]) * (100 - rules.threshold) // (100 + rules.threshold)
        near, apart = near[fits], apart[fits]
        for j in near[np.argsort(apart, kind="stable")].tolist():
            if root[j] == root[i]:
                continue
            if sets is not None:
                both = overlap(sets[order[i]], sets[order[j]])
                if 100 * both < rules.threshold * (size[i] + size[j] - both):
                    continue
            links.append((int(order[i]), int(order[j])))
            root[root == root[i]] = root[j]
    return links


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """A set's digest as two non-negative 63-bit integers."""
    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return d >> 65, d & ((1 << 63) - 1)


SHORT = (1 << 48) - 1  # of a signature or class in a blob


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    x = np.zeros((len(blob) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel()


def _ordered(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
    return sig[keep], cls[keep]


PROFILE, SIGNATURES, COUNTS = 0, 1, 2
FRAME = {"kind": "int", "doc_id": "long", "n": "long", "hi": "long", "lo": "long", "bits": "binary", "sigs": "binary", "classes": "binary"}
_REST = {"doc_id": 0, "n": 0, "hi": 0, "lo": 0, "bits": b"", "sigs": b"", "classes": b""}


def _one_pass(docs: DataFrame, rules: JoinRules, flush: int = 1 << 19) -> DataFrame:
    """All that is wanted of the texts, in rows of three kinds: profiles (doc_id, n, digest as hi and lo, bits); signatures
    with their classes in blobs, ``flush`` at a time; and how often a frequent one (hi) occurs in such a blob (n)."""

    def frame(kind: int, **columns) -> pd.DataFrame:
        size = len(next(iter(columns.values())))
        return pd.DataFrame({"kind": np.full(size, kind, np.int32), **{c: columns.get(c, [v] * size) for c, v in _REST.items()}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(rules)
        sigs: list[np.ndarray] = []
        classes: list[np.ndarray] = []
        held, seen = 0, set()

        def send() -> Iterator[pd.DataFrame]:
            sig, cls = _ordered(np.concatenate(sigs), np.concatenate(classes))
            cuts = np.searchsorted(sig, np.array([k << 42 for k in range(1, 64)], np.uint64))
            parts = [(x, y) for x, y in zip(np.split(sig, cuts), np.split(cls, cuts), strict=True) if len(x)]
            yield frame(SIGNATURES, sigs=[_packed(x) for x, _ in parts], classes=[_packed(y) for _, y in parts])
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            often = np.diff(np.append(starts, len(sig)))
            many = often >= min(64, rules.bucket)
            if many.any():
                yield frame(COUNTS, hi=sig[starts[many]].astype(np.int64), n=often[many])

        for pdf in batches:
            for part in slices_by_bytes(pdf["text"]):
                profiles = []
                for doc, text in zip(pdf["doc_id"].loc[part.index].tolist(), part, strict=True):
                    s = shingles(text, rules.width)
                    hi, lo = digest(s)
                    profiles.append((doc, len(s), hi, lo, bitmap(s, rules.least_bits).tobytes()))
                    if not len(s) or lo in seen:  # nothing, or a copy of a text in this round
                        continue
                    seen.add(lo)
                    got = signatures(s, bands, rules) & np.uint64(SHORT)
                    sigs.append(got)
                    classes.append(np.full(len(got), lo & SHORT, np.uint64))
                    held += len(got)
                    if held >= flush:
                        yield from send()
                        sigs, classes, held = [], [], 0
                        seen.clear()
                if profiles:
                    yield frame(PROFILE, **dict(zip(["doc_id", "n", "hi", "lo", "bits"], zip(*profiles, strict=True), strict=True)))
        if held:
            yield from send()

    return docs.mapInPandas(frugal(run), ", ".join(f"{k} {v}" for k, v in FRAME.items()))


def _shared_signatures(rows: DataFrame, rules: JoinRules) -> DataFrame:
    """(group, short): the groups of two or more classes that share a signature, each once, with the last 48 bits of each
    class's digest. ``rows``: those of ``_one_pass``, checkpointed."""
    blobs = rows.where(F.col("kind") == SIGNATURES).select("sigs", "classes")
    total = blobs.agg(F.sum(F.octet_length("sigs").cast("long"))).collect()[0][0] or 0  # one row
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (6 * rules.bucket)))
    limits = np.array([(k << 48) // buckets for k in range(1, buckets)], np.uint64)
    # a hot signature takes rules.bucket of the signatures, so this list is short: 8 MB for 100 TB of text, about
    counted = rows.where(F.col("kind") == COUNTS).groupBy("hi").agg(F.sum("n").alias("n")).where(F.col("n") > rules.bucket)
    hot = np.array(sorted(r["hi"] for r in counted.select("hi").collect()), np.uint64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sig, cls in zip(map(_unpacked, pdf["sigs"]), map(_unpacked, pdf["classes"]), strict=True):
                if len(hot):
                    cool = ~np.isin(sig, hot)
                    sig, cls = sig[cool], cls[cool]
                first, last = (np.searchsorted(limits, sig[[0, -1]], side="right") if len(sig) else (0, -1))
                at = np.searchsorted(sig, limits[first:last])
                parts = zip(np.split(sig, at), np.split(cls, at), strict=True) if len(sig) else ()
                out += [(first + k, _packed(x), _packed(y)) for k, (x, y) in enumerate(parts) if len(x)]
            yield pd.DataFrame(out, columns=["bucket", "sigs", "classes"])

    def by_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sig, cls in zip(map(_unpacked, pdf["sigs"]), map(_unpacked, pdf["classes"]), strict=True):
                mine = np.isin(sig, hot)
                yield pd.DataFrame({"group": mixed(sig[mine]).view(np.int64), "short": cls[mine].astype(np.int64)})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, cls = _ordered(np.concatenate([_unpacked(x) for x in pdf["sigs"]]), np.concatenate([_unpacked(x) for x in pdf["classes"]]))
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        counts = np.diff(np.append(starts, len(sig)))
        # groups with the same members say the same; a group's name is a sum over them
        name = np.add.reduceat(mixed(cls ^ _MIX), starts) if len(cls) else np.empty(0, np.uint64)
        shared = np.flatnonzero(counts > 1)
        shared = shared[np.unique(name[shared], return_index=True)[1]]
        rows = np.repeat(starts[shared] - np.concatenate([[0], np.cumsum(counts[shared])[:-1]]), counts[shared]) + np.arange(counts[shared].sum()) if len(shared) else np.empty(0, np.int64)
        met = pd.DataFrame({"group": np.repeat(name[shared].view(np.int64), counts[shared]), "short": cls[rows].astype(np.int64)})
        del sig, cls, starts, counts, name, shared, rows
        give_back()
        return met

    found = blobs.mapInPandas(frugal(deal), "bucket long, sigs binary, classes binary").groupBy("bucket").applyInPandas(meet, "group long, short long")
    if len(hot):
        found = found.union(blobs.mapInPandas(frugal(by_class), "group long, short long"))
    return found.distinct()


def _level(rules: JoinRules) -> Column:
    """The size band of a row of n shingles; linked rows are of the same or neighbouring bands."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100.0 / rules.threshold)) * 1.0001)).cast("int")


def _large_groups(rows: DataFrame, group: str, rules: JoinRules) -> DataFrame:
    """(group, blocks, low, high) of the groups that take more than one cell: number of hash blocks, and the size bands that
    occur as two bit sets. A table of its own, so that a join with it splits or broadcasts by its measured size."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(rules.cell_docs)), F.ceil(F.sum("n") * 8 / F.lit(rules.cell_bytes))).cast("int")
    level = _level(rules)
    low = F.bit_or(F.when(level < 60, F.call_function("shiftleft", F.lit(1).cast("long"), level)).otherwise(F.lit(0)))
    high = F.bit_or(F.when(level >= 60, F.call_function("shiftleft", F.lit(1).cast("long"), level - 60)).otherwise(F.lit(0)))
    return cut_lineage(rows.groupBy(group).agg(blocks.alias("blocks"), low.alias("low"), high.alias("high")).where("blocks > 1").coalesce(4))


def _in_tiles(rows: DataFrame, group: str, large: DataFrame, payload: str, rules: JoinRules) -> DataFrame:
    """``rows`` (group, id, n, payload) dealt into tiles (group, l1, c1, l2, c2) with the side of each row in its tile."""
    dealt = rows.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("level", F.when(F.col("blocks") == 1, 0).otherwise(_level(rules)))
    dealt = dealt.withColumn("cell", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))

    def occurs(level: Column) -> Column:
        word = F.when(level < 60, F.col("low")).otherwise(F.col("high"))
        return (level >= 0) & (F.call_function("shiftright", word, F.pmod(level, F.lit(60))).bitwiseAND(F.lit(1)) == 1)

    # a tile is (lower level, its cell, upper level, its cell); in one level the smaller cell comes first
    cells = F.sequence(F.lit(0), F.col("blocks") - 1)
    same = F.transform(cells, lambda c: F.struct(F.col("level").alias("l1"), F.least(c, F.col("cell")).alias("c1"), F.col("level").alias("l2"), F.greatest(c, F.col("cell")).alias("c2"), (F.col("cell") > c).cast("int").alias("side")))
    up = F.transform(cells, lambda c: F.struct(F.col("level").alias("l1"), F.col("cell").alias("c1"), (F.col("level") + 1).alias("l2"), c.alias("c2"), F.lit(0).alias("side")))
    down = F.transform(cells, lambda c: F.struct((F.col("level") - 1).alias("l1"), c.alias("c1"), F.col("level").alias("l2"), F.col("cell").alias("c2"), F.lit(1).alias("side")))
    none = F.slice(same, 1, 0)
    both = F.concat(same, F.when(occurs(F.col("level") + 1), up).otherwise(none), F.when(occurs(F.col("level") - 1), down).otherwise(none))
    tiles = F.when(F.col("blocks") == 1, same).otherwise(both)
    dealt = dealt.select(group, "id", "n", payload, (F.col("blocks") == 1).alias("whole"), F.explode(tiles).alias("t"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(group, "id", "n", payload, "whole", "t.*").repartition(parts, group, *TILE).sortWithinPartitions(group, *TILE)


def _sides(side: np.ndarray, l1: int, c1: int, l2: int, c2: int) -> np.ndarray | None:
    """Sides of a tile's rows; None if one side of a tile of two cells is empty, which leaves nothing to compare."""
    if l1 == l2 and c1 == c2:
        return np.zeros(len(side), np.int64)
    return None if side.all() or not side.any() else side


TILE = ["l1", "c1", "l2", "c2"]


EDGES = "a long, b long"


def _frame(edges: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(edges, columns=columns, dtype="int64")


def _bitmap_edges(shared: DataFrame, classes: DataFrame, rules: JoinRules) -> DataFrame:
    """Edges (a, b) between representatives that share a signature and pass the bitmap bound."""
    found = shared.join(classes.select(F.col("lo").bitwiseAND(F.lit(SHORT)).alias("short"), F.col("rep").alias("id"), "n", "bits"), "short").drop("short")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, edges = Forest(), []
        for (_, *tile), rows in sorted_runs(batches, ["group", *TILE]):
            side = _sides(rows["side"], *tile)
            if side is None or len(side) < 2:
                continue
            ids = rows["id"].tolist()
            links = link_tile(rows["n"], [np.frombuffer(b, np.uint64) for b in rows["bits"]], side, rules)
            edges += [(ids[i], ids[j]) for i, j in links if forest.join(ids[i], ids[j])]
            if len(edges) >= 100_000:
                yield _frame(edges, ["a", "b"])
                edges = []
                if len(forest.above) > 1_000_000:
                    forest = Forest()
        yield _frame(edges, ["a", "b"])

    return _in_tiles(found, "group", _large_groups(found.select("group", "n"), "group", rules), "bits", rules).mapInPandas(frugal(compare), EDGES)


def _links(docs: DataFrame, family: DataFrame, rules: JoinRules) -> DataFrame:
    """(a, b, final): exact links inside the families; the final ones lead from a document to the smallest of its component.
    ``family``: (doc_id, family, n) of representatives."""
    texts = docs.join(family, "doc_id").select("family", F.col("doc_id").alias("id"), "n", "text").dropDuplicates(["id"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links: list[tuple] = []
        for (_, *tile), rows in sorted_runs(batches, ["family", *TILE]):
            side = _sides(rows["side"], *tile)
            if side is None or len(side) < 2:
                continue
            sets = [shingles(t, rules.width) for t in rows["text"]]
            size = np.array([len(s) for s in sets], np.int64)
            ids = rows["id"].tolist()
            pairs = [(ids[i], ids[j]) for i, j in link_tile(size, [bitmap(s, rules.least_bits) for s in sets], side, rules, sets)]
            if rows["whole"][0]:
                forest = Forest()
                for x, y in pairs:
                    forest.join(x, y)
                links += [(x, forest.root(x), 1) for x in {x for pair in pairs for x in pair} if forest.root(x) != x]
            else:
                links += [(x, y, 0) for x, y in pairs]
            if len(links) >= 100_000:
                yield _frame(links, ["a", "b", "final"])
                links = []
        yield _frame(links, ["a", "b", "final"])

    return _in_tiles(texts, "family", _large_groups(family, "family", rules), "text", rules).mapInPandas(frugal(compare), f"{EDGES}, final long")


def jaccard_components(docs: DataFrame, rules: JoinRules = JoinRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with an id: doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    texts = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    keyed = texts.where("doc_id is not null")
    rows = cut_lineage(_one_pass(keyed, rules))
    profiles = rows.where(F.col("kind") == PROFILE).select("doc_id", "n", "hi", "lo", "bits")
    filled = profiles.where("n > 0")
    classes = cut_lineage(filled.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    shared = cut_lineage(_shared_signatures(rows, rules))
    family = connected_components(_bitmap_edges(shared, classes, rules))
    members = classes.select(F.col("rep").alias("doc_id"), "n").join(family, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("family"), "n")
    links = cut_lineage(_links(keyed, cut_lineage(members.dropDuplicates(["doc_id"])), rules))
    linked = links.where("final = 1").select(F.col("a").alias("node"), F.col("b").alias("component"))
    open_ = links.where("final = 0").select("a", "b")
    if not open_.isEmpty():
        linked = linked.union(connected_components(open_))
    grouped = classes.join(linked, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    held = filled.select("doc_id", "n", "hi", "lo").join(grouped, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = profiles.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return held.unionByName(bare)
