"""Approximate nearest neighbours for the inner product: NN-descent joined tile by tile, and greedy search along its lists.

Equal vectors are one node. Nearness is the inner product itself, in the graph too: long vectors are near to many, and the
lists of others lead to them, as a search for the largest product needs. The search compares vectors in single precision, and
what it returns is scored from original vectors in double precision.

Tiles: nodes of about one direction, ``block`` of them or half the root of their number. Directions are fitted on a sample of at
most ``SAMPLE`` vectors, drawn by hash; every node is in one tile, and a tile of more than twice the size is split by hash.

Building: the members of a tile meet each other, then those of the tiles next to it, for first neighbour lists. Then rounds
repeat: a tile meets the ``offers`` tiles in which most neighbours of its members' neighbours lie, among those that it has not
met, and those that chose it; each node keeps the best that it meets, until few entries change. A meeting is one matrix product,
and only tiles move: as unit vectors of 16-bit floats with their norms, one row for each meeting. A hub meets ``reverse`` of
the tiles that chose it.

Search: a query opens its own tile and those of its list, then the nearest by their mean of the tiles to which lists of opened
tiles lead, ``beam`` at first and half as many again in each round. A query ends when no list leads further, or when two rounds
left its ``k`` best as they were; all end when a round changes under 7% of the best of those that still search.
Requests go to blocks of tiles with the query vector once per block.

Defined results: null, zero or non-finite vectors, null components, vectors of another length than most, and null ids take no
part; of rows with one id, that whose vector has the smallest digest counts, once; fewer candidates than ``k`` give fewer
rows; equal vectors are one node, of which the ``k + 1`` smallest ids can be in a result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut_lineage, sorted_runs


@dataclass(frozen=True)
class GraphRules:
    """``neighbours``: length of a list; ``offers``: tiles that a tile chooses to meet in a round; ``reverse``: most tiles that
    it meets because they chose it; ``block``: nodes in a tile of small tables, about; rounds end when under ``settled`` of the
    lists' entries change (or after ``rounds``, if given); ``beam``: tiles that a search opens at first; ``index_block``: nodes
    in a block of the index, about, if that makes no more than ``BLOCKS``."""

    neighbours: int = 32
    reverse: int = 32
    offers: int = 4
    block: int = 64
    rounds: int | None = None
    settled: float = 0.1
    beam: int = 64
    index_block: int = 65536
    seed: int = 11


#: Vectors that the driver fits directions on, at most; blocks of the index, as long as they have under LARGEST nodes.
SAMPLE, BLOCKS, LARGEST = 32768, 64, 1 << 18
#: Tiles that a round remembers of those in which a tile's neighbours lie.
LINKS = 64


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, vec, hi, lo): usable vectors, as floats if these are the same numbers and as doubles else, with a digest."""
    fields = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(1)
            ids, lengths = batch.column(0).to_numpy(), vector.value_lengths().to_numpy()
            flat, starts = vector.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths  # a null component becomes NaN
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[starts[at][:, None] + np.arange(dim)] + 0.0  # -0.0 is 0.0
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                at, x = at[good], x[good]
                with np.errstate(over="ignore", under="ignore"):
                    short = x.astype(np.float32)
                same = (short == x).all(axis=1).tolist()
                digests = [xxhash.xxh3_128_intdigest(v) for v in x]
                vecs = [(short[i] if same[i] else x[i]).tobytes() for i in range(len(x))]
                yield pa.record_batch([pa.array(ids[at], pa.int64()), pa.array(np.full(len(at), dim, np.int32)), pa.array(vecs, pa.binary()), pa.array([d >> 65 for d in digests], pa.int64()), pa.array([d & ((1 << 63) - 1) for d in digests], pa.int64())], schema=fields)

    rows = vectors.select(col(vectors, id_col).cast("long").alias("vec_id"), col(vectors, vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    found = rows.mapInArrow(run, "vec_id long, dim int, vec binary, hi long, lo long")
    return found.groupBy("vec_id").agg(F.min(F.struct("hi", "lo", "dim", "vec")).alias("v")).select("vec_id", "v.*")


def _doubles(blobs, dim: int) -> np.ndarray:
    """Vectors of ``_clean`` as rows of doubles."""
    sizes = {len(b) for b in blobs}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(blobs), "<f4" if sizes == {4 * dim} else "<f8").reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8") for b in blobs], np.float64).reshape(-1, dim)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision, and the norms."""
    largest = np.abs(x).max(axis=1, initial=1e-300, keepdims=True)
    unit = x / largest
    norm = np.sqrt(np.square(unit).sum(axis=1, keepdims=True))
    return (unit / norm).astype(np.float32), (norm * largest)[:, 0]


def _centres(sample: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` directions at most, by spherical k-means on unit vectors; near ones have near numbers."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), min(n, len(sample)), replace=False))]
    for _ in range(4):
        own = _nearest_centre(sample, centres)
        sums = np.zeros(centres.shape, np.float64)
        np.add.at(sums, own, sample)
        norm = np.sqrt(np.square(sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres).astype(np.float32)

    def ordered(at: np.ndarray) -> np.ndarray:
        if len(at) < 3:
            return at
        x = centres[at] - centres[at].mean(axis=0)
        along = np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")
        return np.concatenate([ordered(at[along[: len(at) // 2]]), ordered(at[along[len(at) // 2 :]])])

    return centres[ordered(np.arange(len(centres)))]


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[(x[i : i + 2048] @ centres.T).argmax(axis=1) for i in range(0, len(x), 2048)]])


def _mixed(ids: np.ndarray) -> np.ndarray:
    return (ids * -7046029254386353131 >> 33) & 0x3FFFFFFF


def _kept(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, best first, ties to the smaller id: rows, ids, scores, and places in a row."""
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = place < k
    return rows[best], ids[order][best], scores[order][best], place[best]


def _above(scores: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where scores reach their row's bar; of rows without one, the k best."""
    bare = np.flatnonzero(np.isneginf(bar))
    if len(bare) and scores.shape[1] > k:
        bar = bar.copy()
        bar[bare] = -np.partition(-scores[bare], k - 1, axis=1)[:, k - 1]
    r, c = np.divmod(np.flatnonzero(scores >= bar[:, None]), scores.shape[1])
    real = scores[r, c] > -np.inf
    return r[real], c[real]


def _reclaim(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of frames that are gone; it only does so when Python and the driver's JVM have collected
    their garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


TILE = "tile int, ids binary, vecs binary"
LISTS = "tile int, near binary, sims binary, changed long, linked binary, links binary"


def _numbered(nodes: DataFrame, base: np.ndarray, splits: np.ndarray) -> DataFrame:
    """``nodes``: (id, cell, ...) with the numbers of their tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = pdf["cell"].to_numpy(np.int64)
            yield pdf.assign(tile=(base[cell] + _mixed(pdf["id"].to_numpy(np.int64)) % splits[cell]).astype(np.int32))

    return nodes.mapInPandas(run, nodes.withColumn("tile", F.lit(0)).schema)


def _tiles(nodes: DataFrame, dim: int) -> DataFrame:
    """``nodes``: (id, vec, tile). One row per tile: its ids in order and their vectors."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        if (pdf["vec"].map(len) == 4 * dim).all():
            vecs = b"".join(pdf["vec"])
        else:
            vecs = _doubles(pdf["vec"].tolist(), dim).tobytes()
        return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vecs": [vecs]})

    return nodes.select("tile", "id", "vec").groupBy("tile").applyInPandas(pack, TILE)


def _members(ids: bytes, vecs: bytes, dim: int) -> np.ndarray:
    """A tile's vectors as rows of doubles."""
    return np.frombuffer(vecs, "<f8" if len(vecs) == dim * len(ids) else "<f4").reshape(-1, dim).astype(np.float64)


@dataclass(frozen=True)
class Tiling:
    """``sizes``, ``means``: nodes of each tile, mean of their vectors over ``most``, the largest norm; ``bits``: of a place in a tile. A node's address is
    its tile's number and its place there. ``blocks``: of the index, by tile."""

    dim: int
    sizes: np.ndarray
    means: np.ndarray
    most: float
    bits: int
    blocks: np.ndarray

    @property
    def kind(self) -> str:
        return "<i4" if len(self.means) << self.bits < 1 << 31 else "<i8"


def _offers(tiles: DataFrame, lists: DataFrame | None, meets: dict[int, list[int]], tiling: Tiling, rules: GraphRules) -> DataFrame:
    """New lists of the tiles. ``meets``: the tiles that each tile meets, none of them for the second time. ``changed``: entries
    that are new; ``linked``: the tiles in which most entries lie, and how many; ``links``: a bit for every tile that has one."""
    dim, most, bits, kind, n, k = tiling.dim, tiling.most, tiling.bits, tiling.kind, len(tiling.means), rules.neighbours
    goes: dict[int, list[int]] = {}
    for tile, others in meets.items():
        for other in {tile, *others}:
            goes.setdefault(other, []).append(tile)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile, ids, vecs in zip(pdf["tile"].tolist(), pdf["ids"], pdf["vecs"], strict=True):
                if to := goes.get(tile):
                    unit, norm = _directions(_members(ids, vecs, dim))
                    wide = (norm / most).astype("<f4").tobytes() + unit.astype("<f2").tobytes()
                    yield pd.DataFrame({"tile": np.array(to, np.int32), "source": np.int32(tile), "wide": [wide] * len(to), "sims": None})

    def vectors(wide: bytes) -> tuple[np.ndarray, np.ndarray]:
        m = len(wide) // (4 + 2 * dim)
        return np.frombuffer(wide, "<f2", offset=4 * m).reshape(m, dim).astype(np.float32), np.frombuffer(wide, "<f4", m)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = int(pdf["tile"].iloc[0])
        sent = {int(s): (w, b) for s, w, b in zip(pdf["source"], pdf["wide"], pdf["sims"], strict=True)}
        x, norm = vectors(sent[tile][0])
        m = len(x)
        if -1 in sent:
            near, sims = np.frombuffer(sent[-1][0], kind).reshape(m, k).astype(np.int64), np.frombuffer(sent[-1][1], "<f4").reshape(m, k)
        else:
            near, sims = np.full((m, k), -1), np.full((m, k), -np.inf, np.float32)
        met = sorted(meets[tile])
        others = [vectors(sent[t][0]) for t in met]
        ids = np.concatenate([np.empty(0, np.int64), *[np.arange(len(y)) + (t << bits) for t, (y, _) in zip(met, others, strict=True)]])
        y = np.concatenate([np.empty((0, dim), np.float32), *[u * r[:, None] for u, r in others]])
        near_, sims_, changed = np.full((m, k), -1, kind), np.full((m, k), -np.inf, np.float32), 0
        step = max(1, 4_000_000 // (k + len(y)))
        for at in range(0, m, step):
            part = slice(at, at + step)
            s = x[part] @ y.T
            if tile in meets[tile]:
                s[(np.arange(m)[part] + (tile << bits))[:, None] == ids] = -np.inf
            s = np.concatenate([sims[part], s], axis=1)
            r, c = _above(s, np.full(len(s), -np.inf, np.float32), k)
            found = near[part][r, np.minimum(c, k - 1)]
            found[c >= k] = ids[c[c >= k] - k]
            rows, got, scores, place = _kept(r, found * 2 + (c >= k), s[r, c], k)
            near_[part][rows, place], sims_[part][rows, place] = got >> 1, scores
            changed += int((got & 1).sum())
        linked, count = np.unique(near_[near_ >= 0] >> bits, return_counts=True)
        links = np.zeros(n, bool)
        links[linked] = True
        best = np.argsort(-count, kind="stable")[:LINKS]
        return pd.DataFrame({"tile": [np.int32(tile)], "near": [near_.tobytes()], "sims": [sims_.tobytes()], "changed": [changed], "linked": [np.array([linked[best], count[best]], np.int64).tobytes()], "links": [np.packbits(links).tobytes()]})

    rows = tiles.mapInPandas(send, "tile int, source int, wide binary, sims binary")
    if lists is not None:
        rows = rows.union(lists.select("tile", F.lit(-1), "near", "sims"))
    return rows.groupBy("tile").applyInPandas(meet, LISTS)


def build_graph(tiles: DataFrame, n: int, tiling: Tiling, rules: GraphRules = GraphRules()) -> DataFrame:
    """Neighbour lists (LISTS) of ``n`` nodes in ``tiles``, checkpointed."""
    count = len(tiling.means)

    def links(lists: DataFrame) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
        rows = lists.select("tile", "changed", "linked").collect()  # a row a tile, LINKS numbers at most
        return sum(r["changed"] for r in rows), {r["tile"]: tuple(np.frombuffer(r["linked"], np.int64).reshape(2, -1)) for r in rows}

    filled = np.flatnonzero(tiling.sizes).tolist()
    lists = cut_lineage(_offers(tiles, None, {t: [t] for t in filled}, tiling, rules))
    met = [{t} for t in range(count)]
    linked, done = None, 0
    while rules.rounds is None or done < rules.rounds:  # two tiles meet once, so that rounds come to an end
        chosen: dict[int, list[int]] = {}
        for t in filled:
            if linked is None:
                score = np.where(tiling.sizes > 0, tiling.means @ tiling.means[t], -np.inf)
            else:  # neighbours, and their neighbours
                score = np.zeros(count)
                own, weights = linked[t]
                score[own] += weights
                for u, w in zip(own.tolist(), weights.tolist(), strict=True):
                    score[linked[u][0]] += w * linked[u][1] / max(linked[u][1].sum(), 1)
                score[score == 0] = -np.inf
            score[list(met[t])] = -np.inf
            best = np.argsort(-score, kind="stable")[: rules.offers]
            chosen[t] = [int(u) for u in best if score[u] > -np.inf]
        meets = {t: set(c) for t, c in chosen.items()}
        pointing = [0] * count
        for t, c in chosen.items():
            for u in c:
                if t not in met[u] and t not in meets[u] and pointing[u] < rules.reverse:
                    pointing[u] += 1
                    meets[u].add(t)
        if not any(meets.values()):
            break
        for t, others in meets.items():
            met[t] |= others
        done += 1
        lists = cut_lineage(_offers(tiles, lists, {t: sorted(others) for t, others in meets.items()}, tiling, rules))
        changed, linked = links(lists)
        _reclaim(lists)
        if changed <= rules.settled * n * rules.neighbours:
            break
    return lists


STATE = "kind int, id long, at long, block int, bar float, vec binary, near binary, sims binary, want binary, opened binary, known binary, quiet int, changed int"
#: A search opens so many times the tiles of the round before, until that changes less than this share of the best.
WIDER, ENOUGH = 1.5, 0.07


def search_graph(tiles: DataFrame, starts: DataFrame, k: int, tiling: Tiling, links: np.ndarray, rules: GraphRules) -> DataFrame:
    """``tiles``: checkpointed. ``starts``: tiles with ``near``, ``sims`` and the ids of the queries in them (``wanted``).
    ``links``: a bit for each tile to which lists of a tile lead, by tile. Returns (q, id, score): the best nodes found per query,
    ``k`` at least if there are as many, the query's own node among them."""
    spark = tiles.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in STATE.split(", ")]
    dim, bits, n, length = tiling.dim, tiling.bits, len(tiling.means), max(rules.neighbours, k)
    blocks, means = tiling.blocks, tiling.means
    shared = spark.sparkContext.broadcast(links)  # n * n bits

    def state(id_: int, at: int, vec: bytes, near: bytes, sims: bytes, opened: np.ndarray, known: np.ndarray, quiet: int, changed: int) -> tuple:
        return 0, id_, at, -1, 0.0, vec, near, sims, b"", opened.tobytes(), known.tobytes(), quiet, changed

    def requests(id_: int, at: int, vec: bytes, bar: float, want: np.ndarray) -> list[tuple]:
        want = np.sort(want).astype(np.int32)
        to = blocks[want]  # in order as well
        cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(want)]
        return [(1, id_, at, int(to[a]), bar, vec, b"", b"", want[a:b].tobytes(), b"", b"", 0, 0) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def next_tiles(vec: bytes, opened: np.ndarray, known: np.ndarray, count: int) -> np.ndarray:
        """The nearest ``count`` tiles that are known and not opened."""
        left = np.flatnonzero(np.unpackbits(known & ~opened, count=n))
        if count < len(left):
            unit = _directions(_doubles([vec], dim))[0][0]
            left = left[np.argpartition(-(means @ unit)[left], count)[:count]]
        return left

    def opening(opened: np.ndarray, known: np.ndarray, want: np.ndarray) -> None:
        """Sets the bits of ``opened`` and ``known``."""
        marks = np.zeros(n, bool)
        marks[want] = True
        opened |= np.packbits(marks)
        known |= np.bitwise_or.reduce(shared.value[want], axis=0)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile, ids, vecs, near, sims, wanted in zip(pdf["tile"].tolist(), pdf["ids"], pdf["vecs"], pdf["near"], pdf["sims"], pdf["wanted"], strict=True):
                ids = np.frombuffer(ids, np.int64)
                size = len(vecs) // len(ids)
                near = np.frombuffer(near, tiling.kind).reshape(len(ids), -1)
                sims = np.frombuffer(sims, "<f4").reshape(len(ids), -1)
                out = []
                for id_ in sorted(wanted):
                    i = int(np.searchsorted(ids, id_))
                    vec = vecs[i * size : (i + 1) * size]
                    opened, known = np.zeros((2, links.shape[1]), np.uint8)
                    want = np.union1d(near[i][near[i] >= 0] >> bits, [tile])
                    opening(opened, known, want)
                    more = next_tiles(vec, opened, known, rules.beam - len(want)) if len(want) < rules.beam else want[:0]
                    opening(opened, known, more)
                    low = float(sims[i][-1]) if sims.shape[1] >= length else -np.inf
                    at = (tile << bits) + i
                    out.append(state(id_, at, vec, b"", b"", opened, known, 0, 0))
                    out += requests(id_, at, vec, low - 0.004 * abs(low) if low > -np.inf else low, np.append(want, more))  # lists have 16 bits
                yield pd.DataFrame(out, columns=names)

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """``left``: the block's tiles; ``right``: requests to it."""
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in names})
        vec = _directions(_doubles(right["vec"].tolist(), dim))[0]
        bar, own = right["bar"].to_numpy(np.float32), right["at"].to_numpy(np.int64)
        want = [np.frombuffer(b, np.int32) for b in right["want"]]
        asking, want = np.repeat(np.arange(len(want)), [len(w) for w in want]), np.concatenate(want)
        order = np.argsort(want, kind="stable")
        asking, want = asking[order], want[order]
        found = []
        for tile, ids, vecs in zip(left["tile"].tolist(), left["ids"], left["vecs"], strict=True):
            rows = asking[np.searchsorted(want, tile) : np.searchsorted(want, tile, "right")]
            x = (_members(ids, vecs, dim) / tiling.most).astype(np.float32).T.copy() if len(rows) else None
            step = max(64, 400_000 // max(1, len(ids) // 8))  # products that stay in a core's cache
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                s = vec[r] @ x
                i, j = _above(s, bar[r], length + 1)
                found.append((r[i], (tile << bits) + j, s[i, j]))
        rows, near, sims = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        other = near != own[rows]
        rows, near, sims, _ = _kept(rows[other], near[other], sims[other], length)
        starts_ = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
        ids = right["id"].to_numpy(np.int64)
        out = [(2, int(ids[rows[a]]), int(own[rows[a]]), -1, 0.0, b"", near[a:b].tobytes(), sims[a:b].tobytes(), b"", b"", b"", 0, 0) for a, b in zip(starts_.tolist(), [*starts_[1:].tolist(), len(rows)], strict=False)]
        return pd.DataFrame(out, columns=names)

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per query: its state (kind 0) and answers (kind 2) give the next state and requests."""
        out = []
        for (id_,), pdf in sorted_runs(batches, ["id"]):
            i = int(np.flatnonzero(pdf["kind"] == 0)[0])
            at, vec, quiet = int(pdf["at"][i]), pdf["vec"][i], int(pdf["quiet"][i])
            opened, known = (np.frombuffer(pdf[c][i], np.uint8).copy() for c in ("opened", "known"))
            if quiet > 1:
                out.append(state(id_, at, vec, pdf["near"][i], pdf["sims"][i], opened, known, quiet, 0))
            else:
                before = np.frombuffer(pdf["near"][i], np.int64)
                near, sims = np.frombuffer(b"".join(pdf["near"]), np.int64), np.frombuffer(b"".join(pdf["sims"]), "<f4")
                best = np.lexsort((near, -sims))[:length]
                near, sims = near[best], sims[best]
                changed = k - int(np.isin(near[:k], before[:k], assume_unique=True).sum())
                quiet = 0 if changed else quiet + 1
                count = int(np.bitwise_count(opened).sum())
                want = next_tiles(vec, opened, known, int(np.ceil((WIDER - 1) * count))) if quiet < 2 else near[:0]
                opening(opened, known, want)
                quiet = quiet if len(want) else 2
                out.append(state(id_, at, vec, near.tobytes(), sims.tobytes(), opened, known, quiet, changed))
                out += requests(id_, at, vec, float(sims[-1]) if len(sims) >= length else -np.inf, want)
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(block=blocks[pdf["tile"].to_numpy()].astype(np.int32))[["block", "tile", "ids", "vecs"]]

    index = cut_lineage(tiles.mapInPandas(dealt, "block int, tile int, ids binary, vecs binary"))
    step = cut_lineage(starts.mapInPandas(begin, STATE))
    while True:  # a tile is opened once for a query
        answers = index.groupBy("block").cogroup(step.where("kind = 1").groupBy("block")).applyInPandas(answer, STATE)
        step = cut_lineage(step.where("kind = 0").union(answers).repartition(parts, "id").sortWithinPartitions("id").mapInPandas(advance, STATE))
        del answers
        _reclaim(step)
        active, changed = step.where("kind = 0 and quiet < 2").agg(F.count(F.lit(1)), F.sum("changed")).collect()[0]  # one row
        if not active or changed < ENOUGH * k * active:
            break

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, at, vec, near in zip(pdf["id"].tolist(), pdf["at"].tolist(), pdf["vec"], pdf["near"], strict=True):
                near = np.append(np.frombuffer(near, np.int64), at)
                to = blocks[near >> bits]
                out += [(id_, int(b), vec, near[to == b].tobytes()) for b in np.unique(to)]
            yield pd.DataFrame(out, columns=["id", "block", "vec", "near"])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "id": [], "score": []})
        near = [np.frombuffer(b, np.int64) for b in right["near"]]
        asking, near = np.repeat(np.arange(len(near)), [len(a) for a in near]), np.concatenate(near)
        vec = _doubles(right["vec"].tolist(), dim)
        order = np.argsort(near, kind="stable")
        asking, near = asking[order], near[order]
        out = []
        for tile, ids, vecs in zip(left["tile"].tolist(), left["ids"], left["vecs"], strict=True):
            a, b = np.searchsorted(near, [tile << bits, (tile + 1) << bits])
            if a < b:
                place = near[a:b] - (tile << bits)
                s = np.cumsum(_members(ids, vecs, dim)[place] * vec[asking[a:b]], axis=1)[:, -1]  # in the order of the components
                out.append(pd.DataFrame({"q": right["id"].to_numpy(np.int64)[asking[a:b]], "id": np.frombuffer(ids, np.int64)[place], "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "id": [], "score": []})

    asks = step.where("kind = 0").mapInPandas(last, "id long, block int, vec binary, near binary")
    return cut_lineage(index.groupBy("block").cogroup(asks.groupBy("block")).applyInPandas(score, "q long, id long, score double"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, rules: GraphRules = GraphRules(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of every row for which ``is_query`` (an expression over ``vec_id``) holds: query_id, rank,
    vec_id, score."""
    rows = cut_lineage(_clean(vectors, id_col, vector_col))
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()  # one row
    dim, n = (dims[0]["dim"], dims[0]["n"]) if dims else (0, 0)
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.col("dim") == dim)
    size = max(rules.block, int(n**0.5 / 2), 2)
    drawn = F.pmod(F.xxhash64("hi", "lo", F.lit(rules.seed)), F.lit(1 << 30))
    sample = rows.select("vec", drawn.alias("d"), "hi", "lo").where(F.col("d") <= (2 * SAMPLE << 30) // n).groupBy("d", "hi", "lo").agg(F.min("vec").alias("vec"))
    sample = sample.orderBy("d", "hi", "lo").limit(SAMPLE).select("vec").collect()
    centres = _centres(_directions(_doubles([r["vec"] for r in sample], dim))[0], -(-n // size), rules.seed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            unit, norm = _directions(_doubles(pdf["vec"].tolist(), dim)) if len(pdf) else (np.empty((0, dim), np.float32), np.empty(0))
            yield pdf[["hi", "lo", "id", "vec"]].assign(cell=_nearest_centre(unit, centres).astype(np.int32), norm=norm)

    classes = rows.groupBy("hi", "lo").agg(F.min("vec_id").alias("id"), F.min("vec").alias("vec"))
    nodes = cut_lineage(classes.mapInPandas(assign, "hi long, lo long, id long, vec binary, cell int, norm double"))
    cells = nodes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).collect()  # a row a tile, about
    sizes = np.zeros(len(centres), np.int64)
    for r in cells:
        sizes[r["cell"]] = r["n"]
    splits = np.where(sizes > 2 * size, -(-sizes // size), np.minimum(sizes, 1))
    base = np.cumsum(splits) - splits
    most = max([r["norm"] for r in cells], default=1.0)
    member = cut_lineage(rows.select("vec_id", "hi", "lo").join(nodes.select("hi", "lo", "id", "cell"), ["hi", "lo"]).select("vec_id", "id", "cell"))
    tiles = cut_lineage(_tiles(_numbered(nodes.select("id", "vec", "cell"), base, splits), dim))
    n = int(sizes.sum())
    del rows, classes, nodes
    _reclaim(tiles)

    def about(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            means = [(_members(i, v, dim) / most).mean(axis=0).astype("<f4").tobytes() for i, v in zip(pdf["ids"], pdf["vecs"], strict=True)]
            yield pd.DataFrame({"tile": pdf["tile"], "n": [len(i) // 8 for i in pdf["ids"]], "mean": means})

    count = int(splits.sum())
    sizes, means = np.zeros(count, np.int64), np.zeros((count, dim), np.float32)
    for r in tiles.mapInPandas(about, "tile int, n int, mean binary").collect():  # a row a tile
        means[r["tile"]], sizes[r["tile"]] = np.frombuffer(r["mean"], "<f4"), r["n"]
    in_blocks = max(min(-(-n // rules.index_block), BLOCKS), -(-n // LARGEST), min(count, 12))
    tiling = Tiling(dim, sizes, means, most, int(sizes.max() - 1).bit_length(), (np.cumsum(sizes) - sizes) * in_blocks // n)

    lists = build_graph(tiles, n, tiling, rules)
    links = np.zeros((count, -(-count // 8)), np.uint8)
    for r in lists.select("tile", "links").toLocalIterator():  # a bit for two tiles
        links[r["tile"]] = np.frombuffer(r["links"], np.uint8)
    queries = member.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("id"), "cell")
    wanted = _numbered(queries.select("id", "cell").distinct(), base, splits).groupBy("tile").agg(F.collect_list("id").alias("wanted"))
    starts = tiles.join(lists.select("tile", "near", "sims"), "tile").join(wanted, "tile")

    hits = search_graph(tiles, starts, k + 1, tiling, links, rules)
    # of a node's equal vectors the k + 1 smallest ids are enough; the limit applies before the shuffle
    small = member.select("vec_id", "id").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    per_node = hits.join(small, "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", "vec_id", "score", "r")
    pairs = queries.select("query_id", "id").join(per_node, queries["id"] == per_node["q"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
