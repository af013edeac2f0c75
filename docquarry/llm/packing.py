"""Best-fit packing of documents into sequences by the sum-of-squares rule.

A document becomes its token ids and an end id; only one longer than a sequence is cut into pieces. Pieces go one by one
to the open sequence, or a new one, after which the sum over all residual gaps of the squared number of open sequences
with that gap is smallest. This keeps the gaps varied, so that later pieces find a fit. Long pieces go first.

Packing runs inside the partitions that tokenise, on lengths alone; nothing is shuffled and no task sees more than its
own split. Sequences whose gap is too large are few in each partition; their pieces meet in a second, small round, a partition
for every ``spread`` of them, where the same rule packs them again. A round sorts its pieces before it packs them, and the
second reads what the first has checkpointed, so a task that runs again gives every piece the same place.

Defined results: pieces of one length go by document id, piece and checksum; a null text packs as the empty text (the end id alone, one token); repeated rows are packed one by one;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import col, cut_lineage, frugal, slices_by_bytes
from .word_tokens import WordTokens

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, in the order given, and the number of bins."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; gap 0 and ``capacity`` stay 0
    stacks: dict[int, list[int]] = {}
    bins = np.empty(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    used = 0
    far = np.int64(1) << 60
    for i, size in enumerate(lengths.tolist()):
        if size == capacity:
            bins[i], used = used, used + 1
            continue
        # change of the sum of squares when a bin of gap size..capacity-1 takes the piece; a bin that becomes full leaves
        now = open_bins[size:capacity]
        change = np.where(now > 0, 2 * (open_bins[: capacity - size] - now) + 2, far)
        change[0] = 1 - 2 * now[0] if now[0] else far
        best = int(change.argmin())  # of equal ones the smallest gap: the best fit
        if change[best] <= 2 * open_bins[capacity - size] + 1:
            gap = size + best
            at = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, at = capacity, used
            used += 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > size:
            stacks.setdefault(gap - size, []).append(at)
            open_bins[gap - size] += 1
    return bins, offsets, used


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Long pieces first; results in the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, used = sum_of_squares(lengths[order], capacity)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return bins[back], offsets[back], used


def pieces(texts: list[str | None], ids: list, tokens: WordTokens, capacity: int, end_id: int) -> list[tuple]:
    end = int(end_id).to_bytes(4, "little")
    out = []
    for doc, got in zip(ids, tokens.encode_slice(["" if t is None else t for t in texts]), strict=True):
        whole = got + end
        for k, at in enumerate(range(0, len(whole), 4 * capacity)):
            part = whole[at : at + 4 * capacity]
            out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
    return out


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    make_tokens: Callable[[str], WordTokens] = WordTokens,
    loose_gap: int | None = None,
    spread: int = 1 << 16,
) -> DataFrame:
    """One row per piece: ``SCHEMA``. ``loose_gap``: sequences with a larger gap after the first round are packed again
    (default 1/64 of the capacity); ``spread``: pieces in a partition of the second round, about."""
    loose = capacity // 64 if loose_gap is None else loose_gap

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = make_tokens(tokenizer_path)
        found: list[tuple] = []
        for pdf in batches:
            for part in slices_by_bytes(pdf["text"], 1 << 20):
                found += pieces(list(part), pdf["doc_id"].loc[part.index].astype(object).where(pdf["doc_id"].loc[part.index].notna(), None).tolist(), tokens, capacity, end_id)
        pdf = pd.DataFrame(found, columns=PIECE)
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        yield from placed(pdf, loose, 0)

    def placed(pdf: pd.DataFrame, gap: int, base: int) -> Iterator[pd.DataFrame]:
        """Rows of a whole partition; pieces of sequences with a larger gap get no sequence yet."""
        if pdf.empty:
            return
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        length = pdf["length"].to_numpy(np.int64)
        bins, offsets, used = pack(length, capacity)
        full = np.bincount(bins, weights=length, minlength=used)
        part = TaskContext.get().partitionId()
        done = (full >= capacity - gap)[bins]
        pdf["sequence_id"] = pd.Series(base + (part << 32) + bins, dtype="Int64").where(done)
        pdf["offset"] = offsets
        yield pdf

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf[PIECE].astype({"doc_id": "Int64"}) for pdf in batches if len(pdf)]
        if parts:
            yield from placed(pd.concat(parts, ignore_index=True), capacity, 1 << 62)

    texts = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    once = cut_lineage(texts.mapInPandas(frugal(first), SCHEMA))
    tight = once.where("sequence_id is not null")
    rest = once.where("sequence_id is null")
    rest = rest.repartition(max(1, -(-rest.count() // spread)), "doc_id", "piece", "ids_crc32")
    return tight.unionByName(rest.mapInPandas(frugal(second), SCHEMA))
