"""Substring deduplication by content-defined chunking.

A 16-bit gear hash rolls over the UTF-8 bytes (each step shifts and adds a random value of the byte, so the hash depends
on the last 16 bytes alone). A chunk ends where the top four bits are zero, within least and greatest sizes; boundaries
follow the content, so an insertion shifts bytes but not the chunks after it. Chunks are deduplicated by their digest: a
chunk is repeated if two different documents hold it, and the document with the smallest id keeps it. Repeated chunks
that touch form spans; only spans in which ``least_words`` words begin count, so that common phrases leave a document alone
(or spans of ``least_bytes``, for text without blanks). The chunks at both ends of a shared passage hold foreign bytes too and
don't repeat, so this is less than half of the 50 words that a passage worth finding has.

Digests are pre-aggregated before the shuffle, and the join back is one that adaptive execution can split, so a chunk that
a third of all documents share lands in no single task. Chunks of 64-bit digest; texts don't move.

Defined results: null or empty texts have no chunks; rows with a null id are neither reported nor changed nor counted;
rows that share an id are one document for counting (a copy under the same id repeats nothing), and removal checks each
chunk's digest against the text at hand before it cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, col, cut_lineage, encoded, free_name, frugal, slices_by_bytes

WINDOW = 16
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True


@dataclass(frozen=True)
class Chunking:
    """``zero_bits``: a boundary is expected every 2**zero_bits bytes; sizes in bytes, ``most`` below 256; ``least_words`` and
    ``least_bytes``: of a span, one of them."""

    zero_bits: int = 4
    least: int = 16
    most: int = 160
    least_words: int = 22
    least_bytes: int = 400
    seed: int = 7


def gear_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(raws: list[bytes], rules: Chunking) -> list[list[int]]:
    """End positions of the chunks of each text."""
    if not raws:
        return []
    blank = b"\0" * WINDOW
    data = np.frombuffer(b"".join(r + blank for r in raws), np.uint8)
    h = gear_table(rules.seed)[data]
    starts = np.cumsum([0] + [len(r) + WINDOW for r in raws])
    for s in starts[1:]:
        h[s - WINDOW : s] = 0  # a text starts with an empty window
    step = 1
    while step < WINDOW:  # the hash over 2, 4, 8 and 16 bytes
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint16(step)
        h, step = wider, 2 * step
    after = np.empty(len(data), np.uint8)
    after[:-1], after[-1] = data[1:], 0
    found = np.flatnonzero((h >> np.uint16(16 - rules.zero_bits) == 0) & (after & 0xC0 != 0x80)) + 1  # never inside a character
    edges = np.searchsorted(found, starts, side="right")
    out = []
    for k, raw in enumerate(raws):
        n, last, ends = len(raw), 0, []
        for c in (found[edges[k] : edges[k + 1]] - starts[k]).tolist() + [n]:
            if c > n:
                continue
            while c - last > rules.most:
                last = last + rules.most
                while raw[last] & 0xC0 == 0x80:
                    last -= 1
                ends.append(last)
            if c - last >= rules.least or (c == n and c > last):
                ends.append(c)
                last = c
        out.append(ends)
    return out


def words_begun(raw: bytes, ends: list[int]) -> list[int]:
    """Words that begin in each chunk."""
    if not ends:
        return []
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    begun = np.cumsum(~space & np.concatenate([[True], space[:-1]]))
    return np.diff(begun[np.array(ends) - 1], prepend=0).tolist()


def chunk_rows(docs: DataFrame, rules: Chunking, id_col: str, text_col: str) -> DataFrame:
    """(digest, doc_id, span): a row per chunk; span: 65536 * start + 256 * words + length: bytes, and words that begin there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices_by_bytes(pdf["text"], 1 << 20):
                raws = [encoded(t) for t in part]
                digests, spans, counts = [], [], []
                for raw, ends in zip(raws, cuts(raws, rules), strict=True):
                    begins = [0, *ends[:-1]]
                    digests += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins, ends)]
                    spans += [a * 65536 + w * 256 + b - a for a, b, w in zip(begins, ends, words_begun(raw, ends))]
                    counts.append(len(ends))
                ids = pdf["doc_id"].loc[part.index].to_numpy(np.int64)
                yield pd.DataFrame({"digest": np.array(digests, np.uint64).view(np.int64), "doc_id": np.repeat(ids, counts), "span": np.array(spans, np.int64)})

    texts = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    return texts.where("doc_id is not null and text is not null").mapInPandas(frugal(run), "digest long, doc_id long, span long")


def repeated_chunks(docs: DataFrame, rules: Chunking, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, run, begin, end, words, digest, first_doc_id): the repeated chunks, with a number for each span in its document."""
    chunks = chunk_rows(docs, rules, id_col, text_col)
    firsts = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last")
    firsts = cut_lineage(firsts)  # as a table of its own it joins with nothing between, which lets Spark split hot digests
    found = chunks.join(firsts, "digest")
    begin = F.shiftright("span", 16)
    found = found.select("doc_id", begin.alias("begin"), (begin + F.col("span").bitwiseAND(255)).alias("end"), F.shiftright("span", 8).bitwiseAND(255).alias("words"), "digest", "first_doc_id")
    by_place = Window.partitionBy("doc_id").orderBy("begin", "end", "digest")
    apart = F.when(F.lag("end").over(by_place) >= F.col("begin"), 0).otherwise(1)
    return found.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by_place)).drop("apart")


def _long_enough(rules: Chunking) -> Column:
    return (F.sum("words") >= rules.least_words) | (F.max("end") - F.min("begin") >= rules.least_bytes)


def repeated_spans(docs: DataFrame, rules: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span: doc_id, span_start, span_end (bytes of the UTF-8 text), n_chunks, kept_chunks (those of
    which this document is the first holder), first_doc_id (smallest first holder). Documents without one have no row."""
    spans = repeated_chunks(docs, rules, id_col, text_col).groupBy("doc_id", "run").agg(
        F.min("begin").alias("span_start"),
        F.max("end").alias("span_end"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.col("first_doc_id") == F.col("doc_id")).alias("kept_chunks"),
        F.min("first_doc_id").alias("first_doc_id"),
        _long_enough(rules).alias("long"),
    )
    return spans.where("long").drop("run", "long")


def without(text: str, begins: np.ndarray, ends: np.ndarray, digests: np.ndarray) -> str:
    """The text without these byte ranges, as far as their digests agree."""
    raw = encoded(text)
    kept, at = [], 0
    for a, b, d in sorted(zip(begins.tolist(), ends.tolist(), digests.tolist(), strict=True)):
        if a >= at and b <= len(raw) and xxhash.xxh3_64_intdigest(raw[a:b]) == d % (1 << 64):
            kept.append(raw[at:a])
            at = b
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def drop_repeated_spans(docs: DataFrame, rules: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns; of every repeated span, all but the first holder lose the chunks that they don't hold
    first."""
    runs = repeated_chunks(docs, rules, id_col, text_col).groupBy("doc_id", "run").agg(
        _long_enough(rules).alias("long"),
        F.collect_list(F.when(F.col("first_doc_id") < F.col("doc_id"), F.struct("begin", "end", "digest"))).alias("cut"),
    )
    key, cut = free_name(docs, "cut_id"), free_name(docs, "cut")
    drops = runs.where(F.col("long") & (F.size("cut") > 0)).groupBy(F.col("doc_id").alias(key)).agg(F.flatten(F.collect_list("cut")).alias(cut))

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, begins: pd.Series, ends: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([t if a is None or t is None else without(t, a, b, d) for t, a, b, d in zip(texts, begins, ends, digests, strict=True)])

    joined = docs.join(drops, col(docs, id_col).cast("long") == F.col(key), "left")
    shorter = shorten(col(docs, text_col), F.col(cut)["begin"], F.col(cut)["end"], F.col(cut)["digest"])
    return joined.select(*[F.when(F.col(cut).isNull(), col(docs, c)).otherwise(shorter).alias(c) if c == text_col else col(docs, c) for c in docs.columns])
