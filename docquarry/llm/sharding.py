"""Sharding by global byte-size prefix sums.

Documents stand in one total order (text checksum, size, 64-bit hash, id), so that equal texts are neighbours. A cut can
fall inside a group of equal texts, as sizes would else not be near equal where a group is large. Each range partition
reports its total bytes; running sums of these totals give every partition its global start, a second pass adds the
sums inside the partition, and the global byte line is cut at equal targets into contiguous shards.

Only (id, size, checksum, hash) rows move, never texts. The driver sees one total per partition. Defined results: a null text
has no bytes (size 1, checksum 0); rows equal in all of these are placed one by one; an empty table gives an empty result; a document
larger than a target fills more than one shard's worth, so neighbouring shards may stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, size, text_crc32, law (``bytes``), shard, slot (position in the shard) and grown_shard (null).

    The shard of a document is the one in which the middle of its bytes falls on the global line.
    """
    text = F.coalesce(col(docs, text_col), F.lit(""))
    sized = docs.select(
        col(docs, id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("text_crc32", "size", "hash", "doc_id")
    ranged = cut_lineage(sized.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("hash"))
    ranged = ranged.withColumn("part", F.spark_partition_id())
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes")).toPandas().sort_values("part")  # a row per partition
    starts = dict(zip(totals["part"], np.concatenate([[0], np.cumsum(totals["bytes"])[:-1]]) if len(totals) else [], strict=True))
    total = int(totals["bytes"].sum())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for pdf in batches:
            if pdf.empty:
                continue
            at = int(starts[pdf["part"].iloc[0]]) if at is None else at
            size = pdf["size"].to_numpy(np.int64)
            ends = at + np.cumsum(size)
            at = int(ends[-1])
            # twice the middle of each document, in exact integers: numbers of bytes times shards stay far below 2**63
            shard = np.minimum((2 * ends - size) * shards // (2 * total), shards - 1)
            yield pdf.assign(shard=shard.astype(np.int32))

    cut = ranged.mapInPandas(place, "doc_id long, size long, text_crc32 long, part int, shard int")
    cut = cut_lineage(cut).withColumn("at", F.spark_partition_id())
    counts = cut.groupBy("at", "shard").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["at", "shard"])  # shards + partitions rows at most
    counts["first"] = counts.groupby("shard")["n"].cumsum() - counts["n"]
    firsts = {(int(a), int(s)): int(f) for a, s, f in zip(counts["at"], counts["shard"], counts["first"], strict=True)}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            part = int(pdf["at"].iloc[0])
            slot = pdf.groupby("shard").cumcount().to_numpy(np.int64)
            for s in pdf["shard"].unique():
                mine = (pdf["shard"] == s).to_numpy()
                slot[mine] += seen.get(int(s), firsts[part, int(s)])
                seen[int(s)] = int(slot[mine][-1]) + 1
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "size": pdf["size"], "text_crc32": pdf["text_crc32"], "law": "bytes", "shard": pdf["shard"], "slot": slot, "grown_shard": pd.Series([None] * len(pdf), dtype="Int32", index=pdf.index)}
            )

    return cut.mapInPandas(number, SCHEMA)
