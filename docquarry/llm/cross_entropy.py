"""Language-model scoring by cross-entropy difference.

Two n-gram models of the same order, smoothing and vocabulary, one of target text and one of background text, code every
document; the score is the mean difference of the losses per token, in bits. Low scores mark text that is more like the
target than like the corpus at large. Tokens are UTF-8 bytes, so the vocabulary is closed and the same for both; both models
are columns of one table of byte strings (see ``ppm_language.PPM``: back-off with Witten-Bell escapes).

The target model counts all target documents, the background model every document, targets included; what is compared are
conditional probabilities, so the two need not be of one size. Counting is pre-aggregated in each task and summed by Spark
over the whole corpus, so what is gathered grows with it. The model stays a table of all counts: each slice of the texts
asks for its distinct strings, joins give their costs under both models, and a slice is scored with the costs that it asked
for. No machine holds the model. ``max_grams`` makes a bounded one for shipping instead: of the longest strings the
most frequent stay (whole classes of equal frequency), the others back off to shorter ones.

Defined results: a null or empty text has n_tokens 0 and null losses; without any target text all losses are null; rows
are scored one by one, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, encoded, slices_by_bytes
from .ppm_language import PPM, grams

SIDES = ["target", "background"]
LOSSES = "n_tokens long, target_loss double, background_loss double"


@dataclass
class GramTable:
    """Both models as a table that grows with the corpus: (key, target, background), a row per string of order + 1 bytes."""

    order: int
    counts: DataFrame


def count_grams(rows: DataFrame, order: int, held: int = 4 << 20) -> DataFrame:
    """(key, target, background): how often each byte string occurs on either side. ``rows``: text, in_target, in_background."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        total = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros((len(key), 2), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            return key, n

        for pdf in batches:
            for (first, second), group in pdf.groupby(["in_target", "in_background"]):
                for part in slices_by_bytes(group["text"], 1 << 20):
                    key, n = np.unique(grams([encoded(t) for t in part], order), return_counts=True)
                    keys.append(key)
                    counts.append(np.stack([n * bool(first), n * bool(second)], axis=1))
                    total += len(key)
                    if total > held:
                        key, n = summed()
                        if len(key) > held // 2:
                            yield pd.DataFrame({"key": key, "target": n[:, 0], "background": n[:, 1]})
                            keys, counts, total = [], [], 0
                        else:
                            keys, counts, total = [key], [n], len(key)
        if keys:
            key, n = summed()
            yield pd.DataFrame({"key": key, "target": n[:, 0], "background": n[:, 1]})

    found = rows.mapInPandas(run, "key long, target long, background long")
    return found.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def learn_pair(docs: DataFrame, targets: DataFrame, order: int = 4, max_grams: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> GramTable | PPM | None:
    """``targets``: its first column holds the ids of the target documents. All counts as a table, or with ``max_grams`` a
    PPM of so many strings of full length. None if there is no target text."""
    ids = targets.select(col(targets, targets.columns[0]).alias("id")).where("id is not null").distinct().withColumn("in_target", F.lit(True)).hint("merge")
    text = col(docs, text_col)
    texts = docs.where(text.isNotNull() & (text != "")).select(col(docs, id_col).alias("id"), text.alias("text"))
    marked = texts.join(ids, "id", "left").select("text", F.coalesce("in_target", F.lit(False)).alias("in_target"), F.lit(True).alias("in_background"))
    if marked.where("in_target").isEmpty():
        return None
    counts = cut_lineage(count_grams(marked, order))
    if max_grams is None:
        return GramTable(order, counts)
    # the lowest frequency class that still fits; classes are powers of two, so this is a few dozen rows
    classes = counts.groupBy(F.floor(F.log2(F.col("target") + F.col("background"))).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 1 << 62, 0
    for row in sorted(classes, reverse=True):
        total += row["n"]
        if total > max_grams:
            break
        least = 1 << int(row["c"])
    long = counts.where(F.col("target") + F.col("background") >= least).toPandas().sort_values("key")
    key = long["key"].to_numpy(np.int64)
    # shorter strings keep the counts of the longer ones that were left out
    mask = (1 << 8 * order) - 1
    short = counts.where(F.col("target") + F.col("background") < least).groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key"))
    rest = short.agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toPandas()
    return PPM.learn_sides(SIDES, order, key, long[SIDES].to_numpy(np.float64), rest["key"].to_numpy(np.int64), rest[SIDES].to_numpy(np.float64))


def with_costs(needed: DataFrame, model: GramTable) -> DataFrame:
    """``needed`` (key and others) with target_bits and background_bits: what the last byte of a string costs after the others.
    Strings of up to two bytes, and contexts as long, are few enough to broadcast."""
    counts, levels = model.counts, []
    for depth in range(model.order + 1, 0, -1):
        mine, context, sides = f"key_{depth}", f"context_{depth}", [f"{s}_{depth}" for s in SIDES]
        if depth <= model.order:
            counts = cut_lineage(counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * depth) - 1)).alias("key")).agg(*[F.sum(s).alias(s) for s in SIDES]))
        own = counts.select(F.col("key").alias(mine), *[F.col(s).alias(n) for s, n in zip(SIDES, sides, strict=True)])
        sums = [x for s, n in zip(SIDES, sides, strict=True) for x in (F.sum(s).alias(f"{n}_total"), F.count_if(F.col(s) > 0).alias(f"{n}_kinds"))]
        above = counts.groupBy(F.shiftright("key", 8).alias(context)).agg(*sums)
        needed = needed.withColumn(mine, F.col("key").bitwiseAND(F.lit((1 << 8 * depth) - 1))).withColumn(context, F.shiftright(mine, 8))
        needed = needed.join(F.broadcast(own) if depth <= 2 else own, mine, "left").join(F.broadcast(above) if depth <= 3 else above, context, "left").drop(mine, context)
        levels.insert(0, sides)

    def bits(side: int) -> Column:
        cost = F.lit(8.0)
        for sides in levels:
            n, total, kinds = (F.coalesce(F.col(sides[side] + end), F.lit(0)) for end in ("", "_total", "_kinds"))
            leave = F.when(total > 0, -F.log2(kinds / (total + kinds))).otherwise(0.0)
            cost = F.when(n > 0, -F.log2(n / (total + kinds))).otherwise(leave + cost)
        return cost

    return needed.select("*", *[bits(i).alias(f"{s}_bits") for i, s in enumerate(SIDES)]).drop(*[n + end for sides in levels for n in sides for end in ("", "_total", "_kinds")])


def table_losses(texts: DataFrame, model: GramTable, slice_bytes: int = 8 << 20, least_bytes: int = 1 << 20) -> DataFrame:
    """``texts`` (doc_id, text) to doc_id and ``LOSSES``. Rows are dealt into slices by a hash of both: of ``slice_bytes``, or
    smaller ones while there are fewer than shuffle partitions, as each slice asks for its common strings anew."""
    order = model.order
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0  # one row
    slices = max(1, -(-size // slice_bytes), min(-(-size // least_bytes), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = texts.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int")).repartition(slices, "slice")

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, group in pdf.groupby("slice"):
                for part in slices_by_bytes(group["text"], 1 << 20):
                    key = np.unique(grams([encoded(t) for t in part], order))
                    held[k] = np.union1d(held[k], key) if k in held else key
        for k, key in held.items():
            yield pd.DataFrame({"slice": np.full(len(key), k, np.int32), "key": key})

    needed = dealt.mapInPandas(strings, "slice int, key long").groupBy("key").agg(F.collect_list("slice").alias("slices"))
    costs = with_costs(needed, model).select(F.explode("slices").alias("slice"), "key", "target_bits", "background_bits")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        by_key = right.sort_by("key") if right.num_rows else right
        keys = by_key["key"].to_numpy()
        bits = np.stack([by_key[f"{s}_bits"].to_numpy() for s in SIDES], axis=1)
        sizes, means = [], []
        for part in slices_by_bytes(left["text"].to_pandas(), 1 << 20):
            raws = [encoded(t) for t in part]
            n = np.array([len(r) for r in raws], np.int64)
            mean = np.full((len(raws), 2), np.nan)
            full = np.flatnonzero(n)
            if len(full):
                asked = grams([raws[i] for i in full], order)
                at = np.searchsorted(keys, asked)
                mean[full] = np.add.reduceat(bits[at], np.cumsum(n[full]) - n[full], axis=0) / n[full, None]
            sizes.append(n)
            means.append(mean)
        mean = np.concatenate(means)
        return pa.table({"doc_id": left["doc_id"], "n_tokens": np.concatenate(sizes), "target_loss": mean[:, 0], "background_loss": mean[:, 1]})

    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {LOSSES}"
    # a slice without any string has no costs and still its rows
    return dealt.groupBy("slice").cogroup(costs.groupBy("slice")).applyInArrow(score, schema)


def losses_udf(docs: DataFrame, model: PPM | None):
    """A column function: text -> ``LOSSES`` (bits per token)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_grams

    @F.pandas_udf(LOSSES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        walker = shared.value.walker() if shared.value else None
        for texts in batches:
            out = []
            for part in slices_by_bytes(texts, 1 << 20):
                raws = [encoded(t) for t in part]
                sizes = np.array([len(r) for r in raws], np.int64)
                mean = np.full((len(raws), 2), np.nan)
                full = np.flatnonzero(sizes)
                if walker is not None and len(full):
                    mean[full] = walker.bits([raws[i] for i in full]) / sizes[full, None]
                out.append(pd.DataFrame({"n_tokens": sizes, "target_loss": mean[:, 0], "background_loss": mean[:, 1]}))
            yield pd.concat(out) if out else pd.DataFrame({"n_tokens": [], "target_loss": [], "background_loss": []})

    return run


def cross_entropy_difference(docs: DataFrame, model: GramTable | PPM | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, target_loss, background_loss and score, their difference."""
    texts = docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"))
    if isinstance(model, GramTable):
        found = table_losses(texts, model)
    else:
        found = texts.select("doc_id", losses_udf(docs, model)("text").alias("v")).select("doc_id", "v.*")
    for c in ("target_loss", "background_loss"):
        found = found.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))
