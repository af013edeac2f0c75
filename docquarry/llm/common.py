"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case rules."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{uuid.uuid4().hex[:8]}"
    return name


def col(df: DataFrame, name: str) -> Column:
    """Column by its literal name, dots and blanks included."""
    return df["`" + name.replace("`", "``") + "`"]


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: ``spark.checkpoint.dir`` if the session has it, else one set before, else
    a new local one, in sessions of a single machine such as tests. On a cluster that names none this is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that a lost executor costs no recomputation and the partition layout is fixed."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def hash_fraction(id_col: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for each id, independent of ``crc_mod``."""
    return F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


@functools.cache
def newer_characters() -> str:
    """A character class of the letters and numbers that the regex module knows and Python's own Unicode tables don't. The
    tokenizer libraries have older tables as well and take these characters for unassigned ones."""
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    newer = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c)[0] not in "LN"]
    starts = [c for i, c in enumerate(newer) if not i or newer[i - 1] != c - 1]
    ends = [c for i, c in enumerate(newer) if i + 1 == len(newer) or newer[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


class Finder:
    """Tells whether a text holds one of some characters, none of them printable ASCII or Latin: a quick look for anything
    else comes first."""

    quick = re.compile("[^\t-\r\x20-\u024f]")

    def __init__(self, characters: str):
        self.full = re.compile(f"[{characters}]")

    def __call__(self, text: str) -> bool:
        found = self.quick.search(text)
        return found is not None and self.full.search(text, found.start()) is not None


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system. Spark keeps idle workers, and the allocators keep their
    pages, while the executor's JVM needs room for the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives back its memory when its task ends."""

    @functools.wraps(run)
    def ending(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ending


def slices_by_bytes(texts: pd.Series, limit: int = 4 << 20) -> Iterator[pd.Series]:
    """Consecutive pieces of a batch of about ``limit`` characters each, one text at least; bounds the Python objects alive at once."""
    size = texts.str.len().fillna(0).to_numpy(dtype=np.int64)
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield texts.iloc[start:i]
            start, total = i, 0
        total += int(n)
    if start < len(texts):
        yield texts.iloc[start:]


def sorted_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Groups of sorted rows (key, columns as arrays), also where batches cut them; holds one group and one batch."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = rest[keys].to_numpy(np.int64)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(cuts):
            columns = {c: rest[c].to_numpy() for c in rest.columns}
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                yield tuple(k[a].tolist()), {c: v[a:b] for c, v in columns.items()}
            rest = rest.iloc[cuts[-1] :].reset_index(drop=True)
    if rest is not None:
        yield tuple(rest[keys].iloc[0].tolist()), {c: rest[c].to_numpy() for c in rest.columns}
