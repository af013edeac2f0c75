"""Quality rules: compression bands.

Zstandard ratios (bytes before / bytes after) are taken of the whole document and of its fixed-size chunks. Repetitive
text compresses too well and random text too badly; both limits depend on the length, because the frame header and the
cold window weigh more on short inputs.

Defined results: a null text counts as the empty text (no words, so it fails the base rule and isn't kept); ids may be
null or repeated, each row is judged by itself; other columns of the input are neither read nor clash with the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, col, encoded

#: (longest length in bytes, lowest ratio, highest ratio) of a whole document.
DOCUMENT_BANDS = (
    (64, 0.50, 1.60),
    (128, 0.75, 1.90),
    (256, 0.95, 2.60),
    (512, 1.10, 2.80),
    (1024, 1.20, 3.00),
    (2048, 1.30, 3.40),
    (4096, 1.40, 3.80),
    (8192, 1.45, 4.20),
    (16384, 1.45, 4.60),
    (1 << 62, 1.45, 5.00),
)
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class BandRules:
    """Limits of the verdict. ``chunk_bytes``: size of the fixed chunks (a last chunk under half of it has the band of a
    document as long, and one within the first band reaches back to a full chunk); ``chunk_band``: lowest and highest ratio of the others; ``bad_share``: largest share of chunks outside
    their band."""

    bands: tuple[tuple[int, float, float], ...] = DOCUMENT_BANDS
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = (1.35, 4.20)
    bad_share: float = 0.25
    level: int = 3

    def band(self, size: int) -> tuple[float, float]:
        return next((low, high) for most, low, high in self.bands if size <= most)


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words covered by ``width``-word windows that occur twice or more. Exact: window ids come from doubling pairs of
    dense ids, so equal ids mean equal words. ``width`` is a power of two."""
    n = len(words)
    if n <= width:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    step = 1
    while step < width:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(ids):
            return 0
        step *= 2
    repeated = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def ratios(raw: bytes, rules: BandRules, packer: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """Ratio of the whole text, number of chunks, and chunks outside their band."""
    whole = len(raw) / len(packer.compress(raw))
    size = rules.chunk_bytes
    if len(raw) <= size:
        return whole, 0, 0
    outside = chunks = 0
    for at in range(0, len(raw), size):
        part = raw[at : at + size]
        if len(part) <= rules.bands[0][0]:  # the frame alone outweighs so few bytes: with what stands before them
            part = raw[-size:]
        low, high = rules.chunk_band if 2 * len(part) >= size else rules.band(len(part))
        chunks += 1
        outside += not low <= len(part) / len(packer.compress(part)) <= high
    return whole, chunks, outside


def judge(text: str | None, rules: BandRules, packer: zstandard.ZstdCompressor) -> tuple:
    raw = encoded(text)
    words = raw.split()
    n_words = len(words)
    word_bytes = raw.translate(None, ASCII_SPACE)
    word_chars = len(word_bytes.decode("utf-8", "surrogatepass"))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_window_words(words)
    base_failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    whole, chunks, outside = ratios(raw, rules, packer) if raw else (0.0, 0, 0)
    low, high = rules.band(len(raw))
    in_band = low <= whole <= high and outside <= rules.bad_share * chunks
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, bool(not base_failed and in_band), whole, chunks, outside


FIELDS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "zstd_ratio": "double",
    "n_chunks": "long",
    "n_chunks_outside": "long",
}


def verdicts(rules: BandRules = BandRules()):
    """A column function: text -> struct of ``FIELDS``."""

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in FIELDS.items()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for texts in batches:
            yield pd.DataFrame([judge(t, rules, packer) for t in texts], columns=list(FIELDS))

    return run


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: BandRules = BandRules()) -> DataFrame:
    """One row per input row: the id, then ``FIELDS``. No shuffle; each row is judged by itself."""
    found = docs.select(col(docs, id_col).alias("doc_id"), verdicts(rules)(col(docs, text_col)).alias("v"))
    return found.select("doc_id", "v.*")
