"""Quality rules: base counts of a text, and bands of zstandard ratios over the whole text and fixed chunks.

A text that compresses far better than prose of its length repeats itself; one that hardly compresses is noise.
Short texts compress badly whatever they say, so limits go by length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from weft.llm.common import keep_texts, per_text, utf8


@dataclass(frozen=True)
class Bands:
    """Limits of the compressed size divided by the UTF-8 size.

    whole: (least bytes, lowest ratio, highest ratio), the last row whose least bytes the text reaches counts.
    A text is rejected outside its whole band, or if over ``bad_share`` of its bytes lie in chunks outside ``chunk``.
    A last chunk shorter than ``chunk_bytes / 4`` is judged together with the one before it; a text with a single
    chunk is judged as a whole only.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 99.0),
        (64, 0.45, 1.40),
        (128, 0.42, 1.10),
        (256, 0.59, 0.74),
        (384, 0.53, 0.72),
        (512, 0.51, 0.70),
        (768, 0.49, 0.64),
        (1024, 0.47, 0.59),
        (1536, 0.45, 0.56),
        (2048, 0.45, 0.54),
        (3072, 0.44, 0.51),
        (4096, 0.42, 0.49),
        (6144, 0.41, 0.47),
        (8192, 0.41, 0.47),
        (12288, 0.40, 0.46),
        (16384, 0.39, 0.44),
        (32768, 0.37, 0.44),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.43, 0.57)
    bad_share: float = 0.25
    level: int = 3


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = data.split()
    chars = len(data.translate(None, b" \t\n\r\v\f" + bytes(range(0x80, 0xC0))))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n = len(number)
    _, pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
    _, inverse, counts = np.unique(pair.astype(np.int64) * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def chunk_spans(n: int, size: int) -> list[tuple[int, int]]:
    starts = list(range(0, max(n, 1), size))
    if len(starts) > 1 and n - starts[-1] < size // 4:
        starts.pop()
    return [(a, b) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def compression(data: bytes, bands: Bands, compress: Callable[[bytes], bytes]) -> tuple[float | None, float, bool]:
    """Ratio of the whole text (None if empty), share of bytes in chunks outside the band, and whether all limits hold."""
    if not data:
        return None, 0.0, True
    ratio = len(compress(data)) / len(data)
    low, high = next((lo, hi) for least, lo, hi in reversed(bands.whole) if len(data) >= least)
    spans = chunk_spans(len(data), bands.chunk_bytes)
    bad = 0
    if len(spans) > 1:
        bad = sum(b - a for a, b in spans if not bands.chunk[0] <= len(compress(data[a:b])) / (b - a) <= bands.chunk[1])
    share = bad / len(data)
    return ratio, share, low <= ratio <= high and share <= bands.bad_share


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double"
)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One verdict row per row of ``df``: the id as ``doc_id``, the base counts, ``base_failed``, ``kept`` and the figures behind it.

    Null text counts as empty: no words, so the base rule fails.  Whole texts of any length are read.  Rows are judged
    alone, so repeated rows and null ids get their own verdict; an empty table gives no rows; other columns are not read.
    """

    return per_text(df, id_col, text_col, lambda: _judge(bands), SCHEMA)


def _judge(bands: Bands) -> Callable[[str | None], Iterable[tuple]]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=bands.level).compress

    def one(text: str | None) -> Iterable[tuple]:
        data = utf8(text)
        counts = base_counts(data)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        ratio, share, fine = compression(data, bands, compress)
        return [(*counts, failed, not failed and fine, ratio, share)]

    return one


def keep_good(df: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Rows of ``df``, all columns, that :func:`judge` keeps."""

    def make() -> Callable[[str | None], bool]:
        one = _judge(bands)
        return lambda text: one(text)[0][6]

    return keep_texts(df, text_col, make)


def op7_quality_bands(spark, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    return judge(table(spark, sf_dir, "documents"))
