"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Text that repeats itself
compresses too well, noise hardly at all; what is normal depends on the length, so each length has
a band of its own. A document is rejected if its whole ratio leaves the band of its length or if
more than ``BAD_CHUNKS`` of its bytes lie in chunks that leave their band. What remains after the full
chunks is a chunk too: as it is it has the band of its length, and with the bytes before it, as the last
``CHUNK`` bytes, the band of chunks; it counts with its own bytes. Plain counts, independent of
compression, come with it and reject by themselves.

Defined cases: null is the empty text; it has no words and fails the base rules; texts are read
whole, long ones chunk by chunk besides; repeated rows give equal rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import map_rows, text_of, words_of

LEVEL = 3
CHUNK = 4096
# at so many bytes: least ratio, between them by the logarithm of the length; none up to 64 bytes
LEAST = [
    (64, 0.8), (128, 0.9), (256, 1.15), (512, 1.32), (1024, 1.48), (2048, 1.68), (4096, 1.83), (8192, 1.98),
    (16384, 2.08), (65536, 2.2),
]
LEAST_OTHER = [(256, 0.8), (1024, 1.1), (4096, 1.25), (16384, 1.35)]
OTHER_SCRIPT = 0.4
# up to so many bytes: greatest ratio
MOST = [(64, 99.0), (256, 2.5), (1024, 2.8), (4096, 3.0), (16384, 3.2), (65536, 3.6), (float("inf"), 4.5)]
CHUNK_MOST = 3.2
BAD_CHUNKS = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_BLANK = " \t\n\r\x0b\x0c"
_ASCII = bytes(range(128))


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    size = len(known)
    pairs = codes[:-1] * size + codes[1:]
    if size >= 1 << 20:  # three codes don't fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def least_ratio(data: bytes) -> float:
    """Lower limit of the ratio for the length and script of ``data``."""
    if len(data) <= 64:
        return 0.0
    other = len(data.translate(None, _ASCII)) > OTHER_SCRIPT * len(data)
    sizes, limits = zip(*(LEAST_OTHER if other else LEAST), strict=True)
    return float(np.interp(np.log2(len(data)), np.log2(sizes), limits))


def compression_verdict(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks outside their band, verdict."""
    if not data:
        return 0.0, 0.0, False

    def tested(part: bytes, most: float) -> tuple[float, bool]:
        ratio = len(part) / len(compressor.compress(part))
        return ratio, least_ratio(part) <= ratio <= most

    def most_ratio(size: int) -> float:
        return next(high for most, high in MOST if size <= most)

    ratio, good = tested(data, most_ratio(len(data)))
    full = len(data) - len(data) % CHUNK
    bad = sum(CHUNK for at in range(0, full, CHUNK) if not tested(data[at : at + CHUNK], CHUNK_MOST)[1])
    rest = data[full:]
    if not full:  # the rest is the whole text
        bad = 0 if good else len(rest)
    elif rest and not (tested(rest, most_ratio(len(rest)))[1] and tested(data[-CHUNK:], CHUNK_MOST)[1]):
        bad += len(rest)
    share = bad / len(data)
    return ratio, share, good and share <= BAD_CHUNKS


def quality_bands(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Base counts, base_failed, kept, and the ratio and share of bytes in bad chunks behind the verdict."""

    def build():
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def one(text: str):
            words = words_of(text)
            lines = [line for line in text.split("\n") if line.strip(_BLANK)]
            n, repeated = len(words), repeat_words(words)
            failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
            ratio, share, good = compression_verdict(text.encode(), compressor)
            symbols = sum(map(text.count, "#*$%&|<>"))
            return (
                n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, failed, not failed and good,
                ratio, share,
            )

        def step(rows):
            made = dict(zip(names, zip(*map(one, rows["text"]), strict=True), strict=True))
            return {"doc_id": rows["doc_id"], **made}

        return step

    names = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio",
        "bad_chunks",
    ]
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2
    schema = "doc_id long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_rows(slim, schema, build)
