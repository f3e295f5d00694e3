"""Quality rules: compression bands.

Prose compresses better the longer it is. A text is kept if its zstandard ratio (bytes in by bytes out) lies within a band around what
prose of its length reaches, and if no more than a fifth of its fixed chunks lie outside the band of the chunk's length. Ratios above a
band mean repetitive text, below it incompressible text (encoded or random data).

The middle of the bands is interpolated between the lengths of ``PROSE``, on a logarithmic scale; beyond its ends the nearest holds.
The band reaches from ``LOW`` to ``HIGH`` times that. Texts in scripts with several bytes a character repeat their leading bytes, so
the upper limit grows with the mean bytes a code point. Texts of fewer than ``LEAST`` bytes have no limits, as their ratio says little,
and chunks under half the chunk size don't count.

Beside the bands stand base counts over words (runs without ASCII white space), lines and three-word windows. Defined cases: null
and empty texts have all counts 0 and fail the base rule; each row is judged alone, so ties and repeated rows don't matter; very long
texts are compressed whole and in all their chunks; an empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from ..session import ship

#: Length in bytes and the ratio that prose reaches there, at this level.
PROSE = ((256, 1.50), (512, 1.68), (1024, 1.86), (2048, 2.03), (4096, 2.14), (8192, 2.24), (16384, 2.32), (32768, 2.40), (65536, 2.48), (262144, 2.60), (1048576, 2.70))
LOW, HIGH, LEAST = 0.78, 1.10, 256
CHUNK, CHUNK_SHARE, LEVEL = 2048, 0.2, 3
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\f\r"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        count = Counter(grams)
        if len(count) < len(grams):
            hit = np.fromiter((count[g] > 1 for g in grams), dtype=bool, count=len(grams))
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : k + len(hit)] |= hit
            repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


def band(size: int, width: float = 1.0) -> tuple[float, float]:
    """Least and largest ratio of a text of ``size`` bytes, with ``width`` bytes a code point."""
    if size < LEAST:
        return 0.0, float("inf")
    middle = float(np.interp(np.log2(size), [np.log2(n) for n, _ in PROSE], [r for _, r in PROSE]))
    return LOW * middle, HIGH * middle * width


def in_bands(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """The whole ratio, the number of chunks, how many of them lie outside, and the verdict."""
    if not raw:
        return 0.0, 0, 0, False
    width = len(raw) / (len(raw) - np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80) or 1)
    ratio = len(raw) / len(compressor.compress(raw))
    low, high = band(len(raw), width)
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) >= CHUNK else []
    out = count = 0
    for c in chunks:
        if len(c) >= CHUNK // 2:
            least, most = band(len(c), width)
            count += 1
            out += not least <= len(c) / len(compressor.compress(c)) <= most
    return ratio, count, out, low <= ratio <= high and out <= CHUNK_SHARE * count


def judge_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and the ratio and chunk counts behind the verdict."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                counts = base_counts(text)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                ratio, chunks, out, good = in_bands(text.encode("utf-8", "surrogatepass"), z)
                rows.append((doc_id, *counts, failed, good and not failed, ratio, chunks, out))
            got = pd.DataFrame(rows, columns=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_chunks_outside"])
            yield got.assign(doc_id=pdf["doc_id"].values)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks int, n_chunks_outside int"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
