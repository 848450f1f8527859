"""Quality rules: word counts, repetition counts and compression bands.

A text that repeats itself compresses too well, one of random characters too badly. zstandard's ratio (compressed bytes
through bytes) of the whole text, and of its fixed chunks, must lie in a band; the band of the whole text depends on its
length, because short texts carry the frame's overhead and long ones find more matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import bounded_batches, byte_words, slices

#: (UTF-8 bytes from, lowest ratio, highest ratio); short texts carry the frame's bytes besides.
BANDS = ((0, 0.42, 1.4), (128, 0.42, 1.05), (256, 0.42, 0.86), (512, 0.42, 0.78), (1024, 0.42, 0.72), (2048, 0.42, 0.68), (4096, 0.405, 0.66), (8192, 0.395, 0.66), (16384, 0.38, 0.66), (32768, 0.36, 0.66))
#: Bytes of a chunk, its band, and the share of chunks outside the band from which a text is rejected.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 1024, (0.36, 0.85), 0.25
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\v\f\r"
_FROM = np.array([b[0] for b in BANDS])

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, bad_chunks long, n_chunks long, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that occurs twice or more, its first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 1 << 20:  # else the product of three numbers fits 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = count[where] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(ids) - 2 + i] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def compression(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio, chunks outside their band, chunks, whether both bands hold); an empty text has ratio 1 and passes."""
    if not raw:
        return 1.0, 0, 0, True
    ratio = len(press.compress(raw)) / len(raw)
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw) - CHUNK + 1, CHUNK)]
    if len(chunks) * CHUNK < len(raw) and chunks:
        chunks.append(raw[-CHUNK:])  # the last chunk ends with the text, so no byte is left out
    low, high = CHUNK_BAND
    bad = sum(not low <= len(press.compress(c)) / CHUNK <= high for c in chunks)
    k = int(np.searchsorted(_FROM, len(raw), "right")) - 1
    fits = BANDS[k][1] <= ratio <= BANDS[k][2]
    return ratio, bad, len(chunks), bool(fits and (not chunks or bad < CHUNK_SHARE * len(chunks)))


def judge(text: str | None, press: zstandard.ZstdCompressor) -> tuple:
    """One row of METRICS."""
    text = text or ""
    words, raw = byte_words(text), text.encode("utf-8", "surrogatepass")
    n, repeat = len(words), repeated_words(words)
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    ratio, bad, chunks, fits = compression(raw, press)
    failed = n < 50 or 100 * repeat > 50 * n
    return n, chars, symbols, duplicate_lines(text), repeat, len(raw), ratio, bad, chunks, failed, fits and not failed


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in METRICS.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in METRICS.split(", ")]
    for batch in slices(batches):
        found = list(zip(*(judge(t, press) for t in batch.column(1).to_pylist()), strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], ["doc_id", *names])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id (as it came) and METRICS.

    Null and empty texts have no words and fail the base rule. Ties and repeated rows are judged each for itself; extra
    columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_rows, f"doc_id long, {METRICS}")


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they came, in one pass without a shuffle.

    Null and empty texts fail; texts are judged whole; equal and repeated rows stay or go together; rows without an id are
    judged; columns of any name are kept; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches):
            yield batch.filter(pa.array([bool(judge(t, press)[-1]) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
