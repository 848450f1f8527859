"""What the operators share: small slices of Arrow batches, the word rule and 64-bit mixing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch: Spark's own default, and what the operators ask for where that is untouched.
DEFAULT_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bytes of an Arrow batch, unless its user has chosen a number; rows are left to the user.

    A frame is planned when its result is asked for, so the setting can't be put back before. It changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(DEFAULT_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """``batches`` in pieces of few rows, so that what a task makes of them stays small; a batch goes before the next one comes."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        del batch


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(col: Column) -> Column:
    """crc32(doc_id as text) mod 4; rows of remainder 2 are held out."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher on unsigned 64-bit values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashCache(dict):
    """64-bit hashes of byte words, remembered up to ``most`` words at a time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text: str | None) -> bytes:
    """The text in UTF-8, A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8: bytes.split() cuts at exactly those six characters."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()
