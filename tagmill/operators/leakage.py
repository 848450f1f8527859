"""Passages that documents share with a set of items: hashes first, words only where a hash hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.written import cut

#: Bits for each item hash in the Bloom filter and places each sets; the largest filter that is broadcast. With more
#: items all hashes of the documents meet the items' in a join instead.
BITS, PLACES, LARGEST = 16, 4, 1 << 29


def plain_words(text: str = "text") -> Column:
    """``text`` in lower case, white space runs as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(F.col(text), F.lit("")), "\n\t\r", "   ")), " +", " "))


class _Hashes(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[str], n: int, known: _Hashes) -> np.ndarray:
    """A 64-bit hash of each ``n`` words in a row."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    own = np.fromiter((known[w] for w in words), np.uint64, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = (total ^ own[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


class Bloom:
    """A Bloom filter of 64-bit hashes; its size comes from their number."""

    def __init__(self, hashes: np.ndarray):
        self.mask = np.uint64((1 << max(10, (len(hashes) * BITS - 1).bit_length())) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        for at in self._places(hashes):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for i in range(PLACES):
            yield (hashes + np.uint64(i) * step) & self.mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            found &= (self.bits.take((at >> np.uint64(3)).view(np.int64)) >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _hashed(rows: DataFrame, key: str, n: int, bloom=None) -> DataFrame:
    """(key, hash, place) of the ``n``-word shingles of ``rows`` (key, said), only those that the filter may hold."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                owners, hashes, places = [], [], []
                for i, said in enumerate(part.column(1).to_pylist()):
                    found = shingle_hashes(said.split(" "), n, known) if said else np.empty(0, np.uint64)
                    at = np.nonzero(bloom.value.holds(found))[0] if bloom else np.arange(len(found))
                    owners.append(np.full(len(at), i))
                    hashes.append(found[at])
                    places.append(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], [key, "hash", "place"])

    return rows.mapInArrow(run, f"`{key}` {kind}, hash long, place int")


def shared_passages(docs: DataFrame, items: DataFrame, key: str, item_key: str, n: int = 5) -> DataFrame:
    """(key, item_key, said): each passage of ``n`` words in a row that a text of ``docs`` (key, text) shares with one of ``items`` (item_key, text).

    First only (key, hash, place) of shingles whose hash a Bloom filter of the items' hashes holds leave the texts; the
    filter is sized from their number and broadcast up to LARGEST bits, beyond which all hashes are joined. Hashes that are an item's
    send their places back to their texts, and the words there are compared. Each passage is given once for a key and
    item; texts of fewer words have none; null keys are left out; no row gives no row.
    """
    spark = docs.sparkSession
    told = docs.filter(F.col(key).isNotNull()).select(key, plain_words().alias("said"))
    listed = items.filter(F.col(item_key).isNotNull()).select(item_key, plain_words().alias("said"))
    slices = lambda c: F.transform("places", lambda i: F.array_join(F.slice(c, i + 1, F.lit(n)), " "))
    words = lambda rows, owner, places: rows.join(places.withColumnRenamed(owner, "_owner"), F.col(owner) == F.col("_owner")).select(owner, F.explode(slices(F.split("said", " "))).alias("said"))
    known = cut(_hashed(listed, item_key, n), "item_hashes")
    distinct = known.select("hash").distinct()
    count = distinct.count()
    bloom = None
    if count * BITS <= LARGEST:
        bloom = spark.sparkContext.broadcast(Bloom(distinct.toArrow().column("hash").to_numpy().view(np.uint64)))
    hits = cut(_hashed(told, key, n, bloom).join(distinct, "hash", "left_semi").groupBy(key).agg(F.collect_set("place").alias("places")), "hits")
    theirs = words(told, key, hits).distinct()
    own = words(listed, item_key, known.groupBy(item_key).agg(F.collect_set("place").alias("places"))).distinct()
    return theirs.join(own, "said").select(key, item_key, "said")
