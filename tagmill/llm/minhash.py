"""Near-duplicate groups by SuperMinHash: signatures, banding, verification on full sets, union of links.

A document's set holds its distinct word shingles. Documents with one set form a class; only its smallest doc_id goes
on, so copies never meet each other in a bucket. Each class gets a SuperMinHash signature (Ertl 2017): every element
draws a random permutation of the ``m`` slots and puts ``step + fraction`` into the slot it reaches at each step; a slot
keeps its minimum. The steps are taken for all elements at once and end for a document as soon as no slot can fall any
more, mostly after the second. Bands of six slots make bucket keys. Inside a bucket the members are compared with
a pivot (a star, not all pairs), the verified links are united, and only members outside the bucket's largest component
go on: each meets the whole bucket, in blocks, whatever the bucket's size.

Links are verified on full sets of 64-bit shingle hashes by Spark's own array functions. With 42 bands of 6 slots a pair
at similarity 0.8 misses every bucket with probability 3e-6. In a block, pairs whose sketches, least elements of bins that
sample the union without replacement, share too little are not verified: at 5.5 standard errors that loses about
1e-7 of the pairs at exactly 0.8, far less than the banding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import HashCache, bounded_batches, lowered, mix64, slices
from tagmill.operators.graph import components
from tagmill.written import cut, forget

#: Slots of a signature, slots of a band.
SLOTS, ROWS = 252, 6
#: Rows of a block on either side when such members meet their bucket, and the standard errors a sketch may fall short by.
BLOCK, ERRORS = (256, 1024), 5.5
#: Bins of a sketch.
BINS = 512
#: Elements whose steps are taken together, and bytes of a text that are cut into words at a time.
_CHUNK, _PIECE = 1 << 15, 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def word_runs(text: str | None) -> Iterator[list[bytes]]:
    """The text's lower-cased words in order, those of about _PIECE bytes at a time."""
    raw = lowered(text)
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, min(at + _PIECE, len(raw)))
        end = gap.end() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def shingle_hashes(text: str | None, words: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``words`` lower-cased words; fewer words make one shingle, none an empty set."""
    w = np.concatenate([np.fromiter(map(cache.__getitem__, found), np.uint64, len(found)) for found in word_runs(text)] or [np.empty(0, np.uint64)])
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix64(h ^ w[i : len(w) - k + 1 + i])
    return np.unique(h)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set, one row of ``slots`` values; an entry is ``step << 32 | fraction``. Empty sets keep the largest value.

    Small sets are taken together, a large one piece by piece into the same row: minima don't care, and a row that is
    nearly filled ends the steps of later pieces early. So no more than _CHUNK elements have their permutations open.
    """
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        if end == start + 1:
            for a in range(0, len(sets[start]), _CHUNK):
                _fill(sig[start:end], [sets[start][a : a + _CHUNK]], slots)
        else:
            _fill(sig[start:end], sets[start:end], slots)
        start = end
    return sig


def _fill(sig: np.ndarray, sets: list[np.ndarray], slots: int) -> None:
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, order, rank = sig.reshape(-1), None, None
    for step in range(slots):
        if not len(element):
            return
        draw = mix64(element + _U((step + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        swap = step + (((draw & _U(0xFFFFFFFF)) * _U(slots - step)) >> _U(32)).astype(np.int64)
        if order is None:  # a permutation is the identity until its first swap
            order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(element), slots)).copy()
            rank = np.arange(len(element))
        slot = order[rank, swap]
        order[rank, swap] = order[:, step]
        np.minimum.at(flat, doc * slots + slot, (_U(step) << _U(32)) | (draw >> _U(32)))
        open_docs = sig.max(axis=1) >= _U(step + 1) << _U(32)
        keep = open_docs[doc]
        if not keep.all():
            element, doc, order = element[keep], doc[keep], order[keep]
            rank = np.arange(len(element))


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` slots; the band's number is part of it."""
    bands = sig.shape[1] // rows
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    part = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    for i in range(rows):
        key = mix64(key ^ part[:, :, i])
    return key


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each of BINS bins that the elements fall into: 0 for an empty bin, else of the bin's least element.

    The least elements of the bins of a union are a random subset of it, of known size; two sets share the byte where
    theirs is in both, and by chance with probability 1/255.
    """
    drawn = mix64(hashes ^ _U(0xA0761D6478BD642F))
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (drawn % _U(BINS)).astype(np.int64), drawn)
    return np.where(least == np.iinfo(np.uint64).max, 0, 1 + (least >> _U(32)) % _U(255)).astype(np.uint8).tobytes()


def _alike(mark: np.ndarray, marks: np.ndarray, n: int, ns: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``marks`` share as many bins with ``mark`` as a pair at ``percent`` does, but for ERRORS standard errors and one.

    Shared bins are drawn without replacement from the union, whose size the sets' sizes ``n`` and ``ns`` give at ``percent``;
    a union that fills more bins than it could have elements is no link.
    """
    share = percent / 100
    filled = ((marks != 0) | (mark != 0)).sum(axis=1)
    union = np.maximum((n + ns) / (1 + share), 2.0)
    spread = filled * share * (1 - share) * np.maximum(union - filled, 0.0) / (union - 1)
    return ((marks == mark) & (mark != 0)).sum(axis=1) >= share * filled - ERRORS * np.sqrt(spread) - 1


def _lists(matrix: np.ndarray) -> pa.Array:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(matrix.reshape(-1).view(np.int64)))


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in slices(batches):
            sets = [shingle_hashes(t, words, cache) for t in batch.column(1).to_pylist()]
            sig = signatures(sets)
            k1 = np.array([int(mix64(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            k2 = np.array([int(mix64(~s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), _lists(band_keys(sig)), pa.array(map(sketch, sets), pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in slices(batches):
            sets = [shingle_hashes(t, words, cache) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach ``percent`` hundredths of Jaccard similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .filter(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        .filter(100 * common >= percent * (na + nb - common))
        .select("a", "b")
    )


def _united(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of ``edges`` (a, b)."""
    return components(edges).withColumnRenamed("component", "comp")


class _Groups:
    """Components found so far; links are added between components only."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent, self.sketches, self.sets, self.labels = docs, words, percent, sketches, None, None

    def load(self, ids: DataFrame) -> None:
        """Build the full sets of the documents named in ``ids``; no other text is needed again."""
        texts = self.docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        self.sets = cut(texts.mapInArrow(_set_rows(self.words), "id long, shingles array<long>"), "sets")

    def comp(self, frame: DataFrame, column: str, to: str) -> DataFrame:
        """``frame`` with the component of ``column`` as ``to``."""
        if self.labels is None:
            return frame.withColumn(to, F.col(column))
        labels = self.labels.select(F.col("id").alias(column), F.col("comp").alias("_comp"))
        return frame.join(labels, column, "left").withColumn(to, F.coalesce("_comp", column)).drop("_comp")

    def add(self, pairs: DataFrame, label: str) -> None:
        """Verify ``pairs`` (a, b) whose ends are in different components, and unite what passes."""
        apart = self.comp(self.comp(pairs, "a", "ca"), "b", "cb").filter("ca != cb").select("a", "b")
        self.unite(cut(_verified(apart, self.sets, self.percent), label))

    def unite(self, found: DataFrame) -> None:
        """Take the links ``found`` (a, b) as they are."""
        if found.isEmpty():
            return
        if self.labels is None:
            self.labels = _united(found)
            return
        merged = _united(self.comp(self.comp(found, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        known = self.labels.select("id", F.col("comp").alias("c"))
        fresh = merged.select("id", F.col("id").alias("c")).join(known.select("id"), "id", "left_anti")
        to = merged.select(F.col("id").alias("c"), "comp")
        self.labels = cut(known.union(fresh).join(to, "c", "left").select("id", F.coalesce("comp", "c").alias("comp")), "united")


def _similar_size(percent: int):
    """Sets whose sizes differ more can't reach ``percent``."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _meetings(placed: DataFrame, apart: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components, similar by their sketches: in each bucket of ``apart`` the members outside its largest component against all.

    Both sides are dealt into blocks, and the pairs of a block are compared inside one task, so what leaves it are the
    likely links and not the pairs looked at; a bucket's size is bounded by its blocks only. A pair is told in the first
    bucket that it shares only, by the true band keys.
    """
    most_a, most_b = BLOCK
    sized = apart.select("key", "major", F.ceil(F.col("others") / most_a).cast("int").alias("na"), F.ceil(F.col("members") / most_b).cast("int").alias("nb"))
    rows = placed.join(sized, "key").join(sketches, "id")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.hash("id"), F.col(n))
    outside = rows.filter("comp != major").select("key", own("na").alias("ba"), F.explode(spread("nb")).alias("bb"), F.lit(0).alias("side"), "id", "n", "comp", "sketch", "bands")
    everyone = rows.select("key", F.explode(spread("na")).alias("ba"), own("nb").alias("bb"), F.lit(1).alias("side"), "id", "n", "comp", "sketch", "bands")
    blocks = outside.union(everyone).repartition("key", "ba", "bb").sortWithinPartitions("key", "ba", "bb", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            same = np.ones(len(batch) + 1, bool)
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            same[1:-1] = (keys[:, 1:] != keys[:, :-1]).any(0)
            if held and len(batch):
                last = [held[-1].column(i)[-1].as_py() for i in range(3)]
                if last != keys[:, 0].tolist():
                    yield _likely(held, percent)
                    held = []
            edges = np.flatnonzero(same)
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                held.append(batch.slice(a, b - a))
                if k < len(edges) - 2:
                    yield _likely(held, percent)
                    held = []
        if held:
            yield _likely(held, percent)

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _likely(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """Pairs of one block whose sketches, sizes and components allow a link."""
    t = pa.Table.from_batches(parts).combine_chunks()
    side, ids, n, comp = (t.column(c).to_numpy() for c in ("side", "id", "n", "comp"))
    mark = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    key = t.column("key")[0].as_py()
    b, found = np.flatnonzero(side == 1), []
    for i in np.flatnonzero(side == 0):
        fits = b[(comp[b] != comp[i]) & (100 * np.minimum(n[b], n[i]) >= percent * np.maximum(n[b], n[i]))]
        if len(fits):
            near = _alike(mark[i], mark[fits], int(n[i]), n[fits], percent)
            if near.any():  # a first shared band is a bucket in which both stand, so no pair is lost
                near[near] = bands[i, (bands[fits[near]] == bands[i]).argmax(axis=1)] == key
            found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in fits[near]]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _link(keys: DataFrame, groups: _Groups, percent: int) -> None:
    """Link everything similar that shares a key of ``keys`` (id, n: size of its set, key)."""
    pivots = cut(keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("members")).filter("members > 1").select("key", F.col("p.id").alias("b"), F.col("p.n").alias("nb")), "pivots")
    busy = cut(keys.join(pivots, "key"), "busy")
    groups.load(busy.select("id").distinct())
    named = busy.filter("id != b").select(F.col("id").alias("a"), F.col("n").alias("na"), "b", "nb")
    stars = cut(named.filter(_similar_size(percent)).groupBy("a", "b").agg(F.count("*").alias("shared")), "stars")
    groups.add(stars.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b")), "stars-best")
    groups.add(stars.select("a", "b"), "stars-rest")
    placed = cut(groups.comp(busy.select("key", "id", "n"), "id", "comp"), "placed")
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("own"))
    apart = by_comp.groupBy("key").agg(F.max(F.struct("own", "comp")).alias("m"), F.sum("own").alias("members"), F.count("*").alias("comps")).filter("comps > 1")
    apart = cut(apart.select("key", F.col("m.comp").alias("major"), "members", (F.col("members") - F.col("m.own")).alias("others")), "apart")
    groups.add(_meetings(placed, apart, groups.sketches, percent), "pairs")
    forget(pivots, busy, stars, placed, apart, groups.sets)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group ``docs`` whose shingle sets reach ``percent`` hundredths of similarity, links taken transitively.

    Returns one row per row of ``docs``: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable,
    itself included) and kept (doc_id = component_id). Null, empty and blank texts have no shingle, are linked with
    nothing and kept. Texts shorter than ``words`` words are one shingle; texts of any length are taken whole. Rows that
    share a doc_id are one document: a link of one row's text holds for all, and they are kept or dropped together. A
    null doc_id can't be named in a link: its row is alone, with a null component, and kept. Ties need no rule, as the
    smallest id names a group. Extra columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = cut(docs.mapInArrow(_features(words), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"), "features")
    named = feats.filter("n_shingles > 0 and doc_id is not null")
    same_set = ["k1", "k2", "n_shingles"]
    copies = cut(named.groupBy(*same_set).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    members = cut(named.select("doc_id", *same_set).join(copies, same_set, "left").select("doc_id", *same_set, F.coalesce("rep", "doc_id").alias("rep")), "members")
    followers = members.filter("rep != doc_id").select("doc_id", *same_set).distinct()
    first = named.join(followers, ["doc_id", *same_set], "left_anti")  # by row: another text of a follower's id stays
    keys = cut(first.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key")), "keys")
    groups = _Groups(docs, first.select(F.col("doc_id").alias("id"), "sketch", "bands"), words, percent)
    torn = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).filter("a < most").select("doc_id", "a")
    groups.unite(cut(members.join(torn, "doc_id").filter("rep != a").select("a", F.col("rep").alias("b")).distinct(), "torn"))
    _link(keys, groups, percent)
    forget(copies, keys)
    linked = groups.comp(members, "rep", "component_id").select("doc_id", "n_shingles", "component_id")
    alone = feats.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest doc_id, all columns as they came.

    Rows without an id and rows without words stay; rows that share a doc_id stay or go together. Columns of any name are
    kept; an empty table gives an empty result. The result reads the text column ``text`` whole.
    """
    gone = near_duplicates(docs, words, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
