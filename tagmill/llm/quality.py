"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated output.

Every term has a sparse random index vector, made from its hash alone. A term's context vector is the sum of the index
vectors of its neighbours in all documents, labelled or not: terms used alike get vectors alike. Each task adds up its own
part of them, and Spark adds up the parts by bucket. A document is the mean of its terms' context and index vectors, with
a few shapes (capitals, symbols, repeated words and lines) as terms of their own. A two-layer network in numpy is trained
on the pooled vectors of a bounded labelled sample, and one temperature, fitted on rows the training hasn't seen,
calibrates its probabilities.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import bounded_batches, fold, mix64, slices
from tagmill.llm.learning import labelled_sample, log_loss, one_a_document, sigmoid, temperature
from tagmill.written import cut

BUCKETS, WIDTH, NONZERO, WINDOW, HIDDEN = 1 << 15, 64, 4, 2, 24
#: Labelled documents the network is fitted on, at most; each is its pooled vector, whatever the length of its text.
MOST_LABELLED = 6000
THRESHOLD = 0.7
_TERM = re.compile(r"\w+|[^\w\s]+|\n")


class Terms(dict):
    """Term buckets of words, remembered up to ``most`` at a time: the word itself, and its shape if that is unusual."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        said = [word.lower()]
        if len(word) > 1 and word.isupper():
            said.append("\0capitals")
        elif not word[0].isalnum() and word != "\n":
            said.append("\0mark" if len(word) == 1 else "\0marks")
        elif word.isdigit():
            said.append("\0digits")
        value = self[word] = tuple(zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS for s in said)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Buckets of the text's terms in order, and after them one for each word said twice running and eight for each repeated line."""
        words = _TERM.findall(text or "")
        said = list(chain.from_iterable(map(self.__getitem__, words)))
        said += self["\0again"] * sum(map(operator.eq, words, islice(words, 1, None)))
        lines = [x for x in (text or "").split("\n") if x.strip()]
        said += self["\0line again"] * (8 * (len(lines) - len(set(lines))))
        return np.array(said, np.int64)


def index_entries(buckets: int = BUCKETS, width: int = WIDTH, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the ``nonzero`` entries of +1 or -1 that make each bucket's sparse random vector."""
    draw = mix64(np.arange(buckets * nonzero, dtype=np.uint64).reshape(buckets, nonzero))
    return (draw % np.uint64(width)).astype(np.int64), np.where(draw >> np.uint64(63), 1, -1)


def index_vectors() -> np.ndarray:
    """The sparse random vectors written out, one row for each bucket; entries at one place add up."""
    places, signs = index_entries()
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    np.add.at(out, (np.arange(BUCKETS)[:, None], places), signs)
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray  # context beside index vector of each bucket
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    heat: float = 1.0

    def pool(self, terms: np.ndarray) -> np.ndarray:
        return pool(self.vectors, terms)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        each = [self.logits(self.pool(t))[()] for t in texts]  # one by one: a text's last digit must not depend on its batch
        return sigmoid(np.array(each, np.float64) / self.heat)


def pool(vectors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Mean vector of the terms, its length-independent spread, and the logarithm of their number."""
    if not len(terms):
        return np.zeros(vectors.shape[1] + 2)
    uniq, count = np.unique(terms, return_counts=True)
    return np.concatenate([count @ vectors[uniq] / len(terms), [np.log1p(len(terms)), len(uniq) / len(terms)]])


class ContextSums:
    """Sums of the index vectors of every bucket's neighbours within WINDOW terms, over the documents added."""

    def __init__(self):
        self.places, self.signs = index_entries()
        self.sums = np.zeros((BUCKETS, WIDTH), np.int64)

    def add(self, docs: list[np.ndarray]) -> None:
        flat, gap = self.sums.reshape(-1), np.full(WINDOW, -1, np.int64)
        terms = np.concatenate([np.empty(0, np.int64), *chain.from_iterable((d, gap) for d in docs)])
        for at in range(0, len(terms), 1 << 18):
            part = terms[at : at + (1 << 18) + WINDOW]  # the last terms are met once as partners, then as firsts
            for k in range(1, WINDOW + 1):
                a, b = part[: 1 << 18][: len(part) - k], part[k : k + (1 << 18)]
                real = (a >= 0) & (b >= 0)
                for own, other in ((a[real], b[real]), (b[real], a[real])):
                    np.add.at(flat, (own[:, None] * WIDTH + self.places[other]).reshape(-1), self.signs[other].reshape(-1))

    def rows(self) -> pa.RecordBatch:
        """(bucket, sums) of the buckets that have any."""
        bucket = np.flatnonzero(self.sums.any(axis=1))
        flat = pa.array(self.sums[bucket].reshape(-1))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(bucket) + 1, dtype=np.int32) * WIDTH), flat)], ["bucket", "sums"])


def term_table(docs: DataFrame) -> DataFrame:
    """(doc_id, terms) of every row of ``docs``, written once: buckets in order, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches):
            found = [terms.of(t).astype("<u2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "terms"])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, terms binary"), "terms")


def _terms(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in column.to_pylist()]


def context_sums(table: DataFrame) -> np.ndarray:
    """ContextSums over all rows of a term table: one part a task, added up by bucket; what comes to the driver is BUCKETS rows of WIDTH numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ContextSums()
        for batch in slices(batches):
            found.add(_terms(batch.column(0)))
        yield found.rows()

    parts = table.select("terms").mapInArrow(run, "bucket int, sums array<long>")
    whole = parts.groupBy("bucket").agg(*(F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(WIDTH))).toArrow()
    sums = np.zeros((BUCKETS, WIDTH), np.int64)
    if len(whole):
        sums[whole.column("bucket").to_numpy()] = np.stack([whole.column(f"s{i}").to_numpy() for i in range(WIDTH)], axis=1)
    return sums


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors of unit length beside index vectors, of all buckets."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.concatenate([sums / np.maximum(norm, 1e-9), index_vectors() / NONZERO**0.5], axis=1).astype(np.float32)


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.01, decay: float = 3e-4, seed: int = 5) -> QualityModel:
    """Network trained by Adam on the pooled vectors ``x``; every sixth row only stops the training and sets the temperature."""
    rng = np.random.default_rng(seed)
    size = vectors.shape[1] + 2
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    flat = QualityModel(vectors, np.zeros(size), np.ones(size), np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
    if len(set(y.tolist())) < 2 or len(y) < 12:
        return flat
    order = rng.permutation(len(y))
    check, learn = order[: len(y) // 6], order[len(y) // 6 :]
    flat.mean, flat.scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    p = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(flat.b2)]
    m, v, best, at = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], (np.inf, p), 0
    z = (x - flat.mean) / flat.scale
    for _ in range(rounds):
        rng.shuffle(learn)
        for k in range(0, len(learn), 64):
            rows, at = learn[k : k + 64], at + 1
            h = np.tanh(z[rows] @ p[0] + p[1])
            err = (sigmoid(h @ p[2] + p[3]) - y[rows]) / len(rows)
            back = err[:, None] * p[2] * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), h.T @ err + decay * p[2], np.array(err.sum())]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**at)) / (np.sqrt(v[i] / (1 - 0.999**at)) + 1e-8)
        seen = log_loss(y[check], np.tanh(z[check] @ p[0] + p[1]) @ p[2] + p[3])
        if seen < best[0]:
            best = (seen, [a.copy() for a in p])
    flat.w1, flat.b1, flat.w2, flat.b2 = best[1][0], best[1][1], best[1][2], float(best[1][3])
    flat.heat = temperature(y[check], flat.logits(x[check]))
    return flat


def train(table: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> QualityModel:
    """Word vectors of all rows of a term table, and a network fitted on at most ``most`` labelled ones, whose pooled vectors alone come to the driver."""
    vectors = word_vectors(context_sums(table))
    sent = table.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pooled = [pool(sent.value, t).tolist() for t in _terms(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pooled, pa.list_(pa.float64()))], ["doc_id", "y", "pooled"])

    features = labelled_sample(table, labels, "quality", most, "terms").mapInArrow(run, "doc_id long, y int, pooled array<double>")
    rows = one_a_document(features, "pooled").toArrow().sort_by("doc_id")
    x = np.array(rows.column("pooled").to_pylist(), np.float64).reshape(len(rows), vectors.shape[1] + 2)
    return fit(vectors, x, rows.column("y").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; the network learns from ``labels`` (doc_id, quality).

    Null and empty texts pool to zero and get that point's score; texts of any length are pooled whole. Null labels are
    not learned from; with fewer than twelve labels or of one kind only, every score is the prior. Rows that share a
    doc_id are scored each, and one of them is learned from. Rows with a null doc_id are scored and not held out; equal
    rows get equal scores; extra columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    table = term_table(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(table, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(_terms(batch.column(1))), pa.float64())], ["doc_id", "score"])

    rows = table.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
