"""Toxicity by a factorization machine over hashed terms.

A document is the set of buckets its lower-cased words and their beginnings hash into. The machine gives every bucket a weight and a short
vector; the logit is the sum of the weights plus the sum over all pairs of the vectors' products, so two terms can say
together what neither says alone. The pairs cost no more than the terms: their sum is half of |sum|^2 - sum of |.|^2.
It is fitted by AdaGrad on a bounded sample of labelled documents and sent to the tasks, which score whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import bounded_batches, fold, slices
from tagmill.llm.learning import MOST_LABELLED, labelled_sample, one_a_document, sigmoid, temperature
from tagmill.written import cut

BUCKETS, FACTORS = 1 << 18, 4
#: Documents a bucket must occur in to be learned from, and the share of all beyond which it says nothing.
LEAST_DOCS, MOST_SHARE = 5, 0.6
#: Lengths of the word beginnings that are terms besides the word.
BEGINNINGS = (3, 5, 7)
#: Distinct buckets of all sampled documents together that may come to the driver, at most: four bytes each.
MOST_TERMS = 1 << 26
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


class TermBuckets(dict):
    """Buckets of each word and of its beginnings, remembered up to ``most`` words at a time."""

    def __init__(self, buckets: int = BUCKETS, most: int = 200_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        terms = [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]
        value = self[word] = tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % self.buckets for t in terms)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Distinct buckets of a text, ascending."""
        words = set(_WORD.findall((text or "").lower()))
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, words)), np.int32))


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    heat: float = 1.0

    def logit(self, terms: np.ndarray) -> float:
        v = self.factor[terms]
        s = v.sum(axis=0)
        return float(self.bias + self.weight[terms].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, terms: np.ndarray) -> float:
        return float(sigmoid(np.array(self.logit(terms) / self.heat)))


def fit(sets: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS, factors: int = FACTORS, rounds: int = 10, rate: float = 0.1, sparsity: float = 0.06, seed: int = 7) -> FactorizationMachine:
    """Fit on term sets and 0/1 labels by AdaGrad with soft thresholds, so that chance terms keep no weight.

    A tenth of the rows only sets the temperature. No row, or rows of one class, give the prior alone.
    """
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(prior / (1 - prior)))
    w, v = np.zeros(buckets), np.zeros((buckets, factors))
    if len(set(y.tolist())) < 2:
        return FactorizationMachine(bias, w, v)
    seen = np.bincount(np.concatenate(sets), minlength=buckets)
    used = (seen >= LEAST_DOCS) & (seen <= MOST_SHARE * len(sets))
    sets = [s[used[s]] for s in sets]
    v[used] = rng.normal(0, 0.02, (int(used.sum()), factors))
    order = rng.permutation(len(y))
    check, learn = order[: len(y) // 10], order[len(y) // 10 :]
    gw, gv, gb = np.full(buckets, 1e-2), np.full((buckets, factors), 1e-2), 1e-2
    for _ in range(rounds):
        rng.shuffle(learn)
        for k in range(0, len(learn), 64):
            rows = [i for i in learn[k : k + 64] if len(sets[i])]
            if not rows:
                continue
            size = np.array([len(sets[i]) for i in rows])
            terms = np.concatenate([sets[i] for i in rows])
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            vt = v[terms]
            s = np.add.reduceat(vt, at)
            z = bias + np.add.reduceat(w[terms], at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vt * vt).sum(1), at))
            err = sigmoid(z) - y[rows]
            each = np.repeat(err, size)
            uniq, inv = np.unique(terms, return_inverse=True)
            dw = np.bincount(inv, each)
            gw[uniq] += dw * dw
            step = rate / np.sqrt(gw[uniq])
            w[uniq] = _soft(w[uniq] - step * dw, step * sparsity * np.sqrt(np.bincount(inv)))
            dv = each[:, None] * (np.repeat(s, size, axis=0) - vt)
            dv = np.stack([np.bincount(inv, dv[:, f]) for f in range(factors)], axis=1)
            gv[uniq] += dv * dv
            step = 0.1 * rate / np.sqrt(gv[uniq])
            v[uniq] = _soft(v[uniq] - step * dv, step * sparsity)
            gb += float(err.sum()) ** 2
            bias -= rate * float(err.sum()) / gb**0.5
    machine = FactorizationMachine(bias, w.astype(np.float32), v.astype(np.float32))
    machine.heat = temperature(y[check], np.array([machine.logit(sets[i]) for i in check]))
    return machine


def _soft(x: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    return np.sign(x) * np.maximum(0.0, np.abs(x) - by)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = TermBuckets()
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([terms.of(t).tolist() for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "y", "terms"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_terms: int = MOST_TERMS) -> FactorizationMachine:
    """Machine fitted on at most ``most`` labelled documents; only their term buckets come to the driver.

    Documents are taken in the order of a hash until their buckets are ``most_terms``; a text is used whole or not at all.
    """
    features = labelled_sample(docs, labels, "toxic", most).mapInArrow(_sample_rows, "doc_id long, y int, terms array<int>")
    sample = cut(one_a_document(features, "terms"), "sample")
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sample.select("doc_id", F.sum(F.size("terms").cast("long")).over(so_far).alias("held")).filter(F.col("held") <= most_terms)  # a row for each of ``most`` documents
    rows = sample.join(F.broadcast(fits.select("doc_id")), "doc_id").select("y", "terms").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    terms = rows.column("terms").combine_chunks()
    sets = np.split(terms.values.to_numpy(), terms.offsets.to_numpy()[1:-1]) if len(y) else []
    order = sorted(range(len(y)), key=lambda i: (len(sets[i]), y[i], sets[i].tobytes()))  # the tasks' order doesn't matter
    return fit([sets[i] for i in order], y[order])


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; the model learns from ``labels`` (doc_id, toxic).

    Null and empty texts have no terms and get the bias's score. Null labels are not learned from; without labels of both
    kinds every score is the prior. Rows with a null doc_id are scored and not held out; equal and repeated rows get
    equal scores; extra columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = TermBuckets(), model.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([machine.score(terms.of(t)) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they came, in one pass without a shuffle.

    Null and empty texts get the bias's score; texts are scored whole; equal and repeated rows stay or go together; rows
    without an id are scored; columns of any name are kept; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = TermBuckets(), model.value
        for batch in slices(batches):
            yield batch.filter(pa.array([machine.score(terms.of(t)) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
