"""What the trained operators share: a bounded sample of labelled documents, and the logistic loss."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import fold

#: Labelled documents a model is fitted on, at most.
MOST_LABELLED = 8000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED, content: str = "text") -> DataFrame:
    """(doc_id, y, content) for at most ``most`` labelled documents whose fold is not held out, chosen by a hash of doc_id.

    Labels that are null count as none; several labels of a document count as their largest. Only the sampled labels,
    of which ``most`` bounds the size, are broadcast; the texts stay where they are. Rows that share a doc_id are all there.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = named.filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(content).alias(content))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", content)


def one_a_document(features: DataFrame, kept: str) -> DataFrame:
    """(doc_id, y, kept) with one row for each doc_id of ``features``, the one whose ``kept`` is the smallest."""
    return features.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(kept).alias(kept))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def log_loss(y: np.ndarray, z: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def temperature(y: np.ndarray, z: np.ndarray) -> float:
    """The divisor of the logits ``z`` with the least log loss on ``y``; targets are Platt's, short of 0 and 1, as few rows prove no certainty."""
    if not len(y):
        return 1.0
    most = y.sum()
    target = np.where(y > 0, (most + 1) / (most + 2), 1 / (len(y) - most + 2))
    tried = np.exp(np.linspace(-1.5, 3.0, 91))
    return float(tried[np.argmin([log_loss(target, z / t) for t in tried])])
