"""What bounds memory: one long text in pieces, and the queries of one block in parts."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tagmill.llm import ann, minhash
from tagmill.llm.common import HashCache

ROOT = Path(__file__).resolve().parents[2]


def test_pieces_of_a_set_give_the_same_signature(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 40, 3000, 7, 20_000)]
    whole = minhash.signatures(sets)
    monkeypatch.setattr(minhash, "_CHUNK", 64)
    assert (minhash.signatures(sets) == whole).all()
    text = " ".join(f"W{i * 7919 % 1000}" for i in range(5000)) + "\n\tend \x0b"
    once = minhash.shingle_hashes(text, 4, HashCache())
    monkeypatch.setattr(minhash, "_PIECE", 10)
    assert (minhash.shingle_hashes(text, 4, HashCache()) == once).all() and b"".join(w for run in minhash.word_runs(text) for w in run) == "".join(text.split()).lower().encode()
    assert list(minhash.word_runs(None)) == [] and len(minhash.shingle_hashes(" \n", 4, HashCache())) == 0


def test_five_million_words_in_bounded_memory():
    code = """
import resource, sys
from tagmill.llm.common import HashCache
from tagmill.llm.minhash import shingle_hashes, signatures, sketch
text = " ".join(" ".join(f"w{i * 2654435761 % 4194304}" for i in range(a, a + 50_000)) for a in range(0, 5_000_000, 50_000))
sets = shingle_hashes(text, 4, HashCache())
sig, mark = signatures([sets]), sketch(sets)
print(len(sets), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) > 4_000_000 and int(out[1]) < 500, out


def test_parts_of_a_block_find_the_same_neighbours(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    asks = F.col("vec_id") % 3 == 0
    found = lambda: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in ann.nearest(table, asks, 5).collect())
    before = found()
    monkeypatch.setattr(ann, "QUERIES_MOST", 4)
    assert found() == before and len(before) > 100
