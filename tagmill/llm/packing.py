"""Packing token streams into fixed windows by dynamic programming.

Documents keep their order. Cuts between windows may fall at document ends (free), sentence ends (a small penalty) and,
where no sentence ends for long, inside (a large one). Among all ways to cut, the one with the least padding plus
penalties is taken: f(j) = penalty(j) + min over cuts i of f(i) + padding(j - i). Padding is ``length - (j - i)``, so the
minimum of f(i) + position(i) over the last ``length`` tokens is needed, which a monotone queue gives in constant time;
windows whose size is a power of two need no padding and are looked at besides.

Each task packs its own part of the input block by block, so nothing is shuffled and memory is bounded by a block and
the longest document. A block's last, open window is carried into the next block.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagmill.llm.common import bounded_batches, slices

#: Tokens of a sequence; tokens of a block; penalties in tokens; least distance of sentence cuts; distance of inner cuts.
LENGTH, BLOCK, SENTENCE, INNER, APART, STEP = 2048, 1 << 18, 4.0, 24.0, 12, 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"

# The white space that the tokenizer's pattern knows, and the pattern of byte-level pre-tokens.
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CHUNKS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevelEncoder(dict):
    """Token ids of byte-level BPE texts, as little-endian 32-bit integers.

    White space never joins the word before it, so a text splits before each run of white space into chunks that are
    encoded by themselves; chunks seen before are remembered, ``most`` at a time. Texts that hold a special token's string
    go to the tokenizers library whole, as do all texts if the vocabulary's ids don't follow its merges' order.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        self.most = most
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        vocab, merges = said["model"]["vocab"], said["model"]["merges"]
        self.special = [x["content"] for x in said["added_tokens"]]
        alphabet = byte_alphabet()
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        plain = said["normalizer"] is None and said["pre_tokenizer"]["type"] == "ByteLevel" and not said["pre_tokenizer"]["add_prefix_space"] and made == sorted(made)
        self.fast = tiktoken.Encoding("chunks", pat_str=_PIECES, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})._core_bpe.encode_ordinary if plain else None

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = array("I", self.fast(chunk)).tobytes()
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _CHUNKS.findall(text)))

    @cached_property
    def sentence_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each id: whether a sentence may end with it; whether one may begin with it."""
        size = max(self.library.get_vocab_size(), max(self.bytes, default=0) + 1)
        ends, begins = np.zeros(size, bool), np.zeros(size, bool)
        for i, b in self.bytes.items():
            ends[i] = b.rstrip(b"\"')]").endswith((b".", b"!", b"?", b"\n", "。".encode()))
            begins[i] = b[:1] in (b" ", b"\n", b"\t") or b.endswith(b"\n")
        return ends, begins


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ByteLevelEncoder:
    """The encoder of a file, kept with what it remembers for all tasks of a Python worker."""
    return ByteLevelEncoder(path)


def candidate_cuts(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending from 0 to ``total``, and their penalties."""
    cost = {}
    if len(sentence_ends):
        sentence_ends = sentence_ends[np.unique(sentence_ends // APART, return_index=True)[1]]
    near = np.union1d(np.concatenate([[0, total], doc_ends]), sentence_ends).astype(np.int64)
    gaps = np.flatnonzero(np.diff(near) > 2 * STEP)
    inner = [np.arange(near[g] + STEP, near[g + 1], STEP) for g in gaps]
    if last:  # a remainder can then be cut into powers of two
        inner.append(np.arange(max(0, total - length), total))
    pos = np.union1d(near, np.concatenate([np.empty(0, np.int64), *inner])).astype(np.int64)
    cost = np.full(len(pos), INNER)
    cost[np.searchsorted(pos, sentence_ends)] = SENTENCE
    cost[np.searchsorted(pos, doc_ends)] = 0.0
    cost[[0, -1]] = 0.0
    return pos, cost


def best_cuts(pos: np.ndarray, cost: np.ndarray, length: int, last: bool) -> list[int]:
    """Positions of the cheapest cuts, from 0; to the end if ``last``, else to the cheapest end among the last ``length`` tokens."""
    n = len(pos)
    exact: dict[int, list[int]] = {}
    size = 1
    while size < length:
        at = np.searchsorted(pos, pos - size)
        for j in np.flatnonzero((pos >= size) & (pos[np.minimum(at, n - 1)] == pos - size)):
            exact.setdefault(int(j), []).append(int(at[j]))
        size *= 2
    where, price = pos.tolist(), cost.tolist()
    f, back, queue = [0.0] * n, [-1] * n, deque([0])
    for j in range(1, n):
        end = where[j]
        while where[queue[0]] < end - length:
            queue.popleft()
        i = queue[0]
        best = f[i] + length - end + where[i]
        for k in exact.get(j, ()):
            if f[k] < best:
                i, best = k, f[k]
        best += price[j]
        f[j], back[j] = best, i
        g = best + end
        while queue and f[queue[-1]] + where[queue[-1]] >= g:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not last:
        j = min(range(int(np.searchsorted(pos, max(1, where[-1] - length))), n), key=lambda k: f[k])
    found = []
    while j > 0:
        found.append(where[j])
        j = back[j]
    return [0, *reversed(found)]


class _Doc(NamedTuple):
    doc_id: int | None
    ids: np.ndarray
    start: int
    tokens: int


class _Packer:
    def __init__(self, encoder: ByteLevelEncoder, length: int, first: int):
        self.ends, self.begins = encoder.sentence_tables
        self.length, self.next, self.docs = length, first, []

    def flush(self, last: bool) -> pa.RecordBatch | None:
        docs = self.docs
        sizes = np.array([len(d.ids) for d in docs], np.int64)
        total = int(sizes.sum())
        if not total:
            return None
        ids = np.concatenate([d.ids for d in docs])
        doc_ends = np.cumsum(sizes)
        sentence_ends = np.flatnonzero(self.ends[ids[:-1]] & self.begins[ids[1:]]) + 1
        cuts = best_cuts(*candidate_cuts(total, doc_ends, sentence_ends, self.length, last), self.length, last)
        done = cuts[-1]
        starts = np.union1d(np.concatenate([[0], doc_ends[:-1]]), cuts).astype(np.int64)
        starts = starts[starts < done]
        stops = np.append(starts[1:], done)
        doc = np.searchsorted(doc_ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right") - 1
        cut = np.array(cuts, np.int64)
        raw = memoryview(ids.astype("<u4").tobytes())
        doc_starts = doc_ends - sizes
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([docs[d].doc_id for d in doc.tolist()], pa.int64()),
                pa.array(np.array([d.start for d in docs], np.int64)[doc] + starts - doc_starts[doc]),
                pa.array(stops - starts),
                pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary()),
                pa.array(np.array([d.tokens for d in docs], np.int64)[doc]),
                pa.array(window + self.next),
                pa.array(starts - cut[window]),
                pa.array(np.diff(cut)[window]),
            ],
            [x.split()[0] for x in SCHEMA.split(", ")],
        )
        self.next += len(cuts) - 1
        k = int(np.searchsorted(doc_ends, done, "right"))
        self.docs = []
        if k < len(docs):
            used = int(max(0, done - doc_starts[k]))
            self.docs = [_Doc(docs[k].doc_id, docs[k].ids[used:], docs[k].start + used, docs[k].tokens), *docs[k + 1 :]]
        return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences (SCHEMA): ids are little-endian unsigned 32-bit, ``start`` counts in the document, ``offset`` in the sequence.

    ``tokenizer`` is the path of a tokenizers JSON file that executors can read. Each document is its ids and ``end_id``;
    null and empty texts are ``end_id`` alone; texts of any length are packed whole. Rows keep the input's order inside
    a task; equal and repeated rows are packed each. A null doc_id is packed under null. Extra columns are ignored;
    an empty table gives an empty result. A sequence's id is its task's number times 2**36 plus its place there.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        packer, held = _Packer(encoder, length, TaskContext.get().partitionId() << 36), 0
        tail = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encoder.encode(text) + tail, "<u4")
                packer.docs.append(_Doc(doc_id, ids, 0, len(ids)))
                held += len(ids)
                if held >= BLOCK:
                    yield packer.flush(False)
                    held = sum(len(d.ids) for d in packer.docs)
        if (rest := packer.flush(True)) is not None:
            yield rest

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
