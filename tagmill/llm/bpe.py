"""BPE encoding and decoding with forced boundaries.

A merge can only make a symbol that is in the vocabulary. Where two neighbouring bytes never stand side by side inside any
vocabulary token, no merge can cross, so a cut there is certain: the fragments between such cuts are encoded
independently and their ids concatenated, and the result is that of the whole. Cuts at white space are of the same kind
(no token holds any), as are those of the vocabulary's own word pattern. Fragments and white-space chunks repeat, so
their ids are remembered, a bounded number at a time.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from tagmill.llm.common import bounded_batches, slices
from tagmill.llm.packing import byte_alphabet

SCHEMA = "doc_id long, ids binary, decoded string"
_ODD = re.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(r"[^\p{White_Space}]+")


class Memory(dict):
    """What ``make`` gives for each key, remembered for ``most`` short keys at a time."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str):
        found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


class ForcedBoundaryBPE:
    """Encoder and decoder of a tokenizers JSON file whose model is BPE over byte characters with a word-end suffix."""

    def __init__(self, path: str, most: int = 350_000):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in said["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.last = BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=model["end_of_word_suffix"])
        self.inner = BPE(vocab=self.vocab, merges=merges)  # for fragments that don't end a word
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.byte_char = {b: c for c, b in byte_alphabet().items()}
        joined = {pair for t in self.vocab for pair in self._neighbours(t)}
        self.inside = frozenset(joined)
        self.inner_ids, self.last_ids = Memory(self._inner_ids, most), Memory(self._last_ids, most)
        self.word_ids, self.chunks = Memory(self._word, most), Memory(self._chunk, most)

    def _neighbours(self, token: str) -> Iterator[tuple[str, str]]:
        body = token.removesuffix(self.end)
        return zip(body, body[1:], strict=False)

    def cut(self, word: str) -> list[str]:
        """``word`` (byte characters) at every pair that stands in no token."""
        inside = self.inside
        forced = [i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in inside]
        return [word[a:b] for a, b in zip([0, *forced], [*forced, len(word)], strict=True)] if forced else [word]

    def _inner_ids(self, fragment: str) -> tuple[int, ...]:
        return tuple([t.id for t in self.inner.tokenize(fragment)])

    def _last_ids(self, fragment: str) -> tuple[int, ...]:
        return tuple([t.id for t in self.last.tokenize(fragment)])

    def _word(self, word: str) -> tuple[int, ...]:
        *parts, end = self.cut("".join(map(self.byte_char.__getitem__, word.encode("utf-8"))))
        return (*chain.from_iterable(map(self.inner_ids.__getitem__, parts)), *self.last_ids[end])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of normalised text without white space."""
        return array("I", chain.from_iterable(map(self.word_ids.__getitem__, self.words.findall(chunk)))).tobytes()

    def normalise(self, text: str) -> str:
        """NFC, then lower case character by character (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        ids: list[bytes] = []
        for part in self.split_special.split(text) if "<" in text else (text,):
            if part in self.special:
                ids.append(array("I", [self.special[part]]).tobytes())
                continue
            clean = self.normalise(part)
            ids += map(self.chunks.__getitem__, _CHUNK.findall(clean) if _ODD.search(clean) else clean.split())
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The text of such ids: tokens joined as a vocabulary without decoder joins them; special ones are kept."""
        return " ".join(map(self.token.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def bpe_of(path: str) -> ForcedBoundaryBPE:
    """The encoder of a file, kept with what it remembers for all tasks of a Python worker."""
    return ForcedBoundaryBPE(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (little-endian unsigned 32-bit) and the text decoded from these ids.

    ``tokenizer`` is the path of a tokenizers JSON file that executors can read. Null and empty texts have no ids and decode
    to the empty text; long texts are encoded whole; equal and repeated rows each get their row; a null doc_id stays null;
    extra columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(tokenizer)
        for batch in slices(batches):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
