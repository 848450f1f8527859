"""Operators on spans (start, end, half-open code points) of a document."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _rank_struct(columns: list[str]) -> Column:
    """What spans are ordered by: confidence, length, start, then all else, so that any input order gives one result."""
    rest = [c for c in columns if c not in ("start", "end", "confidence")]
    return F.struct((-F.col("confidence")).alias("_c"), (F.col("start") - F.col("end")).alias("_l"), F.col("start"), F.col("end"), F.col("confidence"), *rest)


#: Spans of a cluster that are folded inside Spark; larger clusters go to a sorted structure in Python.
SMALL = 64


def clustered(spans: DataFrame, keys: list[str], name: str = "_cluster") -> DataFrame:
    """``spans`` with ``name``: numbers of the runs of spans in a document that can touch each other.

    In order of starts a run ends where the next span starts at or after the largest end so far; no span overlaps one of
    another run, so whatever is decided by overlaps is decided inside a run. One sort of a document's spans, no gathering.
    """
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    return opened.withColumn(name, F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


class _Apart:
    """Kept spans of which none overlaps another, by start: a new one can only touch the last that starts before its end."""

    def __init__(self):
        self.starts, self.ends = [], []

    def admits(self, span: dict) -> bool:
        at = bisect_left(self.starts, span["end"])
        if at and self.ends[at - 1] > span["start"]:
            return False
        at = bisect_right(self.starts, span["start"], hi=at)
        while at and self.starts[at - 1] == span["start"] and self.ends[at - 1] > span["end"]:
            at -= 1
        self.starts.insert(at, span["start"])
        self.ends.insert(at, span["end"])
        return True


class _Behind(_Apart):
    """As ``_Apart`` for spans with ``_p`` = 1; those with 0 are all kept, come first and are found by the largest end before a start."""

    def __init__(self):
        super().__init__()
        self.firsts, self.reach = [], []

    def admits(self, span: dict) -> bool:
        if span["_p"] == 0:  # in order of their starts
            self.firsts.append(span["start"])
            self.reach.append(max(span["end"], self.reach[-1]) if self.reach else span["end"])
            return True
        at = bisect_left(self.firsts, span["end"])
        return not (at and self.reach[at - 1] > span["start"]) and super().admits(span)


class _Uncrossed:
    """Kept spans of which none crosses another: the furthest end of those that start, and the first start of those that end, inside a new one.

    Both are asked of trees over the places that spans have at all, so each question costs the logarithm of their number.
    """

    def __init__(self, spans: list[dict]):
        self.place = {p: i for i, p in enumerate(sorted({s[e] for s in spans for e in ("start", "end")}))}
        self.size = max(1, len(self.place))
        self.furthest, self.first = [-1] * (2 * self.size), [self.size] * (2 * self.size)

    def _between(self, tree: list[int], low: int, high: int, pick, worst: int) -> int:
        low, high = low + self.size, high + self.size
        while low < high:
            if low & 1:
                worst, low = pick(worst, tree[low]), low + 1
            if high & 1:
                high -= 1
                worst = pick(worst, tree[high])
            low, high = low >> 1, high >> 1
        return worst

    def _set(self, tree: list[int], at: int, value: int, pick) -> None:
        at += self.size
        while at:
            tree[at] = pick(tree[at], value)
            at >>= 1

    def admits(self, span: dict) -> bool:
        a, b = self.place[span["start"]], self.place[span["end"]]
        if self._between(self.furthest, a + 1, b, max, -1) > b or self._between(self.first, a + 1, b, min, self.size) < a:
            return False
        self._set(self.furthest, a, b, max)
        self._set(self.first, b, a, min)
        return True


def _fold(spans: DataFrame, keys: list[str], order: Column, clash, kept_by) -> DataFrame:
    """Per document: spans in ``order``, each kept unless it clashes with one kept before.

    Only spans of one overlap cluster are gathered. Small clusters are folded inside Spark, span against span by
    ``clash``; large ones in Python by ``kept_by``, which asks a sorted structure instead, so no cluster costs its square.
    """
    columns = [c for c in spans.columns if c not in keys]
    grouped = clustered(spans, keys).groupBy(*keys, "_cluster").agg(F.sort_array(F.collect_list(order)).alias("all"))
    few = grouped.filter(F.size("all") <= SMALL)
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    folded = few.select(*keys, F.explode(kept).alias("s")).select(*keys, *(F.col(f"s.{c}").alias(c) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                row = batch.slice(n, 1)
                rest = row.column(len(keys)).flatten()
                held = kept_by(rest.to_pylist())
                at = pa.array([i for i, span in enumerate(rest.to_pylist()) if held.admits(span)], pa.int64())
                own = [row.column(i).take(pa.array([0] * len(at), pa.int64())) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *(rest.field(c).take(at) for c in columns)], [*keys, *columns])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.select(*keys, *columns).schema)
    many = grouped.filter(F.size("all") > SMALL).select(*keys, "all").mapInArrow(run, schema)
    return folded.select(*keys, *columns).unionByName(many)


def greedy(spans: DataFrame, keys: list[str]) -> DataFrame:
    """No overlaps: the more confident span wins, then the longer, then the earlier."""
    return _fold(spans, keys, _rank_struct([c for c in spans.columns if c not in keys]), _overlap, lambda _: _Apart())


def longest_first(spans: DataFrame, keys: list[str]) -> DataFrame:
    """No overlaps: the longer span wins, then the earlier."""
    rest = [c for c in spans.columns if c not in keys and c not in ("start", "end")]
    return _fold(spans, keys, F.struct((F.col("start") - F.col("end")).alias("_l"), "start", "end", *rest), _overlap, lambda _: _Apart())


def allow(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One span for each (start, end): the most confident, ties by label."""
    best = Window.partitionBy(*keys, "start", "end").orderBy(F.desc("confidence"), "label")
    return spans.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def nested(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Containment may stay, crossing may not: in rank order a span is kept unless it crosses one kept before."""
    crosses = lambda a, b: ((a["start"] < b["start"]) & (b["start"] < a["end"]) & (a["end"] < b["end"])) | ((b["start"] < a["start"]) & (a["start"] < b["end"]) & (b["end"] < a["end"]))
    unique = allow(spans, keys)
    rest = [c for c in spans.columns if c not in keys and c not in ("start", "end", "confidence")]
    order = F.struct((-F.col("confidence")).alias("_c"), "start", "end", "confidence", *rest)
    return _fold(unique, keys, order, crosses, _Uncrossed)


def outermost(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans strictly inside another of the document are dropped: running extremes over a sort, no join of all pairs.

    Sorted by start and falling end, a span lies inside an earlier one exactly if the largest end so far reaches its own.
    """
    unique = allow(spans, keys)
    before = Window.partitionBy(*keys).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return unique.withColumn("_e", F.max("end").over(before)).filter(F.col("_e").isNull() | (F.col("_e") < F.col("end"))).drop("_e")


def best_total(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The set without overlaps of largest total confidence; then of more spans; then of the better ranks.

    Weighted interval scheduling is sequential inside a document, so each document's spans go to a grouped function.
    """
    unique = allow(spans, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.assign(_s=-pdf["confidence"]).sort_values(["_s", "start", "end"]).reset_index(drop=True)
        order = sorted(range(len(ranked)), key=lambda i: (ranked.end[i], ranked.start[i], i))
        ends = [int(ranked.end[i]) for i in order]
        best: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
        for n, i in enumerate(order):
            before = _last_at_most(ends, int(ranked.start[i]), n)
            total, count, taken = best[before]
            take = (round(total + float(ranked.confidence[i]), 9), count + 1, tuple(sorted((*taken, i))))
            best.append(max(best[n], take, key=lambda b: (b[0], b[1], tuple(-x for x in b[2]))))
        return ranked.loc[list(best[-1][2])].drop(columns="_s")

    return unique.groupBy(*keys).applyInPandas(run, unique.schema)


def _last_at_most(ends: list[int], start: int, stop: int) -> int:
    low, high = 0, stop
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if ends[mid] <= start else (low, mid)
    return low


def priority_merge(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``primary`` and what of ``secondary`` overlaps nothing kept so far, in start order."""
    columns = [c for c in primary.columns if c not in keys]
    rest = [c for c in columns if c not in ("start", "end")]
    both = primary.withColumn("_p", F.lit(0)).unionByName(secondary.withColumn("_p", F.lit(1)))
    clash = lambda a, b: (a["_p"] == 1) & _overlap(a, b)
    return _fold(both, keys, F.struct("_p", "start", "end", *rest), clash, lambda _: _Behind()).select(*keys, *columns)


def chunk_windows(docs: DataFrame, n_tokens: str, size: int = 384, overlap: int = 64) -> DataFrame:
    """(…, chunk, start_word, end_word): windows of ``size`` words that share ``overlap``; no word still makes one window."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.col(n_tokens) - overlap - 1, F.lit(0)), F.lit(step))
    return docs.select("*", F.posexplode(starts).alias("chunk", "start_word")).withColumn("end_word", F.least(F.col("start_word") + size, F.col(n_tokens)))


def bio_encode(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens`` (pos, start, end) with ``tag``: B- on the first token of a span, I- on the next ones, O outside.

    ``spans`` must not overlap, so a token's span is the last one that starts before the token ends: a running maximum
    over one sort of tokens and spans together instead of a range join.
    """
    t = tokens.select(*keys, "pos", "start", "end", F.lit(None).cast("string").alias("label"), F.col("end").alias("_at"), F.lit(1).alias("_kind"))
    s = spans.select(*keys, F.lit(None).cast("int").alias("pos"), "start", "end", "label", (F.col("start") + 1).alias("_at"), F.lit(0).alias("_kind"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind", "start")
    last = F.last(F.when(F.col("_kind") == 0, F.struct("start", "end", "label")), ignorenulls=True).over(order)
    placed = t.unionByName(s).withColumn("_s", last).filter("_kind = 1")
    inside = F.when(F.col("_s.end") > F.col("start"), F.col("_s"))
    by_pos = Window.partitionBy(*keys).orderBy("pos")
    tagged = placed.select(*keys, "pos", "start", "end", inside.alias("_s")).withColumn("_before", F.lag("_s.start").over(by_pos))
    tag = F.when(F.col("_s").isNull(), "O").when(F.col("_before") == F.col("_s.start"), F.concat(F.lit("I-"), F.col("_s.label"))).otherwise(F.concat(F.lit("B-"), F.col("_s.label")))
    return tagged.select(*keys, "pos", "start", "end", tag.alias("tag"))


def bio_decode(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (start, end, label) of BIO rows (pos, start, end, tag): I- of another type, or with nothing open, opens one."""
    by_pos = Window.partitionBy(*keys).orderBy("pos")
    label = F.when(F.col("tag").rlike("^[BI]-."), F.substring("tag", 3, 1 << 20))
    t = tagged.withColumn("label", label).withColumn("_last", F.lag("label").over(by_pos))
    opens = F.col("label").isNotNull() & (F.col("tag").startswith("B-") | F.col("_last").isNull() | (F.col("_last") != F.col("label")))
    t = t.withColumn("_n", F.sum(opens.cast("int")).over(by_pos)).filter("label is not null")
    return t.groupBy(*keys, "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label")).drop("_n")
