"""Nearest neighbours by shifted space-filling curves.

Vectors are rotated at random and their coordinates dealt to several groups; each group, shifted by a random offset, is
put in the order of a Hilbert curve. Spark range-partitions the (curve, key) rows, which gives every row its rank. A
query meets the rows within ``window`` ranks of its own on every curve: ranks are cut into blocks, a query is sent to
the blocks its windows touch, and a block is scored by one matrix product. The curves' answers are merged and reranked.

The window is not guessed: for a bounded number of queries the exact neighbours are found by one pass over all rows, their
rank distances on the curves are looked up, and the window is the distance that reaches the wanted recall. Equal vectors
are one row of the index, with their k + 1 smallest ids, so a vector that many rows share fills no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.written import cut, forget

#: Curves, coordinates of each, bits of a coordinate.
CURVES, DIMS, BITS = 16, 4, 8
#: Vectors the grid is fitted on and queries the window is fitted on, at most; wanted recall on these; rows of a block at least and at most.
FIT_ROWS, FIT_QUERIES, RECALL, BLOCK, BLOCK_MOST = 4096, 128, 0.96, 2048, 16384
#: Queries that meet a block in one task, about.
QUERIES_MOST = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of grid coordinates (n, dims) on the Hilbert curve, by Skilling's transform on whole columns."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1) << np.uint64(bits - 1)
    one = np.uint64(1)
    while q > one:
        low = q - one
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= np.where(set_ & (i > 0), np.uint64(0), swap) if i else np.uint64(0)
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > one:
        turn ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Curves:
    """Rotation, grid and shifts of all curves, fitted on a sample of vectors; ``norm`` is the largest length in the index.

    The largest inner product becomes the least distance by one more coordinate: sqrt(norm^2 - |x|^2) for a row, 0 for a
    query that is scaled to ``norm``.
    """

    def __init__(self, sample: np.ndarray, norm: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = sample.shape[1] + 1
        turns = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-CURVES * DIMS // size))]
        self.norm = norm
        self.turn = np.concatenate(turns, axis=1)[:, : CURVES * DIMS]
        seen = self.rows(sample) @ self.turn
        self.edges = np.quantile(seen, np.linspace(0, 1, 257)[1:-1], axis=0).T
        self.shift = rng.uniform(0, 1, CURVES * DIMS)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(1)))])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x * (self.norm / np.linalg.norm(x, axis=1))[:, None], np.zeros(len(x))])

    def keys(self, full: np.ndarray) -> np.ndarray:
        """(n, CURVES) keys of rows or queries."""
        y = full @ self.turn
        place = np.stack([np.searchsorted(e, y[:, i]) for i, e in enumerate(self.edges)], axis=1) / 256.0
        cells = ((place + self.shift) / 2 * (1 << BITS)).astype(np.int64)
        return np.stack([hilbert_keys(cells[:, c * DIMS : (c + 1) * DIMS], BITS) for c in range(CURVES)], axis=1).astype(np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's ``k`` largest scores, ties to the smaller id."""
    n = scores.shape[1]
    if n > k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(scores >= floor[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(scores, bool))
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep]


def usable(embedding: str) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(embedding).isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0)


def _as_numbers(vectors: DataFrame) -> Column:
    """The column embedding: floats stay floats, which double holds exactly; all else becomes double."""
    kind = vectors.schema["embedding"].dataType
    return F.col("embedding") if kind.elementType.typeName() == "float" else F.col("embedding").cast("array<double>")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows by inner product of every row for which ``is_query`` holds: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding. Null, zero and non-finite vectors and vectors of another length than the most
    frequent one (ties: the shorter) take no part, nor do rows with a null vec_id. Rows that share vec_id and vector are
    one; ties go to the smaller vec_id; fewer than ``k`` rows give all. Vectors of float and of double components are
    multiplied and added in double precision as they came. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _as_numbers(vectors).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    known = known.filter(F.col("vec_id").isNotNull() & usable("embedding"))
    size = known.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return empty
    known = known.filter(F.size("embedding") == size.d)

    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    smallest = known.select("embedding", "vec_id").withColumn("nth", F.dense_rank().over(by_id)).filter(F.col("nth") <= k + 1)
    classes = cut(smallest.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "classes")
    asking = cut(known.filter("asks").select("vec_id", "embedding").distinct().join(classes.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), "rep"), "asking")
    if asking.isEmpty():
        return empty
    questions = cut(classes.select("rep", "embedding").join(asking.select("rep").distinct(), "rep"), "questions")

    length = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = float(classes.agg(F.max(length)).first()[0]) ** 0.5
    sample = classes.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(FIT_ROWS).toArrow()
    curves = spark.sparkContext.broadcast(Curves(_matrix(sample.column(0)), norm))

    def keyed(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, made = _matrix(batch.column(1)), curves.value
                key = made.keys(made.queries(x) if asks else made.rows(x)) if len(x) else np.empty((0, CURVES), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(CURVES, dtype=np.int32), len(x))), pa.array(key.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), CURVES)), pa.array([asks] * (len(x) * CURVES), pa.bool_())],
                    ["curve", "key", "rep", "asks"],
                )

        return run

    schema = "curve int, key long, rep long, asks boolean"
    entries = classes.select("rep", "embedding").mapInArrow(keyed(False), schema).union(questions.mapInArrow(keyed(True), schema))
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = entries.repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep", "asks")
    placed = cut(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("at", 33)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", before.alias("first"))  # a row for each range partition
    ranked = cut(placed.withColumn("part", part).join(F.broadcast(starts), "part").select("curve", "rep", "asks", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place")), "ranked")

    window = _window(classes, questions, ranked, k, recall)
    block = int(min(max(BLOCK, window), BLOCK_MOST))
    rows = ranked.filter("not asks").select((F.col("place") / block).cast("long").alias("block"), "rep").join(classes.select("rep", "embedding"), "rep")
    reach = F.sequence(F.floor(F.greatest(F.col("place") - window, F.lit(0)) / block), F.floor((F.col("place") + window) / block))
    asked = ranked.filter("asks").select("rep", F.explode(reach).alias("block")).distinct()
    # a block that many queries reach is dealt into parts, each with its share of the queries and all rows of the block
    crowded = cut(asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES_MOST).cast("int").alias("parts")).filter("parts > 1"), "crowded")
    part_of = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")
    asked = asked.join(crowded, "block", "left").select("rep", F.col("block").alias("asked"), part_of.alias("asked_part")).join(questions, "rep").select("asked", "asked_part", F.col("rep").alias("q"), F.col("embedding").alias("wanted"))
    rows = rows.join(crowded, "block", "left").select("block", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "rep", "embedding")

    def scored(key: tuple, own: pa.Table, queries: pa.Table) -> pa.Table:
        q, ids = queries.column("q").to_numpy(), own.column("rep").to_numpy()
        if not len(q) or not len(ids):
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, first = np.unique(ids, return_index=True)  # a block may span curves and hold a row twice
        x, found = _matrix(own.column("embedding"))[first], []
        for a in range(0, len(q), 512):
            s = _matrix(queries.column("wanted").slice(a, 512)) @ x.T
            r, c = _best(s, ids, k + 1)
            found.append((q[a + r], ids[c], s[r, c]))
        return pa.table({n: np.concatenate([f[i] for f in found]) for i, n in enumerate(("q", "rep", "score"))})

    candidates = rows.groupBy("block", "part").cogroup(asked.groupBy("asked", "asked_part")).applyInArrow(scored, "q long, rep long, score double")
    merged = candidates.groupBy("q", "rep").agg(F.max("score").alias("score"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    classes_found = cut(merged.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k + 1).drop("nth"), "found")
    each = classes_found.join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k + 1)
    answers = cut(each.groupBy("q").agg(best.alias("best")), "answers")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    flat = asking.join(answers, asking["rep"] == answers["q"]).select("query_id", F.posexplode(others).alias("pos", "hit"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def _window(classes: DataFrame, questions: DataFrame, ranked: DataFrame, k: int, recall: float) -> int:
    """Ranks to look at on either side, so that ``recall`` of the exact neighbours of at most FIT_QUERIES queries are met."""
    spark = classes.sparkSession
    some = questions.orderBy(F.xxhash64("rep"), "rep").limit(FIT_QUERIES).toArrow()
    asked = spark.sparkContext.broadcast((some.column("rep").to_numpy(), _matrix(some.column("embedding"))))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, x = asked.value
        for batch in batches:
            if len(batch):
                ids = batch.column(0).to_numpy()
                s = x @ _matrix(batch.column(1)).T
                r, c = _best(s, ids, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(ids[c]), pa.array(s[r, c])], ["q", "rep", "score"])

    found = classes.select("rep", "embedding").mapInArrow(exact, "q long, rep long, score double")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    true = cut(found.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k + 1).filter("q != rep").select("q", "rep"), "true")
    own = ranked.filter("asks").select("curve", F.col("rep").alias("q"), F.col("place").alias("pq"))
    theirs = ranked.filter("not asks").select("curve", "rep", "place")
    near = true.join(theirs, "rep").join(own, ["curve", "q"]).groupBy("q", "rep").agg(F.min(F.abs(F.col("place") - F.col("pq"))).alias("away"))
    got = near.agg(F.percentile("away", F.lit(recall))).first()[0]
    return int(got or 0) + 1
