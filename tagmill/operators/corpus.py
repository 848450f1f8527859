"""Corpus building: deduplication, quotas, splits, samples, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_order, hash_uniform
from tagmill.operators.ranking import ranked
from tagmill.written import cut


def keep_first(rows: DataFrame, by: list[Column], order: list) -> DataFrame:
    """The first row of each group by ``order``; ranked before and after the shuffle, so a hot group sends few rows.

    Null keys are a group; of rows equal in ``order`` any stays; no row gives no row.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n")


def equal_or_null(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    """Join condition under which null keys meet null keys."""
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(right[c])
    return same


def beside(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` that are not in ``on``; null keys meet null keys, so no row is lost."""
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") for c in on), *(c for c in right.columns if c not in on))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, same, how).drop(*(f"_r_{c}" for c in on))


def with_row(rows: DataFrame, row: DataFrame) -> DataFrame:
    """``rows``, each with the columns of ``row``, a table of one row of any size.

    The row is copied for as many salts as there are shuffle partitions and rows are dealt over these, so Spark may broadcast it if
    it is small and else spreads the join evenly. No row in ``row`` gives no row.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(n)))
    copies = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias("_salt"))
    return salted.join(copies, "_salt").drop("_salt")


def conflict_drop(rows: DataFrame, key: Column, tag: Column, order: str) -> DataFrame:
    """Groups of equal ``key``: with one tag the first row by ``order`` stays, with several none does.

    Null keys are a group, a null tag is a tag like any other, null orders come first; of rows equal in ``order`` one stays.
    """
    said = F.struct(tag.alias("t"))
    groups = rows.groupBy(key.alias("_k")).agg(F.min(F.struct(F.col(order).alias("o"), F.struct(*rows.columns).alias("row"))).alias("_first"), F.count_distinct(said).alias("_tags"))
    return groups.filter("_tags <= 1").select("_first.row.*")


def catalogue_collapse(rows: DataFrame, by: list[str], first: list[str], modal: list[str], order: str) -> DataFrame:
    """One row for each group: the first row's ``first`` columns, the most frequent ``modal`` values (ties: seen first), and n.

    Null keys are a group and null values count as a value; rows without an order don't come first.
    """
    out = rows.groupBy(*by).agg(*(F.min_by(c, order).alias(c) for c in first), F.count("*").alias("n"))
    for c in modal:
        counted = rows.groupBy(*by, c).agg(F.count("*").alias("_n"), (-F.min(order)).alias("_o"))
        best = counted.groupBy(*by).agg(F.max_by(c, F.struct("_n", "_o")).alias(c))
        out = beside(out, best, by)
    return out


def largest_remainder(groups: DataFrame, size: str, total: Column, key: str) -> DataFrame:
    """``groups`` with ``quota``: shares of ``total`` in proportion to ``size``, leftovers to the largest fractions, ties by key.

    ``groups`` has a row for each stratum, so its windows are over the strata, not over the corpus.
    """
    everything = Window.partitionBy(F.lit(0))
    exact = total * F.col(size) / F.sum(size).over(everything)
    g = groups.withColumn("_floor", F.floor(exact)).withColumn("_frac", F.round(exact - F.floor(exact), 9))
    left = total - F.sum("_floor").over(everything)
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_frac"), key))
    return g.withColumn("quota", (F.col("_floor") + (nth <= left).cast("int")).cast("bigint")).drop("_floor", "_frac")


def stratified_split(rows: DataFrame, stratum: str, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``rows`` with ``split``: each stratum's rows in hash order, its quotas cut off in the order of ``shares``; the rest train.

    A null stratum is a stratum, a null key comes first; rows that share a key follow each other in any order.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    n = F.sum("_size").over(Window.partitionBy(F.lit(0)))
    quotas = sizes
    for name, share in shares.items():
        quotas = largest_remainder(quotas, "_size", F.bround(n * share).cast("bigint"), stratum).withColumnRenamed("quota", f"_{name}")
    placed = beside(ranked(rows, [stratum], [hash_order(seed, F.col(key)), key], "_r"), quotas, [stratum])
    split, before = F.lit("train"), F.lit(0)
    edges = []
    for name in shares:
        edges.append((name, before, before + F.col(f"_{name}")))
        before = before + F.col(f"_{name}")
    for name, low, high in reversed(edges):
        split = F.when((F.col("_r") > low) & (F.col("_r") <= high), name).otherwise(split)
    return placed.select(*rows.columns, split.alias("split"))


def group_split(rows: DataFrame, group: str, cell: str, quota_share: float, seed: int = 42) -> DataFrame:
    """``rows`` with ``split``: whole groups go to test in hash order inside their cell while the rows taken before are under the cell's quota.

    A null group or cell is one of its own; no row is lost; the window is over the groups of a cell, not over its rows.
    """
    groups = rows.groupBy(cell, group).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(cell).orderBy(hash_order(seed, F.col(group)), group)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.bround(F.sum("_n").over(Window.partitionBy(cell)) * quota_share)
    taken = groups.withColumn("split", F.when(before < quota, "test").otherwise("train")).select(cell, group, "split")
    return beside(rows, taken, [cell, group])


def weighted_choice(rows: DataFrame, by: list[str], weight: str, key: str, seed: int = 42) -> DataFrame:
    """One row of each group, chosen with probability in proportion to its weight: the least -ln(u)/weight; null and other weights than positive ones never win."""
    race = -F.log(1 - hash_uniform(seed, F.col(key))) / F.col(weight)
    return keep_first(rows.filter(F.col(weight) > 0).withColumn("_r", race), [F.col(c) for c in by], ["_r", key]).drop("_r")


def round_robin(rows: DataFrame, domain: str, size: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, one of each domain in turn, the larger first; a null domain is a domain."""
    turn = F.row_number().over(Window.partitionBy(domain).orderBy(F.desc(size), hash_order(seed, F.col(key)), key))
    return rows.withColumn("turn", turn).orderBy("turn", domain).limit(n)


def round_robin_reused(rows: DataFrame, domain: str, size: str, key: str, n: int, most_uses: int, seed: int = 42) -> DataFrame:
    """``n`` picks from ``rows``, domain by domain in turn, each row up to ``most_uses`` times: pick (from 1) and use (from 0) besides.

    A domain's rows are all used once before any is used again. With fewer than n / most_uses rows, all uses are given.
    """
    of = Window.partitionBy(domain)
    turn = F.row_number().over(of.orderBy(F.desc(size), hash_order(seed, F.col(key)), key))
    numbered = rows.withColumn("_turn", turn).withColumn("_own", F.count("*").over(of))
    uses = numbered.withColumn("use", F.explode(F.sequence(F.lit(0), F.lit(most_uses - 1)))).withColumn("_turn", F.col("_turn") + F.col("use") * F.col("_own"))
    picked = uses.orderBy("_turn", domain).limit(n)
    return picked.withColumn("pick", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_turn", domain))).select(*rows.columns, "use", "pick")


def length_batches(rows: DataFrame, length: str, key: str, batch: int, pool: int = 50, seed: int = 42) -> DataFrame:
    """``rows`` with pool and batch: hash buckets of about ``pool`` batches, sorted by length inside, cut into batches.

    Buckets replace one global shuffle, so no task sees more than a pool; the last batch of a pool may be short. Null lengths
    come first; rows that share a key share a pool; no row gives no batch.
    """
    total = rows.count()
    pools = max(1, -(-total // (batch * pool)))
    pooled = rows.withColumn("pool", F.floor(hash_uniform(seed, F.col(key)) * pools).cast("int"))
    nth = F.row_number().over(Window.partitionBy("pool").orderBy(length, key)) - 1
    return pooled.withColumn("batch", F.floor(nth / batch).cast("int"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order, given back in the order of ``key``; all if ``n`` is 0 or less."""
    picked = rows if n <= 0 else rows.orderBy(hash_order(seed, F.col(key)), key).limit(n)
    return picked.orderBy(key)


def capped_remainder(groups: DataFrame, size: str, total: Column, key: str) -> DataFrame:
    """As ``largest_remainder``, and no quota over its group's ``size``: what a full group can't take is left out."""
    return largest_remainder(groups, size, total, key).withColumn("quota", F.least("quota", F.col(size)))


def quota_sample(rows: DataFrame, group: str, key: str, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """The first rows of each ``group`` in hash order, as many as its ``quota`` in ``quotas`` (group, quota) says; groups without one give none."""
    return beside(ranked(rows, [group], [hash_order(seed, F.col(key)), key], "_r"), quotas.select(group, "quota"), [group]).filter("_r <= quota").select(*rows.columns)


def precedence_quotas(rows: DataFrame, tests: dict[str, tuple[Column, int]], key: str, total: int, seed: int = 42) -> DataFrame:
    """Up to ``total`` rows with ``picked_for``: each test's quota in hash order among the rows no test before it has taken, then any others.

    A row belongs to its first test only, unless that one's quota is full: then to the next that holds. Tests are few,
    so the loop is over plans; each step joins what is taken, which ``total`` bounds.
    """
    order = [hash_order(seed, F.col(key)), F.col(key)]
    taken = None
    for name, (holds, quota) in {**tests, "fill": (F.lit(True), total)}.items():
        left = rows.filter(holds) if taken is None else rows.filter(holds).join(taken.select(key), key, "left_anti")
        room = quota if name != "fill" else total - (taken.count() if taken is not None else 0)
        step = left.orderBy(*order).limit(max(0, min(quota, room))).withColumn("picked_for", F.lit(name)).select(*rows.columns, "picked_for")
        taken = cut(step if taken is None else taken.unionByName(step), "taken")
    return taken


def rename_keys(values: Column, names: Column, seed: int, key: Column, keep: float) -> Column:
    """Map ``values`` with each key kept with probability ``keep``, else renamed to one of its aliases in the map ``names`` (name to array), by hash."""

    def renamed(k: Column, v: Column) -> Column:
        u, choices = hash_uniform(seed, key, k), F.coalesce(F.try_element_at(names, k), F.array(k))
        return F.when(u < keep, k).otherwise(F.element_at(choices, (F.floor(u * 1_000_003) % F.size(choices) + 1).cast("int")))

    return F.transform_keys(values, renamed)


def rank_shards(rows: DataFrame, order: list, world: int) -> DataFrame:
    """``rows`` with ``shard``: places in ``order`` dealt in turn to ``world`` disjoint shards."""
    placed = ranked(rows.withColumn("_all", F.lit(0)), ["_all"], order, "_r")
    return placed.withColumn("shard", F.pmod(F.col("_r") - 1, F.lit(world)).cast("int")).drop("_r", "_all")
