"""Ranks inside large groups, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.written import cut


def _placed(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """``rows``, written in range partitions by group and order, with ``_at``, which rises along them."""
    parts = max(4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = rows.select("*", *(F.expr(c).alias(f"_o{i}") if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [*by, *(f"_o{i}" for i in range(len(order)))]
    return cut(marked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")


def running_total(rows: DataFrame, by: list[str], order: list, amount: str, name: str = "upto") -> DataFrame:
    """``rows`` with ``name``, the sum of ``amount`` over the rows of the group up to and with this one, and ``name``_all, that of the group.

    As ``ranked``: a group spreads over range partitions; sums run inside a group's part of a partition, to which the
    parts before are added. Null amounts count as none; null groups are groups; no row gives no row.
    """
    placed = _placed(rows, by, order).withColumn("_part", F.shiftrightunsigned("_at", 33))
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    own = [f"_g{i}" for i in range(len(by))]
    value = F.coalesce(F.col(amount), F.lit(0))
    pieces = placed.groupBy(*groups, F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*own).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = cut(pieces.withColumn("_before", before).withColumn("_all", F.sum("_sum").over(Window.partitionBy(*own))), "pieces")
    inside = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_part") == F.col("_p")
    for c, g in zip(by, own, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    summed = placed.withColumn("_inside", inside).join(pieces, same)
    return summed.select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name), F.col("_all").alias(f"{name}_all"))


def ranked(rows: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: the place from 1 of each row in its group by ``order`` (columns or their names).

    Rows are range-partitioned by group and order, so that a group of any size spreads over many tasks; a row's place is its
    place in its partition's part of the group, and the rows of the group in the partitions before. The table of
    those parts has a row for each partition and each group, and is joined by Spark's own choice. Null groups are groups;
    rows equal in ``order`` are told apart arbitrarily but for good, as they are written first; no row gives no row.
    """
    placed = _placed(rows, by, order)
    part = F.shiftrightunsigned("_at", 33)
    pieces = placed.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(f"_g{i}" for i in range(len(by)))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = cut(pieces.withColumn("_before", before), "pieces")
    same = part == F.col("_part")
    for i, c in enumerate(by):
        same = same & placed[c].eqNullSafe(F.col(f"_g{i}"))
    place = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long").alias(name)
    return placed.join(pieces, same).select(*(placed[c] for c in rows.columns), place)
