"""Frozen builds: partitions that are rewritten only if they changed, and published only if their invariants hold."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.written import complete, cut


class Published(NamedTuple):
    """What a build did: partitions written and partitions taken away, and where data and manifest are."""

    changed: list
    removed: list
    data: str
    manifest: str


def manifest_of(rows: DataFrame, by: str) -> DataFrame:
    """(by, rows, checksum): of each partition its number of rows and the sum of the first 32 bits of their MD5, which no order changes."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)]
    mark = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *columns)), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(mark).alias("checksum"))


def publish(rows: DataFrame, path: str, by: str, invariants: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> Published:
    """Write ``rows`` to ``path``/data, partitioned by ``by``, and their manifest to ``path``/manifest.

    Each invariant gets the rows and their manifest and returns what breaks it; a single row there fails the build, before
    anything under ``path`` is touched. Only partitions whose manifest row differs from the published one are written,
    by overwriting just these; partitions that are gone are deleted; the manifest comes last, so that a build that is cut off is
    done anew by the next run. The values of ``by`` are few: folders. A second build of the same rows writes nothing.
    """
    spark = rows.sparkSession
    staged = cut(rows, "staged")
    new = cut(manifest_of(staged, by), "manifest")
    broken = [name for name, test in invariants.items() if not test(staged, new).isEmpty()]
    if broken:
        raise ValueError(f"not published, broken: {', '.join(broken)}")
    data, manifest = f"{path}/data", f"{path}/manifest"
    old = cut(spark.read.parquet(manifest), "manifest") if complete(spark, manifest) else new.limit(0)
    equal = lambda a, b, columns: [a[c].eqNullSafe(b[c]) for c in columns]
    both = lambda a, b, columns: a.join(b, equal(a, b, columns), "left_anti")
    changed = [r[0] for r in both(new, old, [by, "rows", "checksum"]).select(by).collect()]
    removed = [r[0] for r in both(old, new, [by]).select(by).collect()]
    if changed or removed:
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{manifest}/_SUCCESS")
        store = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        store.delete(mark, False)  # until the new one is there, the next run compares with nothing
        if changed:
            known = [v for v in changed if v is not None]
            wanted = F.col(by).isin(*known) if known else F.lit(False)
            part = staged.filter(wanted | (F.col(by).isNull() if None in changed else F.lit(False)))
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(data)
        for value in removed:
            folder = "__HIVE_DEFAULT_PARTITION__" if value is None else value
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{data}/{by}={folder}"), True)
        new.coalesce(1).write.mode("overwrite").parquet(manifest)
    return Published(sorted(changed, key=str), sorted(removed, key=str), data, manifest)


def label_subsets(docs: DataFrame, mentions: DataFrame, key: str, subsets: dict[str, list[str]]) -> DataFrame:
    """``docs`` once for each subset with a mention of one of its labels, with ``subset``: semi-joins, so a document's mentions don't repeat it."""
    out = None
    for name, labels in subsets.items():
        own = docs.join(mentions.filter(F.col("label").isin(*labels)).select(key), key, "left_semi").withColumn("subset", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.limit(0).withColumn("subset", F.lit(""))
