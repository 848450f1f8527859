"""Writers: JSON lines by split, numbered review files, small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.operators.ranking import ranked

#: Rows of a report that may come to the driver.
REPORT_ROWS = 10_000


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder for each value of ``split``."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_files_of(rows: DataFrame, path: str, size: int, by: str, order: str) -> None:
    """JSON lines, ``size`` rows a file in ``order``, counted inside each value of ``by`` over range partitions.

    The files are dealt to a fixed number of tasks: a task's cost is its files, not its bytes, by which adaptive execution would put them all into one.
    """
    tasks = max(4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = ranked(rows, [by], [order], "_nth").withColumn("file", F.floor((F.col("_nth") - 1) / size).cast("int")).drop("_nth")
    placed.repartition(tasks, by, "file").sortWithinPartitions(by, "file", order).write.mode("overwrite").partitionBy(by, "file").json(path)


def report(rows: DataFrame) -> str:
    """A small result as JSON text, rows in order; more than REPORT_ROWS are refused."""
    found = rows.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    return json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, default=str)


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small result as a Markdown table; numbers get one decimal."""
    found = json.loads(report(rows.select(*columns)))
    cell = lambda v: f"{v:.1f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in found)])


def append_flags(rows: DataFrame, path: str) -> None:
    """Add ``rows`` as JSON lines to the files that are there."""
    rows.write.mode("append").json(path)


def graph_tables(edges: DataFrame, path: str) -> None:
    """Vertices (id, degree) and edges (a, b, …) of a graph as two Parquet tables under ``path``."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"))
    ends.groupBy("id").agg(F.count("*").alias("degree")).write.mode("overwrite").parquet(f"{path}/vertices")


def write_typed(rows: DataFrame, path: str) -> None:
    """Parquet with plain columns as they are and nested ones (arrays, structs, maps) as JSON text, for readers that know no nesting; nulls stay null."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "struct", "map")}
    rows.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns)).write.mode("overwrite").parquet(path)
