"""Readers beside Parquet tables: JSON lines, strict or with quarantine, weighted CSV lists, tuples of SQL dumps, JSON dimensions, gold and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BAD = "_bad_line"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines; a line that doesn't fit ``schema`` fails the job, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_jsonl_quarantine(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): the same scan split by whether the parser kept the line."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("row"))
    good = parsed.filter(F.col(f"row.{_BAD}").isNull() & F.col("row").isNotNull()).select("row.*").drop(_BAD)
    return good, parsed.filter(F.col(f"row.{_BAD}").isNotNull() | F.col("row").isNull()).select(F.col("value").alias("line"))


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    """(name, weight) of a CSV list with a header; rows without a positive weight are left out."""
    return spark.read.schema("name string, weight double").option("header", True).csv(path).filter("name is not null and weight > 0")


def normalise_shape(rows: DataFrame) -> DataFrame:
    """(input, output): records that say ``text`` for ``input`` or ``schema`` for ``output`` come out alike."""
    def first(*names: str) -> Column:
        there = [F.col(n) for n in names if n in rows.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    return rows.select(first("input", "text").alias("input"), first("output", "schema").alias("output"))


def surfaces_to_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, label): where the surfaces of (doc_id, text, mentions: label, surface) occur as whole words.

    Each surface is looked for from one occurrence to the next by position, so special characters need no escaping; an
    occurrence counts if no word character touches it.
    """
    each = docs.select("doc_id", "text", F.inline("mentions")).filter("surface is not null and surface <> ''").distinct()
    pieces = F.split(F.col("text"), F.concat(F.lit(r"\Q"), F.replace(F.col("surface"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    sized = each.select("doc_id", "text", "label", "surface", F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("n", "piece"))
    by = Window.partitionBy("doc_id", "label", "surface").orderBy("n")
    start = (F.sum(F.length("piece") + F.length("surface")).over(by) - F.length("surface")).cast("int")
    placed = sized.withColumn("start", start).withColumn("end", (start + F.length("surface")).cast("int"))
    touches = F.coalesce(F.substring("text", F.col("start"), F.lit(1)).rlike(r"[\p{L}\p{N}_]") & (F.col("start") > 0), F.lit(False)) | F.coalesce(F.substring("text", F.col("end") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}_]"), F.lit(False))
    return placed.filter(~touches).select("doc_id", "start", "end", "label")


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file or folder by its ending: .parquet, .jsonl or .ndjson, .json (whole documents), .csv or .tsv with a header; others are refused."""
    reader = spark.read.schema(schema) if schema else spark.read
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        return reader.parquet(path)
    if ending in ("jsonl", "ndjson"):
        return reader.json(path)
    if ending == "json":
        return reader.option("multiLine", True).json(path)
    if ending in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if ending == "tsv" else ",").csv(path)
    raise ValueError(f"no reader for {path!r}")


def read_dump(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """Text columns of the tuples in the VALUES lists of an SQL dump; tuples of another width are left out, NULL is null.

    A line may hold many tuples; a tuple stands on one line. Strings are in single quotes, with a quote doubled or after a backslash.
    """
    item = r"'(?:[^'\\]|\\.|'')*'|[^,()'\s][^,()']*"
    row = rf"\((?:\s*(?:{item})\s*,)*\s*(?:{item})\s*\)"
    tuples = spark.read.text(paths).select(F.explode(F.regexp_extract_all("value", F.lit(row), F.lit(0))).alias("row"))
    parts = tuples.select(F.regexp_extract_all("row", F.lit(item), F.lit(0)).alias("p")).filter(F.size("p") == len(columns))

    def value(c: Column) -> Column:
        bare = F.substring(c, F.lit(2), F.length(c) - 2)
        text = F.regexp_replace(F.regexp_replace(bare, r"\\(.)", "$1"), "''", "'")
        return F.when(c.startswith("'"), text).when(F.upper(F.trim(c)) != "NULL", F.trim(c))

    return parts.select(*(value(F.col("p")[i]).alias(n) for i, n in enumerate(columns)))


def read_dimensions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all JSON files of a folder, each an array of records, with ``_file``: the file's name without ending."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("_file", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", ""))


def read_gold(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(docname, start, end, label) of gold JSON lines that hold a list ``spans`` of offsets; spans without a label are left out."""
    rows = read_jsonl(spark, paths, "docname string, spans array<struct<start:int,end:int,label:string>>")
    return rows.select("docname", F.inline("spans")).filter("label is not null")


def last_predictions(rows: DataFrame) -> DataFrame:
    """(docname, spans) with one row for each document of ``rows`` (docname, line, spans): the one of the last line."""
    return rows.groupBy("docname").agg(F.max_by("spans", "line").alias("spans"))


def read_typed(spark: SparkSession, path: str, nested: dict[str, str]) -> DataFrame:
    """A table whose ``nested`` columns (name to type) are JSON text, as ``write_typed`` leaves them, with these parsed; a text that doesn't fit fails the job."""
    rows = spark.read.parquet(path)
    return rows.select(*(F.from_json(c, nested[c], {"mode": "FAILFAST"}).alias(c) if c in nested else F.col(c) for c in rows.columns))
