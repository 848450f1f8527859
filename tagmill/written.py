"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without it gets a temporary folder; a cluster's is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tagmill-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/tagmill-{uuid.uuid4().hex}/{label}"


def cut(frame: DataFrame, label: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``frame`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs nothing. ``compression`` is the session's unless given."""
    spark = frame.sparkSession
    path = new_folder(spark, label)
    frame.write.parquet(path, compression=compression)
    back = spark.read.schema(frame.schema).parquet(path)
    back._tagmill_path = path
    return back


def forget(*frames: DataFrame | None) -> None:
    """Delete tables that ``cut`` gave and nothing will read again, as the last round's of a loop."""
    for frame in frames:
        path = getattr(frame, "_tagmill_path", None) if frame is not None else None
        if path:
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table is at ``path`` and its last write was finished; any store that Spark reads will do."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
