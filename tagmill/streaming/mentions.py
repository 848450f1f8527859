"""Documents arrive as files; their mentions are appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tagmill.operators.recognise import mentions


def mention_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Start the query: every new Parquet file under ``source`` is read once, and its mentions go to ``sink``, a folder for each batch.

    ``schema`` must have doc_id and text. A batch that is run again after a failure overwrites its own folder, so nothing is
    written twice; the offsets in ``checkpoint`` make a restart go on where it stopped. Stops when no file is left.
    """

    def write(batch: DataFrame, number: int) -> None:
        mentions(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    documents = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
