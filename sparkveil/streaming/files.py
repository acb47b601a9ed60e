"""Transcript files as a stream: each file is a whole transcript, so every micro-batch is de-identified exactly as a batch is.

Turns that arrive one by one can't be done so: a name met late changes turns that came before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkveil.plans.pipeline import deidentify
from sparkveil.sources import sinks, transcripts
from sparkveil.storage import temporary_tables

_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def watch(spark: SparkSession, directory: str, output: str, state: str, detector: Callable[[DataFrame], DataFrame] | None = None, residual: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """De-identifies files as they come to the directory. state: folder of the stream's checkpoint; a file is done once.

    Each micro-batch writes its tables to a folder of its own number, so one that is run again replaces its results.
    """
    stream = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.{txt,json,TXT,JSON}").load(directory)

    def done(files: DataFrame, number: int) -> None:
        with temporary_tables(files.sparkSession):
            loaded = transcripts.load(files.select("path", "content"))
            result = deidentify(loaded.turns, detector(loaded.turns) if detector else None, residual)
            sinks.write_tables(result, f"{output}/batch={number}")
            loaded.errors.write.mode("overwrite").json(f"{output}/batch={number}/errors")

    writer = stream.writeStream.foreachBatch(done).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
