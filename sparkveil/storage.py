"""Where intermediate results are kept, and for how long."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_runs: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir. Where it names none, as in tests, one of this machine's; that is
    only possible if all executors are on it too, so on a cluster it is a RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="sparkveil-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """Tables of `cut_lineage` made within are dropped at its end, so what is made of them has to be written by then."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to a table of its own in the shared folder and read from there: computed once, and safe if executors are lost.

    The table stays until the end of the innermost `temporary_tables`; without one, until the folder is cleared, as tables made
    from it may be read at any time.
    """
    folder = _runs[-1] if _runs else shared_folder(df.sparkSession)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
