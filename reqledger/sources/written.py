"""Tables written to the shared folder to cut a lineage or to be read more than once, and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..streaming.streams import shared_root


def written(df: DataFrame, tag: str) -> DataFrame:
    folder = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.__dict__["written_at"] = folder
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    spark, folder = df.sparkSession, df.__dict__.get("written_at")
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
