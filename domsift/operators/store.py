"""Tables written once in the shared folder, so that lineage is cut and sizes are known."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from domsift.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again.

    Unlike a cached table it survives lost executors, and the planner broadcasts
    it only if the bytes written are below its own threshold.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
