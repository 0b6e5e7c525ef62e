"""Stage tables: a step's rows, written once to the folder that all executors share and read by every step after it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, read from a new folder in spark.checkpoint.dir, or in local mode, where it is unset, in a temporary one.

    A lazy result may read the folder as long as the session lasts, so it is left to whoever clears spark.checkpoint.dir.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
