"""Cutting lineage between the rounds of an iterative plan, and tables that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the reliable checkpoint folder, so that later rounds don't compute it again.

    The folder is the session's ``spark.checkpoint.dir``; a local session without one gets its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed Parquet table of its own in the same folder, for wide rows and for those read more than once."""
    shared = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
