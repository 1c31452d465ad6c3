"""Small helpers on the session that several operators share."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a small table that share one checkpoint file.
FILE_ROWS = 250_000


def checkpointed(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    ``most_rows`` bounds the rows of a digest that many shuffle partitions would
    scatter over as many small files; it is written as a file for each ``FILE_ROWS``.

    The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
    (a local test session) a folder of our own is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    if most_rows is not None:
        df = packed(df, most_rows)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared checkpoint folder, for rows that several steps read."""
    spark = df.sparkSession
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-tables-")
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that shuffle files of DataFrames that are gone leave the disks now.

    Spark removes them when the driver's JVM happens to do so, half an hour apart by default;
    between two passes over a corpus that is a whole shuffle too late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` in a partition for each ``FILE_ROWS`` of ``most_rows``; steps over one alone need no shuffle."""
    return df.coalesce(max(1, -(-most_rows // FILE_ROWS)))


#: Rows of a few numbers that may be broadcast, some 20 MB.
BROADCAST_ROWS = 500_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its ``rows``, which were counted and hold numbers only, are few; else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: Iterable[dict], schema: str) -> DataFrame:
    """A DataFrame of a few driver-made rows, as a literal in the plan.

    ``schema`` is a DDL field list.  The rows number at most what the calling
    operator's parameters allow (vnodes, templates, sources), never documents.
    """
    text = json.dumps(list(rows), ensure_ascii=False)
    return spark.range(1).select(
        F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>"))
    )


def id_remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus
