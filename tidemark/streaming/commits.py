"""Exactly-once writes: parts are staged, and one entry in a log of commits publishes them.

    <path>/parts/<commit>-<random>/bucket=<b>/...   staged Parquet files
    <path>/commits/<commit>.json                   the folder that the commit publishes

A reader takes the folders that the log names and no others.  An entry is renamed into
place, which fails if the commit is there already; so a writer that dies before that
leaves files that nobody reads, and one that repeats a commit adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sessions import not_done

BUCKETS = 16


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def entries(self) -> dict[int, str]:
        """Commit -> published folder."""
        names = [n for n in self._listed("commits") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return {}
        rows = self.spark.read.schema("commit long, folder string").json([f"{self.path}/commits/{n}" for n in names]).collect()
        return {r["commit"]: r["folder"] for r in sorted(rows)}

    def publish(self, commit: int, stage: Callable[[str], None]) -> bool:
        """Have ``stage`` write a new folder and publish it as ``commit``; False if that commit was there before."""
        entry = self._path(f"{self.path}/commits/{commit:020d}.json")
        if self._fs.exists(entry):
            return False
        folder = f"{commit:020d}-{uuid.uuid4().hex}"
        stage(f"{self.path}/parts/{folder}")
        draft = self._path(f"{self.path}/commits/.{folder}")
        out = self._fs.create(draft, False)
        out.write(json.dumps({"commit": commit, "folder": folder}).encode())
        out.close()
        try:
            placed = not self._fs.exists(entry) and self._fs.rename(draft, entry)
        except Py4JJavaError:
            placed = False
        if not placed:
            self._fs.delete(draft, False)
        return placed

    def next(self) -> int:
        """The number after the last commit, for batch writers."""
        names = [n for n in self._listed("commits") if n.endswith(".json") and not n.startswith(".")]
        return int(names[-1][:20]) + 1 if names else 0

    def published(self, schema: str) -> DataFrame:
        """All published rows, with ``commit``; ``schema`` is a field list that may leave columns out."""
        entries = self.entries()
        named = f"{schema}, bucket int" if "bucket" not in schema.split() else schema
        if not entries:
            return self.spark.createDataFrame([], f"{named}, commit long")
        base = f"{self.path}/parts"
        rows = self.spark.read.schema(named).option("basePath", base).option("recursiveFileLookup", "false")
        each = [rows.option("basePath", f"{base}/{f}").parquet(f"{base}/{f}").withColumn("commit", F.lit(c).cast("long")) for c, f in entries.items()]
        out = each[0]
        for part in each[1:]:
            out = out.unionByName(part)
        return out

    def orphans(self, delete: bool = False) -> list[str]:
        """Staged folders that no entry names, and drafts of entries; ``delete`` only while nobody writes."""
        named = set(self.entries().values())
        found = [f"parts/{n}" for n in self._listed("parts") if n not in named]
        found += [f"commits/{n}" for n in self._listed("commits") if n.startswith(".") and not n.endswith(".crc")]
        if delete:
            for name in found:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return found


def _bucketed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))


def _fields(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)


def exactly_once_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: each micro-batch is one commit, and a key is written once.

    Of what is published only the keys in the batch's buckets are read.  A batch that is run
    again after a failure is published once; its first files stay unread.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, path)
        rows = _bucketed(batch.dropDuplicates(keys), keys)

        def stage(folder: str) -> None:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
            have = log.published(_fields(rows, keys)).where(F.col("bucket").isin(touched))
            not_done(rows, have.select(*keys), keys).write.partitionBy("bucket").parquet(folder)

        log.publish(batch_id, stage)

    return write


def published_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return CommitLog(spark, path).published(schema).drop("bucket", "commit")


def publish_documents(segments: DataFrame, path: str, by: str = "source_doc", status: str = "done") -> bool:
    """Publish documents' segments and their manifest rows together; documents published before are replaced."""
    log = CommitLog(segments.sparkSession, path)
    staged = _bucketed(segments.withColumn("status", F.lit(status)), [by])
    return log.publish(log.next(), lambda folder: staged.write.partitionBy("bucket").parquet(folder))


def published_documents(spark: SparkSession, path: str, schema: str, by: str = "source_doc") -> tuple[DataFrame, DataFrame]:
    """(segments, manifest (doc, status)): each document as its last commit left it."""
    rows = CommitLog(spark, path).published(f"{schema}, status string")
    # A row for each document and commit at most, before the window.
    last = rows.groupBy(by, "commit").agg(F.max("status").alias("status"))
    last = last.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("commit")))).where("r = 1")
    kept = rows.drop("status").join(last.select(by, "commit"), [by, "commit"], "left_semi").drop("bucket", "commit")
    return kept, last.select(F.col(by).alias("doc"), "status")
