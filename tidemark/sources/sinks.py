"""Writers: appended and overwritten JSON, csv, per-document checkpoints, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)


def checkpoint_documents(segments: DataFrame, path: str, by: str = "source_doc") -> None:
    """Replace the given documents' partitions and leave all others."""
    segments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def markdown(summary: DataFrame, limit: int = 200) -> str:
    """A table of a small result; more than ``limit`` rows is an error, not a cut."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    cell = lambda v: "" if v is None else str(v)
    head = [summary.columns, ["---"] * len(summary.columns)]
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in [*head, *rows])


def console(summary: DataFrame, width: int = 24, limit: int = 200) -> str:
    """A small result in columns of a fixed width; longer values are cut to it."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    cell = lambda v: ("" if v is None else str(v))[:width].ljust(width)
    return "\n".join(" ".join(map(cell, r)).rstrip() for r in [summary.columns, *rows])


def write_manifest(documents: DataFrame, path: str) -> None:
    """Append (doc, status) of finished documents, for ``readers.read_manifest``."""
    documents.select("doc", "status").write.mode("append").json(path)


def write_priors(priors: DataFrame, path: str) -> None:
    priors.select("node", F.col("prior").cast("double").alias("prior")).write.mode("overwrite").json(path)
