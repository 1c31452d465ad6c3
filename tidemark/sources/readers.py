"""Readers: corpora, dumps, nested documents, csv, episodes, optional inputs, file lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType

SEGMENT = (
    "id string, raw_text string, signature string, subsystem string, source_doc string, "
    "symptoms array<string>, ocr_confidence double, component string, links_to array<string>"
)
ANOMALY = (
    "symptom string, subsystem string, documented_cause string, crew_initiated boolean, diagnosed_in_flight boolean, "
    "human_turns_to_diagnosis int, human_time_s double, exchange_quote string"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a JSON array, or of an object's ``segments``; ``ord`` is the place in the array.

    Missing texts are empty, missing lists have no element, a missing id is the word None.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(
        F.coalesce(F.from_json("value", f"array<struct<{SEGMENT}>>"), F.from_json("value", f"segments array<struct<{SEGMENT}>>")["segments"]).alias("s")
    ).select(F.posexplode("s").alias("ord", "s")).select("ord", "s.*")
    return _with_defaults(rows)


def _with_defaults(rows: DataFrame) -> DataFrame:
    texts = [c for c, t in rows.dtypes if t == "string" and c != "id"]
    lists = [c for c, t in rows.dtypes if t == "array<string>"]
    return rows.withColumns(
        {c: F.coalesce(c, F.lit("")) for c in texts}
        | {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists}
        | {"id": F.coalesce("id", F.lit("None"))}
    )


#: What parts a file of a JSON array: the end of an object that another value follows.
_SEPARATOR = "},"


def read_array(spark: SparkSession, path: str, schema: str = SEGMENT) -> DataFrame:
    """(ord, fields): the objects of one file's JSON array, read by as many tasks as the file has splits.

    The file is cut wherever an object ends before a comma, be that within an object or a
    string.  Quotes and brackets are added up over the pieces, within a split and over the
    splits before it, which tells where elements end; their pieces are put together
    again.  ``ord`` is the place in the array however the file is split.  Elements that aren't
    objects of ``schema`` have nulls; an element lies within two splits at most if it is no longer than one.
    """
    pieces = spark.read.text(path, lineSep=_SEPARATOR).select(
        "value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id")
    )
    order = Window.partitionBy("split").orderBy("id")
    # Escapes stand in strings only, so quotes that are left open and close strings in turn.
    bare = pieces.select("split", "id", "value", F.regexp_replace(F.concat("value", F.lit(_SEPARATOR)), r"(?s)\\.", "").alias("bare"))

    def summed(rows: DataFrame, of: Column, name: str) -> DataFrame:
        """``rows`` with the sum of ``of`` over all pieces before."""
        rows = rows.withColumn("__x", of)
        # A row for each split.
        splits = rows.groupBy("split").agg(F.sum("__x").alias("__all"))
        splits = splits.select("split", (F.sum("__all").over(Window.orderBy("split")) - F.col("__all")).alias("__before"))
        here = F.sum("__x").over(order) - F.col("__x")
        return rows.withColumn(name, here).join(F.broadcast(splits), "split").withColumn(name, F.col(name) + F.col("__before")).drop("__before")

    quoted = summed(bare, F.regexp_count("bare", F.lit('"')), "quotes").drop("__x")
    outside = F.regexp_replace(F.concat(F.when(F.col("quotes") % 2 == 1, '"').otherwise(""), "bare"), '"[^"]*("|$)', "")
    turns = F.regexp_count(outside, F.lit(r"[\[{]")) - F.regexp_count(outside, F.lit(r"[\]}]"))
    deep = summed(quoted, turns, "depth").withColumn("after", F.col("depth") + F.col("__x")).drop("__x", "bare")
    closed = (F.col("after") == 1).cast("int")
    numbered = summed(deep, closed, "ord").drop("__x")
    joined = numbered.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("split", "id", "value"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), _SEPARATOR)
    last = F.broadcast(numbered.agg(F.max("ord").alias("last")))
    # The first element opens with the array and the last one closes it; all others lost their end.
    text = F.regexp_replace(text, r"^\s*\[", "")
    whole = F.when(F.col("ord") == F.col("last"), F.regexp_replace(text, r"\s*\]\s*$", "")).otherwise(F.concat(text, F.lit("}")))
    elements = joined.join(last).select(F.col("ord").cast("long").alias("ord"), whole.alias("text")).where(F.trim("text") != "")
    return elements.select("ord", F.from_json("text", schema).alias("s")).select("ord", "s.*")


def read_corpus_split(spark: SparkSession, path: str) -> DataFrame:
    """``read_corpus`` of a file that is one array, by many tasks."""
    return _with_defaults(read_array(spark, path))


def read_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One JSON object a line; a bad line fails the read, or is left out if ``tolerant``."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """(mission, anomaly fields) of every anomaly of every mission; unknown counts (-1) are null.

    The document is an object with ``missions`` or ``results``, one mission by itself, or a list of missions.
    """
    mission = f"struct<mission string, anomalies array<struct<{ANOMALY}>>>"
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"missions array<{mission}>, results array<{mission}>")
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{mission}>"))
    single = F.array(F.from_json("value", f"mission string, anomalies array<struct<{ANOMALY}>>"))
    some = lambda c: F.when(F.size(c) > 0, c)
    doc = whole.select(F.coalesce(listed, some(wrapped["missions"]), some(wrapped["results"]), single).alias("missions"))
    rows = doc.select(F.explode("missions").alias("m")).select("m.mission", F.explode("m.anomalies").alias("a")).select("mission", "a.*")
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return rows.withColumns({c: known(c) for c in ("human_turns_to_diagnosis", "human_time_s")})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the header."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_episode(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, turn, get, speaker, text) of an episode's utterances, turns from 1."""
    schema = "episode_id string, input_utterances array<struct<get string, speaker string, text string, verified string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select("episode_id", F.posexplode("input_utterances").alias("p", "u")).select(
        "episode_id", (F.col("p") + 1).alias("turn"), "u.get", "u.speaker", "u.text"
    )


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, report_end_get, wanted, name, get, delta) of an episode's human baseline."""
    point = "struct<name string, get string, delta_from_report_end_s double>"
    schema = f"episode_id string, human_baseline struct<report_end_get string, default_diagnosis_checkpoint string, checkpoints array<{point}>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select("episode_id", "human_baseline.*").select(
        "episode_id", "report_end_get", F.col("default_diagnosis_checkpoint").alias("wanted"), F.explode("checkpoints").alias("c")
    ).select("episode_id", "report_end_get", "wanted", "c.name", "c.get", F.col("c.delta_from_report_end_s").alias("delta"))


def read_anchor(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, symptom, component_terms, documented_cause) of an episode's resolution."""
    schema = "episode_id string, resolution_anchor struct<symptom string, component_terms array<string>, documented_cause string>"
    return spark.read.schema(schema).json(path, multiLine=True).select("episode_id", "resolution_anchor.*")


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """(place, mission, query, subsystem, scope, relevant, expect_decline) in the order of the document."""
    schema = "scenarios array<struct<mission string, query string, subsystem string, scope string, relevant array<string>, expect_decline boolean>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("scenarios").alias("place", "s")).select("place", "s.*")


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(mission, nth, component_terms) of every mission's anchors, numbered over all entries of a mission from 1."""
    schema = "missions array<struct<mission string, anchors array<struct<component_terms array<string>>>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("missions").alias("p", "m")).select(
        "p", "m.mission", F.posexplode("m.anchors").alias("q", "a")
    )
    nth = F.row_number().over(Window.partitionBy("mission").orderBy("p", "q"))
    return each.select("mission", nth.alias("nth"), "a.component_terms")


def with_anchors(scenarios: DataFrame, anchors: DataFrame) -> DataFrame:
    """``scenarios`` with the anchor of the same place among their mission's scenarios inside the scope; else null."""
    inside = F.when(F.col("scope") == "in", 1)
    nth = F.when(F.col("scope") == "in", F.sum(inside).over(Window.partitionBy("mission").orderBy("place")))
    return scenarios.withColumn("nth", nth.cast("int")).join(anchors, ["mission", "nth"], "left").drop("nth")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc, status) of the documents that an earlier run finished; none where there is no manifest or an empty one."""
    return optional(spark, lambda: read_lines(spark, path, "doc string, status string", tolerant=True), "doc string, status string").where("doc is not null")


def optional(spark: SparkSession, read: Callable[[], DataFrame], schema: str | StructType) -> DataFrame:
    """``read()``, or no rows of ``schema`` where the path doesn't exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length) of all files below the folder, smallest first; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length").orderBy("length", "path")


def read_power_log(spark: SparkSession, path: str) -> DataFrame:
    """Mean and peak watts of a telemetry log's ``VDD_IN`` readings."""
    mw = F.regexp_extract("value", r"VDD_IN (\d+)mW", 1)
    return spark.read.text(path).where(mw != "").agg((F.avg(mw.cast("int")) / 1000).alias("mean_w"), (F.max(mw.cast("int")) / 1000).alias("peak_w"))
