"""Chunking of paged text: offsets, headings, span confidence, triples to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_spans

# Fixed value: what counts as a numbered heading.
HEADING = r"(?m)^\s*((?:MP|FR|AR)-[A-Z]+-\d+(?:\.\d+)?|\d+(?:\.\d+){1,3}|Procedure\s+\d+-\d+)\b"


def page_offsets(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """``off`` of each page in the text of all pages joined by one character."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("off", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))).withColumn("len", F.length(text))


# The same in Java's terms: lines end at \n, and blanks, digits and letters are those of Unicode.
_HEADING = (
    r"(?mdU)^[\s\x1c-\x1f]*((?:MP|FR|AR)-[A-Z]+-\p{Nd}+(?:\.\p{Nd}+)?|\p{Nd}+(?:\.\p{Nd}+){1,3}|Procedure[\s\x1c-\x1f]+\p{Nd}+-\p{Nd}+)(?![\p{L}\p{N}_])"
)


def headings(docs: DataFrame) -> DataFrame:
    """(doc, start, heading) of every heading line; docs: doc, text.  A null text has none."""
    found = docs.select("doc", F.explode(match_spans(F.col("text"), _HEADING)).alias("m"))
    return found.select("doc", F.col("m.start").cast("long").alias("start"), F.regexp_extract("m.hit", _HEADING, 1).alias("heading"))


def heading_segments(marks: DataFrame, lengths: DataFrame, least: int = 20) -> DataFrame:
    """(doc, heading, start, end): a segment ends where the next heading starts, or with the text."""
    onward = Window.partitionBy("doc").orderBy("start")
    spans = marks.join(lengths, "doc").withColumn("end", F.coalesce(F.lead("start").over(onward), F.col("length")))
    return spans.where(F.col("end") - F.col("start") > least).select("doc", "heading", "start", "end")


def span_confidence(segments: DataFrame, pages: DataFrame, width: int = 4096) -> DataFrame:
    """Mean confidence of the pages a segment overlaps, 0 without any.

    Both sides are dealt into buckets of ``width`` characters and joined on them, so a
    range join costs no nested loop; a pair is counted in the bucket where it first meets.
    An empty page strictly inside a segment counts.
    """
    bucketed = lambda df, lo, hi: df.withColumn("b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = bucketed(pages.withColumn("p_end", F.col("off") + F.col("len")), "off", "p_end")
    s = bucketed(segments, "start", "end")
    met = s.join(p, ["doc", "b"]).where(
        (F.col("off") < F.col("end")) & (F.col("p_end") > F.col("start"))
        & (F.col("b") == F.greatest(F.floor(F.col("off") / width), F.floor(F.col("start") / width)))
    )
    mean = met.groupBy("doc", "start", "end").agg(F.avg("conf").alias("confidence"))
    return segments.join(mean, ["doc", "start", "end"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def parsed_triples(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """(seg_id, pos, ...) of each answer's triples; an answer that isn't JSON has none."""
    schema = "triples array<struct<subject string, subject_type string, relation string, object string, object_type string>>"
    return answers.select("seg_id", F.from_json(payload, schema).alias("j")).select("seg_id", F.posexplode("j.triples").alias("pos", "t")).select(
        "seg_id", "pos", "t.*"
    )


def triples_to_segments(triples: DataFrame) -> DataFrame:
    """Subsystem, component, symptoms, links and signature of each segment from its triples, in order."""
    rows = triples.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "subject", "subject_type", "relation", "object"))).alias("ts"))
    pick = lambda field, test: F.transform(F.filter("ts", test), lambda t: t[field])
    located = lambda t: t["relation"] == "locatedIn"
    names = F.concat(F.transform("ts", lambda t: t["subject"]), F.transform("ts", lambda t: t["object"]))
    return rows.select(
        "seg_id",
        F.get(pick("object", located), F.lit(0)).alias("subsystem"),
        F.get(pick("subject", located), F.lit(0)).alias("component"),
        pick("subject", lambda t: (t["relation"] == "indicates") & (t["subject_type"] == "Symptom")).alias("symptoms"),
        pick("object", lambda t: t["relation"].isin("references", "precedes")).alias("links_to"),
        F.array_join(F.array_sort(F.array_distinct(names)), ", ").alias("signature"),
    )
