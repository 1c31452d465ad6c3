"""Row filters and labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import contains_any, terms


def is_boilerplate(raw: Column) -> Column:
    """Front matter, lists of figures and nearly empty pages."""
    t = F.lower(F.coalesce(raw, F.lit("")))
    n = F.size(terms(raw, "[a-z]{3,}"))
    pages = F.regexp_count(t, F.lit("figure")) + F.regexp_count(t, F.lit(" page "))
    revised = F.contains(t, F.lit("basic date")) | F.contains(t, F.lit("changed"))
    # One by one, so that the text is lowered once, not for each marker.
    marked = reduce(or_, [F.contains(t, F.lit(m)) for m in L.BOILERPLATE_MARKERS])
    return (n < 6) | marked | ((pages >= 3) & (n < 50)) | (revised & (n < 12))


def clean_corpus(segments: DataFrame, raw: str = "raw_text") -> DataFrame:
    return segments.where(~is_boilerplate(F.col(raw)))


def counted_corpus(segments: DataFrame, raw: str = "raw_text", low: float = 70.0, reasons: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[], dict]]:
    """(the segments that ``clean_corpus`` keeps, what tells the ingest's figures once they were read).

    The figures are gathered in the pass that filters: n_segments, n_kept, n_dropped, n_subsystem, n_symptoms,
    mean_confidence (null without any), n_low (confidence below ``low``) and, with a column
    ``failure``, n_failures and a count of each of ``reasons`` before the first colon; ``failures_other``
    counts the rest.  The second value waits for a read of the first, whole, and gives that read's figures.
    """
    seen = Observation()
    dropped = is_boilerplate(F.col(raw))
    held = lambda c, test: F.count_if(test if c in segments.columns else F.lit(False))
    figures = [
        F.count(F.lit(1)).alias("n_segments"), F.count_if(~dropped).alias("n_kept"), F.count_if(dropped).alias("n_dropped"),
        held("subsystem", F.col("subsystem") != "").alias("n_subsystem"), held("symptoms", F.size("symptoms") > 0).alias("n_symptoms"),
    ]
    if "ocr_confidence" in segments.columns:
        figures += [F.avg("ocr_confidence").alias("mean_confidence"), F.count_if(F.col("ocr_confidence") < low).alias("n_low")]
    if "failure" in segments.columns:
        reason = F.split("failure", ":")[0]
        figures.append(F.count("failure").alias("n_failures"))
        figures += [F.count_if(reason == r).alias(f"failures_{r}") for r in reasons]
        figures.append(F.count_if(reason.isNotNull() & ~reason.isin(*reasons)).alias("failures_other"))
    return segments.observe(seen, *figures).where(~dropped), lambda: seen.get


def out_of_domain(symptom: Column) -> Column:
    """The leftmost term of equipment that no manual covers, as written; null within the domain."""
    found = F.regexp_extract(F.coalesce(symptom, F.lit("")), "(?i)" + "|".join(L.OUT_OF_DOMAIN), 0)
    return F.nullif(found, F.lit(""))


def in_corpus_domain(subsystem: Column, symptom: Column) -> Column:
    both = F.lower(F.concat(F.coalesce(subsystem, F.lit("None")), F.lit(" "), F.coalesce(symptom, F.lit("None"))))
    return ~contains_any(both, L.OUT_SUBSYSTEMS)


def is_in_corpus(subsystem: Column) -> Column:
    return contains_any(F.lower(subsystem), L.IN_SUBSYSTEMS)


def scope_label(subsystem: Column, audited: bool = False) -> Column:
    """False, True or null (undecided); out-of-scope words are asked first."""
    outside, inside = (L.AUDIT_OUT, L.AUDIT_IN) if audited else (L.LABEL_OUT, L.LABEL_IN)
    s = F.lower(subsystem)
    return F.when(contains_any(s, outside), False).when(contains_any(s, inside), True)


def is_fair(subsystem: Column, cause: Column) -> Column:
    """In scope and with a cause that can be known."""
    return ~contains_any(F.lower(subsystem), L.UNFAIR_SUBSYSTEMS) & ~F.coalesce(cause, F.lit("")).rlike("(?i)" + L.UNKNOWABLE)


def is_skip(answer: Column) -> Column:
    """Empty, or SKIP after marks of emphasis."""
    t = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    return (t == "") | F.startswith(F.regexp_replace(F.upper(t), r"^[*_ ]+", ""), F.lit("SKIP"))


def names_subsystem(decision: Column, subsystem: Column, declined: Column) -> Column:
    """Whether a decision that wasn't declined names its subsystem.

    A known subsystem is looked for by its aliases, folded into one alternation each, in
    a map that is a literal of the plan; any other by its own words of three letters or
    more, or whole.  An empty subsystem matches every decision.
    """
    key = F.lower(F.regexp_replace(F.coalesce(subsystem, F.lit("")), r"^\s+|\s+$", ""))
    known = F.create_map(*[F.lit(x) for k, v in L.ALIASES.items() for x in (k, "|".join(v))])
    own = F.filter(F.split(key, "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    quoted = lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))
    other = F.when(F.size(own) > 0, F.array_join(F.transform(own, quoted), "|")).otherwise(quoted(key))
    pattern = F.coalesce(F.try_element_at(known, key), other)
    return ~F.coalesce(declined, F.lit(False)) & F.regexp_like(F.lower(F.coalesce(decision, F.lit(""))), pattern)


def document_type(stem: Column) -> Column:
    s = F.lower(stem)
    has = lambda w: F.contains(s, F.lit(w))
    return (
        F.when(has("anomaly") | has("-report"), "anomaly_report")
        .when(has("rule"), "flight_rule")
        .when(has("mp"), "malfunction_procedure")
        .when(has("fr"), "flight_rule")
        .when(has("ar"), "anomaly_report")
        .otherwise("malfunction_procedure")
    )


def document_class(name: Column) -> Column:
    """struct(class, marker): historical markers win; without any marker a document is historical."""
    s = F.lower(name)
    first = lambda values: F.get(F.filter(F.array(*map(F.lit, values)), lambda m: F.contains(s, m)), F.lit(0))
    old, used = first(L.HISTORICAL), first(L.OPERATIONAL)
    kind = F.when(old.isNull() & used.isNotNull(), "OPERATIONAL").otherwise("HISTORICAL")
    return F.struct(kind.alias("class"), F.coalesce(old, used, F.lit("(none)")).alias("marker"))


def closed_schema(triples: DataFrame) -> DataFrame:
    """Triples whose types and relation belong to the closed schema."""
    return triples.where(
        F.col("subject_type").isin(*L.ENTITY_TYPES)
        & F.col("object_type").isin(*L.ENTITY_TYPES)
        & F.col("relation").isin(*L.RELATION_TYPES)
    )
