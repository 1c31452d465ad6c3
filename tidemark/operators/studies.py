"""Figures of the evaluation studies: grounding, gaps, chain structure, sweeps, annunciations, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import contains_any, normalized


def subsystem_of(symptom: Column, assignments: tuple[tuple[str, str], ...]) -> Column:
    """The subsystem of the first assignment whose text stands in the symptom, whatever its case; null if none does."""
    lower = F.lower(F.coalesce(symptom, F.lit("")))
    return F.coalesce(*[F.when(F.contains(lower, F.lit(part.lower())), F.lit(name)) for part, name in assignments])


def action_gist(output: Column) -> Column:
    """struct(power_down_cm, lm_lifeboat): whether a diagnosis proposes either."""
    text = normalized(output)
    return F.struct(
        contains_any(text, L.POWER_DOWN).alias("power_down_cm"),
        (contains_any(text, L.LANDER) & contains_any(text, L.LANDER_USE)).alias("lm_lifeboat"),
    )


def agreement_text(consensus: Column, n_points: Column, term: Column, cut: int = L.CONSENSUS_CUT) -> Column:
    """The line that tells whether a diagnosis' sources agree."""
    votes, n = F.coalesce(consensus, F.lit(0)).cast("string"), F.coalesce(n_points, F.lit(0)).cast("string")
    agreed = F.concat(F.lit("agreement: "), votes, F.lit(" of "), n, F.lit(" sources converge on '"), term, F.lit("'"))
    top = F.coalesce(F.concat(F.lit(" (top term '"), F.nullif(term, F.lit("")), F.lit("', "), votes, F.lit("/"), n, F.lit(")")), F.lit(""))
    scattered = F.concat(F.lit("low agreement — leads scatter; treat as uncertain, verify each"), top)
    return F.when((consensus >= cut) & (F.coalesce(term, F.lit("")) != ""), agreed).otherwise(scattered)


def _share(hit: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(hit & of), F.count_if(of)), F.lit(0.0))


def breadth_gap(rows: DataFrame, inside: str, hit: str, declined: str) -> DataFrame:
    """(n_in, n_out, rate_in, rate_out, gap_pp, declined_in, declined_out); an empty side has a rate of 0."""
    within = F.coalesce(F.col(inside), F.lit(False))
    right = F.coalesce(F.col(hit), F.lit(False))
    rates = rows.agg(
        F.count_if(within).alias("n_in"), F.count_if(~within).alias("n_out"), _share(right, within).alias("rate_in"), _share(right, ~within).alias("rate_out"),
        F.count_if(within & F.col(declined)).alias("declined_in"), F.count_if(~within & F.col(declined)).alias("declined_out"),
    )
    return rates.select("n_in", "n_out", "rate_in", "rate_out", ((F.col("rate_in") - F.col("rate_out")) * 100).alias("gap_pp"), "declined_in", "declined_out")


def grounding_summary(rows: DataFrame, bar: float) -> DataFrame:
    """One row of grounding figures, rates to 3 places.

    rows: scope (in or out), coverage, declined, confidence, confidence_level, n_points, n_inferred.  A row
    reaches the documented cause with a coverage of ``bar`` or more; missing coverage and confidence count as 0.
    """
    inside, outside = F.col("scope") == "in", F.col("scope") == "out"
    mean = lambda c, of: F.coalesce(F.round(F.avg(F.when(of, F.coalesce(c, F.lit(0.0)))), 3), F.lit(0.0))
    rate = lambda hit, of: F.round(_share(F.coalesce(hit, F.lit(False)), of), 3)
    low = F.col("confidence_level") == "low"
    return rows.agg(
        F.count_if(inside).alias("n_in"), F.count_if(outside).alias("n_out"),
        mean("coverage", inside).alias("in_scope_mean_coverage"), rate(F.coalesce("coverage", F.lit(0.0)) >= bar, inside).alias("in_scope_reached_rate"),
        rate(F.col("declined"), inside).alias("in_scope_decline_rate"), rate(F.col("declined"), outside).alias("out_scope_decline_rate"),
        mean("confidence", inside).alias("in_scope_mean_confidence"), mean("confidence", outside).alias("out_scope_mean_confidence"),
        rate(low, inside).alias("in_scope_low_conf_rate"), rate(low, outside).alias("out_scope_low_conf_rate"),
        F.coalesce(F.sum("n_points"), F.lit(0)).alias("total_points"), F.coalesce(F.sum("n_inferred"), F.lit(0)).alias("total_inferred"),
    )


def condition_means(rows: DataFrame, condition: str, hit: str, coverage: str) -> DataFrame:
    """(condition, n, hits, hit_rate, mean_coverage) of each form of the input; a null coverage counts as 0."""
    return rows.groupBy(condition).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.avg(F.coalesce(F.col(hit), F.lit(False)).cast("int")).alias("hit_rate"),
        F.avg(F.coalesce(coverage, F.lit(0.0))).alias("mean_coverage"),
    )


def chain_structure(paths: DataFrame, segments: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on all queries' chains: their shape, what their steps carry, what they cover.

    paths: query_id, chain, path; segments: ord, component, signature, symptoms, source_doc; edges: src.
    Components count alike in the first 40 characters of their lower-cased form.
    """
    steps = paths.select("query_id", "chain", F.posexplode("path").alias("p", "ord")).join(segments, "ord")
    on = edges.select(F.col("src").alias("ord")).distinct().withColumn("on", F.lit(1))
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    steps = steps.join(on, "ord", "left").select(
        "query_id", "ord", "p", "source_doc", F.when(filled("component"), F.substring(F.lower(F.trim("component")), 1, 40)).alias("part"),
        filled("signature").alias("signed"), (F.coalesce(F.size("symptoms"), F.lit(0)) > 0).alias("told"), F.col("on").isNotNull().alias("linked"),
    )
    rate = lambda hit: F.avg(hit.cast("int"))
    carried = steps.agg(
        rate(F.col("part").isNotNull()).alias("has_component"), rate(F.col("signed")).alias("has_signature"), rate(F.col("told")).alias("has_symptoms"),
        rate(F.col("linked")).alias("has_links"), F.avg(F.when(F.col("p") == 0, F.col("told").cast("int"))).alias("entry_has_symptoms"),
    )
    covered = steps.groupBy("query_id").agg(
        F.count_distinct("part").alias("parts"), F.count_distinct("source_doc").alias("docs"), F.count_distinct("ord").alias("segments"), F.count(F.lit(1)).alias("visits")
    ).agg(
        F.avg("parts").alias("mean_components"), F.avg("docs").alias("mean_docs"), F.avg("segments").alias("mean_segments"),
        F.avg("visits").alias("mean_visits"), (F.avg("visits") / F.avg("segments")).alias("redundancy"),
    )
    size = F.size("path")
    shape = paths.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("length"), F.count_if(size == 1).alias("single"), F.max(size).alias("longest")).agg(
        F.count(F.lit(1)).alias("queries"), F.avg("n").alias("mean_entries"), (F.sum("length") / F.sum("n")).alias("mean_length"),
        (F.sum("single") / F.sum("n")).alias("single_chains"), F.avg((F.col("longest") == 1).cast("int")).alias("single_queries"),
    )
    return shape.crossJoin(F.broadcast(carried)).crossJoin(F.broadcast(covered))


def with_lift(sweep: DataFrame, flat: DataFrame) -> DataFrame:
    """A sweep's rows (mean_coverage and its settings) with ``lift`` over the mean ``coverage`` of flat retrieval; queries without one don't count."""
    base = flat.agg(F.avg("coverage").alias("flat_coverage"))
    return sweep.crossJoin(F.broadcast(base)).withColumn("lift", F.col("mean_coverage") - F.col("flat_coverage"))


def annunciations(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, ann_score, ann_frac): how much of a query's terms documented symptoms name, by rarity and by share.

    queries: query_id, terms; segments: ord, symptom_terms.  A term's rarity is ln(segments / (segments whose
    symptoms hold it + 1)); a query without terms has nulls.
    """
    n = segments.agg(F.count(F.lit(1)).alias("n"))
    known = segments.select(F.explode(F.array_distinct("symptom_terms")).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    known = known.crossJoin(F.broadcast(n)).select("tok", F.ln(F.col("n") / (F.col("df") + 1)).alias("rarity"))
    asked = queries.select("query_id", F.explode_outer(F.array_distinct("terms")).alias("tok"))
    met = asked.join(known, "tok", "left").groupBy("query_id").agg(F.count("tok").alias("n"), F.count("rarity").alias("hit"), F.sum("rarity").alias("sum"))
    some = F.col("n") > 0
    return met.select("query_id", F.when(some, F.coalesce("sum", F.lit(0.0))).alias("ann_score"), F.when(some, F.col("hit") / F.col("n")).alias("ann_frac"))
