"""Reports that are run after a change: convergence, accuracy by coverage, constants, latency, release checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evals, ranks


def convergence(rows: DataFrame, n_bins: int = 5) -> dict[str, DataFrame]:
    """How a dial goes with what was reached; rows: id, dial, reached, strength doubles, inside boolean.

    ``pearson`` (dial_reached, strength_reached), ``bins`` (bin by dial, n, mean reached) and
    ``auc`` of the dial and of the strength for rows inside the scope.
    """
    r = evals.pearson(rows, "dial", "reached").select(F.col("r").alias("dial_reached"))
    q = evals.pearson(rows, "strength", "reached").select(F.col("r").alias("strength_reached"))
    bins = evals.bins_last_wide(rows, "dial", "id", n_bins).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dial").alias("dial"), F.avg("reached").alias("reached")
    )
    both = [evals.auc(rows, c, "inside").select(F.lit(c).alias("score"), "auc") for c in ("dial", "strength")]
    return {"pearson": r.join(F.broadcast(q)), "bins": bins, "auc": both[0].unionByName(both[1])}


def coverage_accuracy(rows: DataFrame) -> DataFrame:
    """(scope, n, accuracy, coverage_right, coverage_wrong, auc) over all rows and over those inside the scope.

    rows: coverage double, inside and right boolean.
    """
    scoped = rows.select("coverage", "right", F.explode(F.when(F.col("inside"), F.array(F.lit("all"), F.lit("inside"))).otherwise(F.array(F.lit("all")))).alias("scope"))
    means = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("int")).alias("accuracy"),
        F.avg(F.when(F.col("right"), F.col("coverage"))).alias("coverage_right"), F.avg(F.when(~F.col("right"), F.col("coverage"))).alias("coverage_wrong"),
    )
    return means.join(evals.auc(scoped, "coverage", "right", ["scope"]), "scope", "left")


def fitted_constants(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of groundedness and support over the answered rows."""
    return rows.where(~F.col("declined")).agg(
        F.avg("groundedness").alias("mean_g"), F.stddev_pop("groundedness").alias("sd_g"),
        F.avg("support").alias("mean_support"), F.stddev_pop("support").alias("sd_support"),
    )


def cycled(symptoms: DataFrame, n: int, key: str) -> DataFrame:
    """(run, symptom columns): ``n`` runs that take the symptoms in key order again and again."""
    placed, total = ranks.numbered(symptoms, [key])
    runs = symptoms.sparkSession.range(n).select(F.col("id").alias("run")).join(F.broadcast(total))
    return runs.withColumn("rn", F.col("run") % F.col("total") + 1).join(placed, "rn").drop("rn", "total")


def latency_summary(runs: DataFrame, warm_up: int = 2) -> DataFrame:
    """Mean, 95th percentile, least and most of ``seconds``, the first ``warm_up`` runs left out; runs: run from 0."""
    timed = runs.where(F.col("run") >= warm_up)
    means = timed.agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    p95 = ranks.order_statistics(timed, "seconds", ("p95_low",)).withColumnRenamed("p95_low", "p95")
    return means.join(F.broadcast(p95)).select("n", "mean", "p95", "least", "most")


def entity_occurrences(triples: DataFrame) -> DataFrame:
    """(name, type, segments): where an entity stands as subject or object, each segment once and in order.

    triples: seg_id, subject, subject_type, object, object_type.
    """
    ends = triples.select("seg_id", F.explode(F.array(
        F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("type"))
    )).alias("e"))
    return ends.select("seg_id", "e.name", "e.type").distinct().groupBy("name", "type").agg(F.sort_array(F.collect_list("seg_id")).alias("segments"))


def with_causes(decisions: DataFrame, causes: DataFrame) -> DataFrame:
    """``decisions`` with the cause and subsystem of their symptom; the last entry of a symptom wins.

    causes: ord, symptom, documented_cause, subsystem.  Decisions of unknown symptoms keep
    their own cause, and ? for a subsystem.
    """
    last = causes.groupBy("symptom").agg(F.max_by(F.struct("documented_cause", "subsystem"), "ord").alias("known"))
    kept = [c for c in decisions.columns if c not in ("documented_cause", "subsystem")]
    own = F.col("documented_cause") if "documented_cause" in decisions.columns else F.lit("")
    found = F.col("known").isNotNull()
    return decisions.join(last, "symptom", "left").select(
        *kept, F.when(found, F.col("known.documented_cause")).otherwise(own).alias("documented_cause"),
        F.when(found, F.col("known.subsystem")).otherwise("?").alias("subsystem"),
    )


def human_time(checkpoints: DataFrame, seconds_of) -> DataFrame:
    """(episode_id, seconds, known): time from the report's end to the checkpoint that is the diagnosis.

    checkpoints: episode_id, report_end_get, wanted (the checkpoint's name), name, get, delta.
    The stored delta stands in where one of the times can't be read; ``seconds_of`` reads a time.
    """
    taken = seconds_of(F.col("get")) - seconds_of(F.col("report_end_get"))
    each = checkpoints.withColumn("value", F.when(F.col("name") == F.col("wanted"), F.coalesce(taken, F.col("delta"))))
    out = each.groupBy("episode_id").agg(F.max("value").alias("seconds"))
    return out.withColumn("known", F.col("seconds").isNotNull())


def sampled(readings: DataFrame, time: str, seconds: int) -> DataFrame:
    """(slot, n, mean, peak): telemetry ``value`` in slots of so many seconds; works on streams with a watermark too."""
    slot = F.window(F.col(time), f"{seconds} seconds")
    return readings.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))


def release_checks(found: DataFrame, expected: dict[str, float], tolerance: float = 1e-6) -> DataFrame:
    """(check, expected, value, ok) of each expected figure; found: check, value.  A figure that is missing fails."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(float(v)).alias("expected")) for k, v in expected.items()]))
    wanted = found.sparkSession.range(1).select(rows.alias("r")).select("r.*")
    near = F.abs(F.col("value") - F.col("expected")) <= tolerance
    return wanted.join(found.select("check", F.col("value").cast("double")), "check", "left").withColumn("ok", F.coalesce(near, F.lit(False)))


def term_source(raw_text: Column, component: Column, signature: Column) -> Column:
    """The text whose terms a segment stands for."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (raw_text, component, signature)])


def graph_text(symptoms: Column, links: Column, component: Column, signature: Column, subsystem: Column) -> Column:
    """The structure of a segment as text: symptoms, links, component, signature, subsystem."""
    none = F.array().cast("array<string>")
    lists = [F.array_join(F.coalesce(c, none), " ") for c in (symptoms, links)]
    return F.concat_ws(" ", *lists, *[F.coalesce(c, F.lit("")) for c in (component, signature, subsystem)])


def segment_structure(symptoms: Column, signature: Column, component: Column, subsystem: Column) -> Column:
    """The same without links: symptoms, signature, component, subsystem."""
    joined = F.array_join(F.coalesce(symptoms, F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", joined, *[F.coalesce(c, F.lit("")) for c in (signature, component, subsystem)])


def crew_reported(rows: DataFrame) -> DataFrame:
    """Anomalies that the crew reported."""
    return rows.where(F.coalesce("crew_initiated", F.lit(False)))


def live_loops(rows: DataFrame) -> DataFrame:
    """Anomalies that the crew reported and that were diagnosed in flight."""
    return rows.where(F.coalesce("crew_initiated", F.lit(False)) & F.coalesce("diagnosed_in_flight", F.lit(False)))


def crew_observed(rows: DataFrame) -> DataFrame:
    """Rows of a csv whose ``crew_observed`` is the word true."""
    return rows.where(F.col("crew_observed") == "true")
