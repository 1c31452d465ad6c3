"""Power readings attributed to the runs they were taken in, as streams or as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def power_readings(lines: DataFrame, at: str = "at", text: str = "value") -> DataFrame:
    """(at, watts) of telemetry lines that hold a ``VDD_IN`` reading."""
    mw = F.regexp_extract(F.col(text), r"VDD_IN\s+(\d+)mW", 1)
    return lines.where(mw != "").select(F.col(at).alias("at"), (mw.try_cast("double") / 1000).alias("watts"))


def readings_of_runs(
    runs: DataFrame, readings: DataFrame, longest: int = 600, run_delay: str = "10 seconds", reading_delay: str = "10 seconds"
) -> DataFrame:
    """(run, started, ended, at, watts): readings taken from a run's start on and before its end.

    runs: run, started, ended; readings: at, watts.  Both sides meet in slots of ``longest`` seconds, of
    which a run touches two; what a longer run has after that time is left out.  On streams both
    sides have a watermark, a row waits until no row of the other side can meet it any more, and
    rows that come later than their delay are dropped.  On tables nothing is late.
    """
    if runs.isStreaming:
        runs, readings = runs.withWatermark("started", run_delay), readings.withWatermark("at", reading_delay)
    slot = lambda c: F.floor(F.unix_seconds(c) / longest)
    r = runs.select("run", "started", "ended", F.explode(F.array(slot(F.col("started")), slot(F.col("started")) + 1)).alias("slot"))
    p = readings.select("at", "watts", slot(F.col("at")).alias("reading_slot"))
    until = r["started"] + F.expr(f"INTERVAL '{int(longest)}' SECOND")
    held = (r["slot"] == p["reading_slot"]) & (p["at"] >= r["started"]) & (p["at"] < r["ended"]) & (p["at"] < until)
    return r.join(p, held).drop("slot", "reading_slot")


def power_summary(runs: DataFrame, attributed: DataFrame) -> DataFrame:
    """(run, available, n_samples, mean_w, peak_w, min_w) of every run; a run without a reading has no figures."""
    figures = attributed.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("watts"), 2).alias("mean_w"), F.round(F.max("watts"), 2).alias("peak_w"), F.round(F.min("watts"), 2).alias("min_w")
    )
    out = runs.select("run").distinct().join(figures, "run", "left")
    return out.select("run", F.col("n_samples").isNotNull().alias("available"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "mean_w", "peak_w", "min_w")
