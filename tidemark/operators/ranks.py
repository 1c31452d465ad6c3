"""Ranks, order statistics and resampling whose rows never meet in one task.

Rows are dealt out by ranges of their order, so a rank is a place within a range plus
the rows of the ranges before it.  Only the ranges' sizes, a row for each, are put in one order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship_by_value
from ..plans.lineage import cut

FORMS = ("p95_low", "p95_high", "p05", "upper_median")
#: numpy draws from urns of fewer than this.
_URN = 10**9
#: Different scores that one task draws for.
BINS = 10_000


def _ranged(rows: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    """``rows`` with ``__part``, their range of ``order``; written, so that sampled borders stay as they are."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def numbered(rows: DataFrame, order: list[str], ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``rn`` from 1 in ascending ``order``, one row with ``total``); rows alike in ``order`` come as they come."""
    parts = _ranged(rows, order, ranges)
    sizes = cut(parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")))
    # A row for each range.
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = parts.withColumn("rn", own).join(F.broadcast(before), "__part").withColumn("rn", (F.col("rn") + F.col("__before")).cast("long"))
    return out.drop("__part", "__before"), sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total"))


def place_of(form: str, n: Column) -> Column:
    """Place from 0 of a percentile form among ``n`` values.

    p95_low: max(0, int(.95 n) - 1); p95_high: min(n - 1, int(.95 n)); p05: int(.05 n);
    upper_median: n // 2.
    """
    return {
        "p95_low": F.greatest(F.floor(n * 0.95) - 1, F.lit(0)), "p95_high": F.least(F.floor(n * 0.95), n - 1),
        "p05": F.floor(n * 0.05), "upper_median": F.floor(n / 2),
    }[form]


def order_statistics(rows: DataFrame, value: str, forms: tuple[str, ...] = FORMS, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """(``by``, ``forms``): the value at each form's place in each group, exactly; nulls don't count, a group without values has nulls.

    Equal values are counted first; places are looked up among running counts by range.
    """
    by = by or []
    groups = rows.groupBy(*by).agg(F.count(value).alias("__n"))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    parts = _ranged(counted, [*by, "__v"], ranges)
    sizes = parts.groupBy(*by, "__part").agg(F.sum("__c").alias("__size"))
    # A row for each group and range it lies in.
    earlier = Window.partitionBy(*by).orderBy("__part") if by else Window.orderBy("__part")
    sizes = sizes.select(*by, "__part", (F.sum("__size").over(earlier) - F.col("__size")).alias("__before"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    within = Window.partitionBy(*by, "__part").orderBy("__v")
    running = parts.withColumn("__upto", F.sum("__c").over(within))
    r, s, g = running.alias("r"), sizes.alias("s"), groups.alias("g")
    placed = r.join(s, [*same(running, sizes, by), running["__part"] == sizes["__part"]]).select(
        *(running[c] for c in by), "__v", (F.col("__before") + F.col("__upto") - F.col("__c")).alias("__from"), (F.col("__before") + F.col("__upto")).alias("__to")
    )
    asked = g.select(*by, "__n", F.explode(F.array(*[F.struct(F.lit(f).alias("form"), place_of(f, F.col("__n")).alias("place")) for f in forms])).alias("a"))
    asked = asked.select(*by, "a.form", "a.place")
    met = asked.join(placed, [*same(asked, placed, by), F.col("place") >= F.col("__from"), F.col("place") < F.col("__to")], "left")
    picked = [F.max(F.when(F.col("form") == f, F.col("__v"))).alias(f) for f in forms]
    return met.groupBy(*(asked[c] for c in by)).agg(*picked)


def histogram(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(score, p, q): how many rows of each score are labelled and how many not; nulls take no part."""
    return rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q")
    )


def least_cost_cuts(rows: DataFrame, score: str, label: str, by: str, alarm_weight: float = 1.0, ranges: int | None = None) -> DataFrame:
    """(``by``, cut, p, q): each group's least cut of least cost, and how many of its rows are labelled and how many not.

    A cut's cost is the share of the labelled below it plus ``alarm_weight`` times the share of the others from it on.
    It lies midway between neighbouring scores, or one beside the first or last.  Equal scores are counted first.
    """
    counted = rows.groupBy(F.col(by).alias("__g"), F.col(score).alias("__s")).agg(F.count_if(F.col(label)).alias("__p"), F.count_if(~F.col(label)).alias("__q"))
    parts = _ranged(counted, ["__g", "__s"], ranges)
    sizes = parts.groupBy("__g", "__part").agg(F.sum("__p").alias("__pn"), F.sum("__q").alias("__qn"), F.max("__s").alias("__last"))
    # A row for each group and range it lies in.
    earlier, whole = Window.partitionBy("__g").orderBy("__part"), Window.partitionBy("__g")
    sizes = sizes.select(
        F.col("__g").alias("__h"), F.col("__part").alias("__r"), F.lag("__last").over(earlier).alias("__left"),
        (F.sum("__pn").over(earlier) - F.col("__pn")).alias("__p0"), (F.sum("__qn").over(earlier) - F.col("__qn")).alias("__q0"),
        F.sum("__pn").over(whole).alias("p"), F.sum("__qn").over(whole).alias("q"), F.max("__last").over(whole).alias("__end"),
    )
    within = Window.partitionBy("__g", "__part").orderBy("__s")
    running = parts.select(
        "*", F.lag("__s").over(within).alias("__before"), (F.sum("__p").over(within) - F.col("__p")).alias("__pb"), (F.sum("__q").over(within) - F.col("__q")).alias("__qb")
    ).join(sizes, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__r")))
    left = F.coalesce("__before", "__left")
    missed = (F.col("__p0") + F.col("__pb")) / F.greatest("p", F.lit(1))
    alarms = (F.col("q") - F.col("__q0") - F.col("__qb")) / F.greatest("q", F.lit(1))
    at = F.struct((missed + alarm_weight * alarms).alias("cost"), F.coalesce((left + F.col("__s")) / 2, F.col("__s") - 1).alias("cut"))
    # Beyond the last score all labelled rows are missed, and there is no false alarm.
    beyond = F.struct(F.least(F.first("p"), F.lit(1)).cast("double").alias("cost"), (F.max("__end") + 1).alias("cut"))
    return running.groupBy(F.col("__g").alias(by)).agg(F.least(F.min(at), beyond)["cut"].alias("cut"), F.first("p").alias("p"), F.first("q").alias("q"))


def _binned(rows: DataFrame, score: str, label: str, ranges: int | None) -> DataFrame:
    """``histogram`` with ``part``: ranges of about ``BINS`` scores, so that replicates make a row for each of few ranges."""
    bins = cut(histogram(rows, score, label))
    n = ranges or max(1, -(-bins.count() // BINS))
    if n == 1:
        return bins.withColumn("part", F.lit(0))
    return _ranged(bins, ["score"], n).withColumnRenamed("__part", "part")


def _areas(partial: DataFrame) -> DataFrame:
    """(rep, auc) from (rep, part, wins, p, q): wins within parts, and each part's positives over the negatives before it."""
    # A row for each replicate and range.
    before = F.coalesce(F.sum("q").over(Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = partial.withColumn("before", before).groupBy("rep").agg(
        F.sum(F.col("wins") + F.col("p").cast("double") * F.col("before")).alias("wins"), F.sum("p").alias("p"), F.sum("q").alias("q")
    )
    return out.select("rep", F.coalesce(F.try_divide("wins", F.col("p").cast("double") * F.col("q")), F.lit(0.5)).alias("auc"))


_PARTIAL = "rep long, part int, wins double, p long, q long"


def _wins(p: np.ndarray, q: np.ndarray) -> float:
    """Pairs that positives win over negatives of lower or, by half, equal score; bins ascending."""
    return float((p * (np.cumsum(q) - q + q / 2)).sum())


def held_out_areas(rows: DataFrame, score: str, label: str, replicates: int = 200, share: float = 0.3, seed: int = 20260711, ranges: int | None = None) -> DataFrame:
    """(rep, auc) over subsets that take each row with a chance of ``share``.

    How many rows of a bin are taken is binomial, so a replicate is drawn over the bins and
    makes a small row for each range of scores, however many rows there are.  Draws follow
    from the seed, the replicate and the range.  A subset without a row of
    either label gives 0.5.
    """
    parts = _binned(rows, score, label, ranges)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        p, q = pdf["p"].to_numpy(), pdf["q"].to_numpy()
        part = int(pdf["part"].iloc[0])
        out = []
        for rep in range(replicates):
            rng = np.random.default_rng([seed, rep, part])
            a, b = rng.binomial(p, share), rng.binomial(q, share)
            out.append((rep, part, _wins(a, b), int(a.sum()), int(b.sum())))
        return pd.DataFrame(out, columns=["rep", "part", "wins", "p", "q"])

    return _areas(parts.groupBy("part").applyInPandas(draw, _PARTIAL))


def held_out_summary(areas: DataFrame) -> DataFrame:
    """(median, p05, least, most) of replicates' areas: the upper median and the value at int(.05 n)."""
    ends = areas.agg(F.min("auc").alias("least"), F.max("auc").alias("most"))
    picked = order_statistics(areas, "auc", ("upper_median", "p05"), ranges=4)
    return picked.withColumnRenamed("upper_median", "median").join(F.broadcast(ends)).select("median", "p05", "least", "most")


def permuted_areas(rows: DataFrame, score: str, label: str, replicates: int = 2000, seed: int = 7, ranges: int | None = None) -> DataFrame:
    """(rep, auc) with the labels dealt anew over all rows.

    How many positives a bin gets is multivariate hypergeometric.  Each range first has its
    share drawn, alike in every task, and then deals it among its own bins.
    """
    parts = _binned(rows, score, label, ranges)
    sizes = parts.groupBy("part").agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("p")).orderBy("part").collect()  # a row a range
    totals, positives = np.array([r["n"] for r in sizes], np.int64), sum(r["p"] for r in sizes)
    if totals.sum() >= _URN:
        raise ValueError(f"numpy draws from fewer than {_URN} rows; {totals.sum()} were given")
    place = {r["part"]: k for k, r in enumerate(sizes)}

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        n = (pdf["p"] + pdf["q"]).to_numpy()
        part = int(pdf["part"].iloc[0])
        k = place[part]
        out = []
        for rep in range(replicates):
            share = int(np.random.default_rng([seed, rep]).multivariate_hypergeometric(totals, positives, method="marginals")[k])
            p = np.random.default_rng([seed, rep, part]).multivariate_hypergeometric(n, share, method="marginals")
            out.append((rep, part, _wins(p, n - p), share, int(n.sum()) - share))
        return pd.DataFrame(out, columns=["rep", "part", "wins", "p", "q"])

    return _areas(parts.groupBy("part").applyInPandas(deal, _PARTIAL))


ship_by_value(__name__)
