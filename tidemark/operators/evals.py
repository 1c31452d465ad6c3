"""Scoring of decisions, rank statistics and binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from . import ranks


def idf_table(docs: DataFrame, toks: Column, distinct: bool = True) -> DataFrame:
    """(tok, df, idf): ln(n / (df + 1)); ``distinct=False`` counts occurrences in place of documents."""
    n = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    exploded = docs.select(F.explode(F.array_distinct(toks) if distinct else toks).alias("tok"))
    df = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("tok", "df", F.ln(F.col("n") / (F.col("df") + 1)).alias("idf"))


def cause_scores(rows: DataFrame, idf: DataFrame, cause_terms: Column) -> DataFrame:
    """Distinctive cause terms that a diagnosis names: (id, declined, matched_idf, n_strong, right_direction)."""
    text = F.lower(F.coalesce("diagnosis", F.lit("")))
    declined = text.startswith("no onboard") | (text == "decline") | (text == "")
    base = rows.select("id", text.alias("text"), declined.alias("declined"), F.array_distinct(cause_terms).alias("terms"))
    named = (
        base.where("not declined").select("id", "text", F.explode("terms").alias("tok")).where(F.contains("text", F.col("tok")))
        .join(idf.select("tok", "idf"), "tok").groupBy("id")
        .agg(F.sum("idf").alias("matched_idf"), F.count_if(F.col("idf") >= L.STRONG_IDF).alias("n_strong"))
    )
    return base.select("id", "declined").join(named, "id", "left").select(
        "id", "declined", F.coalesce("matched_idf", F.lit(0.0)).alias("matched_idf"),
        F.coalesce("n_strong", F.lit(0)).alias("n_strong"), (F.coalesce("n_strong", F.lit(0)) >= 1).alias("right_direction"),
    )


def auc(rows: DataFrame, score: str, label: str, by: list[str] | None = None, empty: float | None = 0.5) -> DataFrame:
    """Area under the curve by average ranks, ties counting half; ``empty`` where a side has no row.

    Counts of equal scores come first, so the ordered window has a row per distinct score.
    """
    by = by or []
    counted = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q")
    )
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    under = counted.withColumn("under", F.coalesce(F.sum("q").over(below), F.lit(0)))
    out = under.groupBy(*by).agg(
        F.sum(F.col("p") * (F.col("under") + F.col("q") / 2)).alias("wins"), F.sum("p").alias("np"), F.sum("q").alias("nq")
    )
    return out.select(*by, F.coalesce(F.try_divide("wins", (F.col("np") * F.col("nq")).cast("double")), F.lit(empty)).alias("auc"))


def permutation_test(rows: DataFrame, score: str, label: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """(auc, p_value): labels are dealt anew ``replicates`` times, over the counts of equal scores; draws follow from the seed."""
    real = auc(rows, score, label).select("auc")
    null = ranks.permuted_areas(rows, score, label, replicates, seed).select(F.col("auc").alias("null_auc"))
    return null.crossJoin(F.broadcast(real)).groupBy("auc").agg(
        ((F.count_if(F.col("null_auc") >= F.col("auc")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value")
    )


def held_out_auc(rows: DataFrame, score: str, label: str, replicates: int = 200, share: float = 0.3, seed: int = 20260711) -> DataFrame:
    """(rep, auc) over seeded random subsets of about ``share`` of the rows; ``ranks.held_out_summary`` tells their spread."""
    return ranks.held_out_areas(rows, score, label, replicates, share, seed)


def bins_last_wide(rows: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """``bin`` 0 to n-1 by rank of value, then key; the remainder goes to the last bin."""
    ranked, total = ranks.numbered(rows, [value, key])
    q = F.floor(F.col("total") / n)
    return ranked.crossJoin(F.broadcast(total)).withColumn(
        "bin", F.when(q == 0, n - 1).otherwise(F.least(F.floor(F.try_divide(F.col("rn") - 1, q)), F.lit(n - 1))).cast("int")
    ).drop("rn", "total")


def systematic_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Every step-th row in key order, ``size`` at most."""
    ranked, total = ranks.numbered(rows, [key])
    step = F.greatest(F.floor(F.col("total") / size), F.lit(1))
    at = F.col("rn") - 1
    return ranked.crossJoin(F.broadcast(total)).where((at % step == 0) & (at < step * size)).drop("rn", "total")


def order_statistic(values: Column, form: str) -> Column:
    """One of the percentile forms over a small group's collected values; ``ranks.order_statistics`` takes groups of any size."""
    return F.get(F.sort_array(F.collect_list(values)), ranks.place_of(form, F.count(values)).cast("int"))


def group_rates(rows: DataFrame, by: str, hit: Column, least: int = 3) -> DataFrame:
    """Count and hit rate of each group of ``least`` rows or more."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")).where(F.col("n") >= least).withColumn(
        "rate", F.try_divide("hits", "n")
    )


def outcomes(rows: DataFrame, loose: Column, strict: Column) -> DataFrame:
    """Rows of each loose x strict outcome."""
    return rows.groupBy(loose.alias("loose"), strict.alias("strict")).agg(F.count(F.lit(1)).alias("n"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation; 0 where it is undefined."""
    r = F.corr(x, y)
    return rows.agg(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("r"))


def anchor_coverage(text: Column, anchor_terms: Column) -> Column:
    """struct(coverage, hits): anchor terms that stand in the normalised text."""
    from ..functions.text import normalized

    # Bound once: within the filter each anchor would have the whole text normalised anew.
    clean, asked = F.array(normalized(text)), F.transform(anchor_terms, normalized)
    found = F.flatten(F.transform(clean, lambda c: F.transform(asked, lambda t: F.contains(c, t))))
    hits = F.filter(anchor_terms, lambda t, i: F.get(found, i))
    return F.struct(
        F.coalesce(F.try_divide(F.size(F.filter(found, lambda x: x)), F.size(anchor_terms)), F.lit(0.0)).alias("coverage"), hits.alias("hits")
    )


def term_coverage(terms: Column, text_terms: Column) -> Column:
    """Share of terms that the other side holds; null without terms."""
    return F.try_divide(F.size(F.array_intersect(terms, text_terms)), F.size(F.array_distinct(terms)))


def echo_free_vote(points: DataFrame) -> DataFrame:
    """(query_id, term, votes): the term most leads name beyond the symptom's own; ties alphabetically.

    points: query_id, terms array, echo array.  A lead counts once for a term.
    """
    cast = points.select("query_id", F.explode(F.array_except("terms", "echo")).alias("term"))
    votes = cast.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("query_id").agg(F.max_by(F.struct("term", "votes"), F.struct("votes", _reverse("term"))).alias("top")).select(
        "query_id", "top.term", "top.votes"
    )


def _reverse(term: str) -> Column:
    """An order key that puts alphabetically smaller terms higher."""
    return F.transform(F.split(term, ""), lambda c: -F.ascii(c)).cast("array<int>")


def citation_dials(points: DataFrame, sources: DataFrame) -> DataFrame:
    """Groundedness, support, consensus and score of each query's leads.

    points: query_id, text_terms, src_terms, echo; sources: query_id, raw_text of everything retrieved.
    """
    extr = F.coalesce(F.try_divide(F.size(F.array_intersect("text_terms", "src_terms")), F.size("text_terms")), F.lit(0.0))
    ground = points.groupBy("query_id").agg(F.avg(extr).alias("g"), F.count(F.lit(1)).alias("n_points"))
    top = echo_free_vote(points.select("query_id", F.col("text_terms").alias("terms"), "echo"))
    support = (
        sources.join(top, "query_id").groupBy("query_id")
        .agg(F.count_if(F.contains(F.lower(F.coalesce("raw_text", F.lit(""))), F.col("term"))).alias("support"))
    )
    out = ground.join(top, "query_id", "left").join(support, "query_id", "left").withColumn("support", F.coalesce("support", F.lit(0)))
    z = (F.col("g") - L.CITE_MEAN_G) / L.CITE_SD_G + (F.col("support") - L.CITE_MEAN_SUPPORT) / L.CITE_SD_SUPPORT
    return out.select(
        "query_id", "n_points", F.col("g").alias("groundedness"), "support", F.col("term").alias("consensus_term"),
        F.coalesce("votes", F.lit(0)).alias("consensus"), z.alias("citation_score"), (z <= L.CITE_CUT).alias("coverage_flag"),
    )
