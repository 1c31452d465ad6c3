"""Multi-turn replay: cumulative transcripts, first hits and elapsed time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative(turns: DataFrame, session: str, turn: str, text: str) -> DataFrame:
    """Each row with the session's transcript up to it, one blank between turns."""
    upto = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("transcript", F.array_join(F.collect_list(text).over(upto), " "))


def until_hit(rows: DataFrame, session: str, turn: str, hit: Column) -> DataFrame:
    """Rows up to and with the session's first hit; all rows of sessions without one."""
    earlier = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("__hit", hit)
    kept = marked.withColumn("__before", F.coalesce(F.max("__hit").over(earlier), F.lit(False)))
    return kept.where("not __before").drop("__before").withColumnRenamed("__hit", "hit")


def first_hits(rows: DataFrame, session: str, turn: str, hit: Column) -> DataFrame:
    """(session, n_turns, matched_at)."""
    return rows.groupBy(session).agg(F.count(F.lit(1)).alias("n_turns"), F.min(F.when(hit, F.col(turn))).alias("matched_at"))


def elapsed(rows: DataFrame, session: str, turn: str, seconds: str) -> DataFrame:
    upto = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("elapsed", F.sum(seconds).over(upto))


def best_so_far(rows: DataFrame, session: str, turn: str, value: str) -> DataFrame:
    upto = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("best", F.max(value).over(upto))


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no finished row has: what a resumed run still has to do."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def last_per_key(rows: DataFrame, key: str, place: str) -> DataFrame:
    """The last row of each key, as a later line of a dump replaces an earlier one."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), place).alias("r")).select("r.*")


def first_assignment(rows: DataFrame, text: str, table: list[tuple[str, str]]) -> DataFrame:
    """``assigned``: the value of the first listed key that stands in the text."""
    found = F.coalesce(*[F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(k.lower())), F.lit(v)) for k, v in table])
    return rows.withColumn("assigned", found)


def by_position(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """The n-th row of a group on the left with the n-th on the right; null where there is none."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(right_order)))
    return a.join(b, [group, "place"], "left")
