"""Ranks, order statistics and resampling over ranges, against plain lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import evals, ranks


@pytest.mark.parametrize("n", [0, 1, 4, 500])
def test_numbers_follow_the_order(spark, n):
    rng = random.Random(n)
    data = [(i, rng.choice([None, 1.0, 1.0, 2.5, float(i)]), f"k{i:04}") for i in range(n)]
    df = spark.createDataFrame(data, "id long, v double, k string").repartition(3)
    got, total = ranks.numbered(df, ["v", "k"], 5)
    want = [d[0] for d in sorted(data, key=lambda d: (d[1] is not None, d[1] or 0, d[2]))]
    assert [r["id"] for r in got.orderBy("rn").collect()] == want and total.first()[0] == n
    assert sorted(r["rn"] for r in got.collect()) == list(range(1, n + 1))


def at(values, form):
    v, n = sorted(values), len(values)
    place = {"p95_low": max(0, int(0.95 * n) - 1), "p95_high": min(n - 1, int(0.95 * n)), "p05": int(0.05 * n), "upper_median": n // 2}[form]
    return v[place] if 0 <= place < n else None


def test_order_statistics_are_those_of_sorted_lists(spark):
    rng = random.Random(1)
    groups = {"a": 1, "b": 5, "c": 20, "hot": 3000, None: 40, "none": 0}
    data = [(g, rng.choice([7.0, rng.random()]), i) for g, n in groups.items() for i in range(n)] + [("none", None, 0), ("a", None, 1)]
    df = spark.createDataFrame(data, "g string, v double, __x long")
    got = {r["g"]: r for r in ranks.order_statistics(df, "v", by=["g"], ranges=6).collect()}
    assert got.keys() == groups.keys()
    for g in groups:
        values = [v for h, v, _ in data if h == g and v is not None]
        assert [got[g][f] for f in ranks.FORMS] == [at(values, f) for f in ranks.FORMS]
    assert [tuple(r) for r in ranks.order_statistics(df.where("g = 'c'"), "v", ("p05",)).collect()] == [(at([v for h, v, _ in data if h == "c"], "p05"),)]


def test_no_task_holds_all_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    got, _ = ranks.numbered(df, ["v", "id"], 8)
    sizes = got.withColumn("p", F.spark_partition_id()).groupBy("p").count()
    assert sizes.agg(F.max("count")).first()[0] < 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def null_aucs(scores, labels, replicates, seed):
    """The same test by shuffled rows."""
    rng = np.random.default_rng(seed)
    scores, labels = np.array(scores), np.array(labels)
    out = []
    for _ in range(replicates):
        y = rng.permutation(labels)
        a, b = scores[y], scores[~y]
        out.append(((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b)))
    return np.array(out)


def test_permuted_areas_are_distributed_as_shuffled_labels(spark):
    rng = random.Random(3)
    data = [(i, float(rng.randint(0, 9)), rng.random() < 0.3) for i in range(120)]
    df = spark.createDataFrame(data, "id long, s double, y boolean")
    got = np.array([r[0] for r in ranks.permuted_areas(df, "s", "y", 1500, ranges=4).select("auc").collect()])
    want = null_aucs([d[1] for d in data], [d[2] for d in data], 1500, 1)
    assert len(got) == 1500 and abs(got.mean() - want.mean()) < 0.006 and abs(got.std() / want.std() - 1) < 0.1
    for p in (5, 50, 95):
        assert abs(np.percentile(got, p) - np.percentile(want, p)) < 0.015
    real, p_value = evals.permutation_test(df, "s", "y", 1500).first()
    assert abs(p_value - ((want >= real - 1e-12).sum() + 1) / 1501) < 0.05


def test_each_draw_adds_up(spark):
    df = spark.createDataFrame([(i, float(i % 5), i < 30) for i in range(100)], "id long, s double, y boolean")
    one = spark.createDataFrame([(1, 1.0, True)] * 9, "id long, s double, y boolean")
    assert {r["auc"] for r in ranks.permuted_areas(one, "s", "y", 20).collect()} == {0.5}
    assert ranks.permuted_areas(df.limit(0), "s", "y", 20).count() == 0
    again = [sorted(rows(ranks.permuted_areas(df, "s", "y", 50, ranges=3))) for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == 50


def test_held_out_areas_and_their_summary(spark):
    rng = random.Random(4)
    data = [(i, float(rng.randint(0, 30)), rng.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(data, "id long, score double, label boolean")
    areas = ranks.held_out_areas(df, "score", "label", 300, ranges=4)
    got = np.array([r["auc"] for r in areas.collect()])
    plain = np.random.default_rng(1)
    s, y = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    want = []
    for _ in range(300):
        k = plain.random(400) < 0.3
        a, b = s[k & y], s[k & ~y]
        want.append(((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b)))
    assert abs(got.mean() - np.mean(want)) < 0.02 and abs(got.std() / np.std(want) - 1) < 0.25
    summary = ranks.held_out_summary(areas).first()
    v = sorted(got)
    assert tuple(summary) == pytest.approx((v[150], v[15], v[0], v[-1])) and not math.isnan(v[0])
