"""Best-first search against a hand-written one."""

import heapq
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark import queries
from tidemark.operators import graph, routing


def searched_plainly(seeds, kinds, edges, boosted, k, cap, exhaustive):
    outs = defaultdict(list)
    for src, dst, cost, seq in sorted(edges, key=lambda e: e[3]):
        outs[src].append((dst, cost))
    penalty = (lambda n: 0.0) if boosted is None else (lambda n: 0.0 if n in boosted else 1.0)
    best, score = {s: 0.0 for s in seeds}, {}
    queue = [(penalty(s), s) for s in best]
    heapq.heapify(queue)
    popped = 0
    while queue and (exhaustive or popped < cap):
        _, n = heapq.heappop(queue)
        popped += 1
        if kinds.get(n) == "procedure":
            score[n] = score.get(n, 0.0) + math.exp(-best[n])
            if not exhaustive and len(score) >= k:
                break
        for m, step in outs[n]:
            if best[n] + step < best.get(m, math.inf):
                best[m] = best[n] + step
                heapq.heappush(queue, (best[m] + penalty(m), m))
    ranked = sorted(score.items(), key=lambda x: -x[1])
    return ranked if exhaustive else ranked[:k]


def graphs(n, seed):
    """Random graphs with parallel edges, hubs, loops and ends that are no nodes; one query each."""
    rng = random.Random(seed)
    out = []
    for g in range(n):
        size = rng.randint(1, 60)
        name = lambda i: f"g{g}n{i:03}"
        kinds = {name(i): rng.choice(["procedure", "procedure", "symptom", "component"]) for i in range(size)}
        edges = []
        for s in range(rng.randint(0, 4 * size)):
            src = 0 if rng.random() < 0.2 else rng.randrange(size)
            edges.append((name(src), name(rng.randrange(size + 2)), rng.choice([-math.log(0.8), -math.log(0.6), 0.1]), s))
        edges += [(a, b, c / 2, s + 1000) for a, b, c, s in edges[:5]]
        out.append(([name(rng.randrange(size)) for _ in range(rng.randint(1, 3))], kinds, edges, {n for n in kinds if rng.random() < 0.3}))
    return out


def tables(spark, found):
    seeds = spark.createDataFrame([(q, s) for q, g in enumerate(found) for s in g[0]] + [(999, "nowhere")], "query_id long, node string")
    nodes = spark.createDataFrame([x for g in found for x in g[1].items()], "node string, kind string")
    edges = spark.createDataFrame([e for g in found for e in g[2]], "src string, dst string, cost double, seq int")
    return seeds, nodes, edges


@pytest.mark.parametrize("k, cap, boost, ahead", [(20, 400, False, 64), (3, 400, True, 2), (50, 9, True, 64), (50, 13, False, 1)])
def test_search_agrees_on_random_graphs(spark, k, cap, boost, ahead):
    found = graphs(50, k + cap)
    boosted = spark.createDataFrame([(n,) for g in found for n in g[3]], "node string") if boost else None
    got = defaultdict(list)
    for q, n, s, place in rows(routing.best_first(*tables(spark, found), k, cap, boosted, ahead=ahead)):
        got[q].append((place, n, s))
    for q, g in enumerate(found):
        want = searched_plainly(g[0], g[1], g[2], g[3] if boost else None, k, cap, False)
        assert [(n, pytest.approx(s)) for n, s in want] == [(n, s) for _, n, s in sorted(got[q])]
    assert 999 not in got and sum(map(len, got.values())) > 50


def test_exhaustive_search_agrees_and_reaches_what_route_reaches(spark):
    found = graphs(12, 7)
    seeds, nodes, edges = tables(spark, found)
    got = defaultdict(dict)
    for q, n, s, _ in rows(routing.best_first(seeds, nodes, edges, exhaustive=True)):
        got[q][n] = s
    for q, g in enumerate(found):
        assert got[q] == pytest.approx(dict(searched_plainly(*g[:3], None, 0, 0, True)))
    least = defaultdict(dict)
    procedures = nodes.where("kind = 'procedure'").select("node")
    for q, n, cost in rows(graph.route(seeds, edges).join(procedures, "node").select("query_id", "node", "cost")):
        least[q][n] = math.exp(-cost)
    assert {q: set(v) for q, v in got.items() if v} == {q: set(v) for q, v in least.items()}
    # A score is a whole number of times the cheapest way's.
    for q in got:
        for n, s in got[q].items():
            assert s / least[q][n] == pytest.approx(round(s / least[q][n])) and s > 0.99 * least[q][n]


def test_search_of_nothing_and_bound_of_an_exhaustive_one(spark, monkeypatch):
    none = spark.createDataFrame([], "query_id long, node string")
    nodes = spark.createDataFrame([("a", "procedure")], "node string, kind string")
    edges = spark.createDataFrame([], "src string, dst string, cost double, seq int")
    assert routing.best_first(none, nodes, edges).count() == 0
    assert rows(routing.best_first(none.union(spark.createDataFrame([(1, "a")], "q long, n string")), nodes, edges)) == [(1, "a", 1.0, 1)]
    monkeypatch.setattr(routing, "MOST_KNOWN", 3)
    star = spark.range(5).select(F.lit("a").alias("src"), F.col("id").cast("string").alias("dst"), F.lit(1.0).alias("cost"), F.col("id").alias("seq"))
    with pytest.raises(Exception, match="use graph.route"):
        routing.best_first(spark.createDataFrame([(1, "a")], "query_id long, node string"), nodes, star, exhaustive=True).count()


def test_query_searches_from_every_seed(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, " ".join(f"pump{rng.choice('abcdefgh')} valve{rng.choice('abcdefgh')} line{rng.choice('abcdefgh')}" for _ in range(9)), "en", "s", 0) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i,) for i in range(25)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    d = str(tmp_path)
    edges = [(e["src"], e["dst"], -math.log(0.6 if e["seq"] == 3 else 0.8), e["seq"]) for e in queries._doc_edges(spark, d).collect()]
    kinds = {i: "symptom" if i % 3 == 0 else "procedure" for i in range(60)}
    got = defaultdict(list)
    for q, n, s, place in rows(queries.QUERIES["best_first_route"](spark, d)):
        got[q].append((place, n, s))
    for q in range(25):
        want = searched_plainly([q], kinds, edges, {n for n in kinds if n % 7 == 0}, 20, 400, False)
        assert [(n, pytest.approx(s, abs=1e-6)) for n, s in want] == [(n, s) for _, n, s in sorted(got[q])]
    assert sum(map(len, got.values())) > 100


def test_nearest_routes_end_early_and_agree(spark):
    """The search ends where the k procedures of a query are certain; it doesn't go through the whole graph."""
    n = 3000
    edges = spark.range(n).selectExpr("id as src", f"explode(array((id * 3 + 1) % {n}, (id * 7 + 2) % {n})) as dst").where("src <> dst").withColumn(
        "cost", F.when(F.col("dst") % 2 == 0, 0.5).otherwise(0.2))
    seeds = spark.createDataFrame([(1, 5), (2, 11)], "query_id int, node long")
    nodes = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") % 3 == 0, "symptom").otherwise("procedure").alias("kind"))
    for boosted in (None, nodes.where("node % 7 = 0")):
        near, every = graph.nearest_costs(seeds, edges, nodes, 4, boosted), graph.route(seeds, edges)
        shown = lambda c: sorted(rows(graph.routed_segments(c.withColumn("cost", F.round("cost", 9)), nodes, 4, boosted)))  # noqa: E731,B023
        assert shown(near) == shown(every) and near.count() < every.count() / 5
