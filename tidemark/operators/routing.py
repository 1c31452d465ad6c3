"""Best-first search over the evidence graph: a table function with a priority queue for each query.

A search goes as far as it knows the edges of the nodes at the head of its queue, and then
asks for those it lacks.  Between two calls of the table function one join fetches the
edges of all queries' asked nodes, so no task holds the graph: a query's state grows with
what it has expanded, ``max_expansions`` nodes at most.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import ship_by_value
from ..plans.lineage import cut

#: Nodes at the head of a queue whose edges are fetched ahead.
AHEAD = 64
#: Nodes that an exhaustive search may know of; ``graph.route`` has no such bound.
MOST_KNOWN = 200_000

_STATE = ("best", "frontier", "found", "known", "expansions")


class _Search:
    """Goes on with one query's search from its state and the edges fetched for it."""

    def __init__(self):
        self.state = None
        self.fetched = {}

    def eval(self, row, k, cap, ahead):
        self.k, self.cap, self.ahead = k, cap, ahead
        if row["frontier"] is not None:
            self.state = row
        else:
            self.fetched[row["node"]] = (row["procedure"], row["outs"] or [])

    def terminate(self):
        s = self.state
        if s is None:
            return
        best = {n: c for n, c in s["best"]}
        found = {n: c for n, c in s["found"]}
        known = {n: (p, outs) for n, p, outs in s["known"]} | self.fetched
        frontier = [(key, n) for key, n in s["frontier"]]
        heapq.heapify(frontier)
        expansions, done = s["expansions"], False
        cap = math.inf if self.cap is None else self.cap
        while frontier and expansions < cap and not done and frontier[0][1] in known:
            _, node = heapq.heappop(frontier)
            expansions += 1
            cost, (procedure, outs) = best[node], known[node]
            if procedure:
                # Every way that reaches a procedure makes it likelier.
                found[node] = found.get(node, 0.0) + math.exp(-cost)
                if self.cap is not None and len(found) >= self.k:
                    done = True
                    break
            for _, dst, step, ahead in outs:
                if cost + step < best.get(dst, math.inf):
                    best[dst] = cost + step
                    heapq.heappush(frontier, (cost + step + ahead, dst))
        if len(best) > MOST_KNOWN and self.cap is None:
            raise ValueError(f"an exhaustive search knows of more than {MOST_KNOWN} nodes; use graph.route")
        done = done or not frontier or expansions >= cap
        ask = [] if done else list(dict.fromkeys(n for _, n in heapq.nsmallest(self.ahead, frontier) if n not in known))
        kept = [] if done else [(n, p, outs) for n, (p, outs) in known.items()]
        yield s["query_id"], [] if done else list(best.items()), [] if done else frontier, list(found.items()), kept, expansions, ask, done


def outgoing(nodes: DataFrame, edges: DataFrame, boosted: DataFrame | None, cap: int | None) -> DataFrame:
    """(node, procedure, ahead, outs): each node's edges in their order, with the penalty that lies ahead of them.

    Of edges alike in ends and cost the first is enough, as a later one makes nothing cheaper.
    With a cap on expansions a node's ``cap`` nearest neighbours are enough: the rest
    stand behind all of them in every queue.
    """
    if boosted is None:
        placed = nodes.select("node", "kind", F.lit(0.0).alias("ahead"))
    else:
        on = boosted.select("node").distinct().withColumn("on", F.lit(0.0))
        placed = nodes.join(on, "node", "left").select("node", "kind", F.coalesce("on", F.lit(1.0)).alias("ahead"))
    far = placed.select(F.col("node").alias("dst"), "ahead")
    firsts = edges.groupBy("src", "dst", "cost").agg(F.min("seq").alias("seq"))
    pairs = firsts.groupBy("src", "dst").agg(F.min("cost").alias("least"), F.collect_list(F.struct("seq", "cost")).alias("each"))
    pairs = pairs.join(far, "dst", "left").withColumn("ahead", F.coalesce("ahead", F.lit(0.0 if boosted is None else 1.0)))
    if cap is not None:
        near = Window.partitionBy("src").orderBy(F.col("least") + F.col("ahead"), "dst")
        pairs = pairs.withColumn("near", F.row_number().over(near)).where(F.col("near") <= cap)
    each = pairs.select("src", F.explode("each").alias("e"), "dst", "ahead")
    outs = each.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("e.seq", "dst", "e.cost", "ahead"))).alias("outs"))
    return placed.join(outs, "node", "full").select(
        "node", F.coalesce(F.col("kind") == "procedure", F.lit(False)).alias("procedure"), F.coalesce("ahead", F.lit(0.0 if boosted is None else 1.0)).alias("ahead"), "outs"
    )


def best_first(
    seeds: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 20, max_expansions: int = 400, boosted: DataFrame | None = None,
    exhaustive: bool = False, ahead: int = AHEAD,
) -> DataFrame:
    """(query_id, node, score, place): the ``k`` likeliest procedures that a best-first search meets.

    seeds: query_id, node; nodes: node, kind; edges: src, dst, cost, seq (their order at a node);
    boosted: node, those before which no penalty of 1 lies.  A search ends with ``k`` procedures or after
    ``max_expansions`` nodes; ``exhaustive`` ones end with their queue and return all they
    met.  A procedure's score adds exp(-cost) each time it leaves the queue; ties go to the
    one met first.  Equal keys leave the queue by node.  Seeds that aren't nodes, repeated
    seeds and empty tables add nothing; each query is a group of its own.
    """
    cap = None if exhaustive else max_expansions
    adjacent = cut(outgoing(nodes, edges, boosted, cap))
    kinds = {f.name: f.dataType.simpleString() for f in seeds.select("query_id", "node").schema}
    node = kinds["node"]
    out_type = f"array<struct<seq:{edges.schema['seq'].dataType.simpleString()},dst:{node},cost:double,ahead:double>>"
    types = {
        "best": f"array<struct<node:{node},cost:double>>", "frontier": f"array<struct<key:double,node:{node}>>", "found": f"array<struct<node:{node},score:double>>",
        "known": f"array<struct<node:{node},procedure:boolean,outs:{out_type}>>", "expansions": "int",
    }
    schema = f"query_id {kinds['query_id']}, " + ", ".join(f"{c} {t}" for c, t in types.items()) + f", ask array<{node}>, done boolean"
    search = udtf(_Search, returnType=schema)
    start = seeds.select("query_id", "node").distinct().join(adjacent.select("node", "ahead"), "node")
    if cap is not None:
        first = Window.partitionBy("query_id").orderBy("ahead", "node")
        start = start.withColumn("r", F.row_number().over(first)).where(F.col("r") <= cap)
    state = start.groupBy("query_id").agg(
        F.collect_list(F.struct("node", F.lit(0.0).alias("cost"))).alias("best"), F.collect_list(F.struct(F.col("ahead").alias("key"), "node")).alias("frontier")
    ).select(
        "query_id", F.col("best").cast(types["best"]).alias("best"), F.col("frontier").cast(types["frontier"]).alias("frontier"),
        F.array().cast(types["found"]).alias("found"), F.array().cast(types["known"]).alias("known"), F.lit(0).alias("expansions"),
        F.transform(F.slice(F.array_sort("frontier"), 1, ahead), lambda e: e["node"]).alias("ask"), F.lit(False).alias("done"),
    )
    state, done = cut(state), None
    while True:
        over = state.where("done").select("query_id", "found")
        done = over if done is None else done.unionByName(over)
        state = state.where("NOT done")
        if state.isEmpty():
            break
        asked = state.select("query_id", F.explode("ask").alias("node")).join(adjacent.select("node", "procedure", F.col("outs").cast(out_type).alias("outs")), "node", "left")
        rows = state.select("query_id", *_STATE).unionByName(asked.select("query_id", "node", "procedure", "outs"), allowMissingColumns=True)
        limit = F.lit(None).cast("int") if cap is None else F.lit(cap)
        state = cut(search(rows.asTable().partitionBy("query_id"), F.lit(k), limit, F.lit(ahead)))
    met = done.select("query_id", F.posexplode("found").alias("met", "f")).select("query_id", "met", "f.node", "f.score")
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "met")))
    return (ranked if exhaustive else ranked.where(F.col("place") <= k)).select("query_id", "node", "score", "place")


ship_by_value(__name__)
