"""Reference resolution, bounded walks, least-cost routes and centrality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .. import ship_by_value
from ..functions.text import short_terms
from ..plans.lineage import cut, written
from . import index, ranks


def link_candidates(segments: DataFrame, always_two: bool = False) -> DataFrame:
    """(src, link, need, toks, dst): segments that hold one of a link's rarest tokens.

    A target shares ``need`` of the link's n tokens, so it holds one of any n - need + 1 of
    them; the ones that fewest labels hold are asked for.  A token that is everywhere is
    asked for only by links that one token is enough for.
    """
    links = segments.select(F.col("ord").alias("src"), F.posexplode("links").alias("link", "text")).select(
        "src", "link", F.array_distinct(short_terms(F.col("text"))).alias("toks")
    )
    n = F.size("toks")
    half = F.greatest(F.lit(2), F.floor(n / 2)).cast("int")
    need = F.lit(2) if always_two else F.when(n <= 2, 1).otherwise(half)
    held = segments.select(F.col("ord").alias("dst"), F.explode(F.array_distinct(short_terms(F.col("label")))).alias("tok"))
    often = held.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    # A token that no label holds is the rarest; it takes a place and finds nothing.
    ranked = links.withColumn("need", need).select("src", "link", "need", "toks", F.explode("toks").alias("tok")).join(often, "tok", "left")
    first = ranked.groupBy("src", "link").agg(
        F.first("need").alias("need"), F.first("toks").alias("toks"), F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok"))).alias("all")
    )
    some = F.slice("all", 1, F.greatest(F.size("toks") - F.col("need") + 1, F.lit(0)))
    asked = first.select("src", "link", "need", "toks", F.explode(F.filter(some, lambda t: t["df"] > 0)).alias("t")).select("src", "link", "need", "toks", "t.tok")
    return asked.join(held, "tok").where("src <> dst").select("src", "link", "need", "toks", "dst").distinct()


def resolve_links(segments: DataFrame, always_two: bool = False) -> DataFrame:
    """(src, dst, seq): segments that share enough tokens with a link's text.

    segments: ord, links array<string>, label string.  A link of one or two tokens needs
    one shared token, a longer one half of its tokens and two at least (``always_two``:
    two for every link).  Targets are numbered by link and then ``ord``.  Only candidates by
    rare tokens are counted exactly.
    """
    labels = segments.select(F.col("ord").alias("dst"), F.array_distinct(short_terms(F.col("label"))).alias("own"))
    met = link_candidates(segments, always_two).join(labels, "dst").where(F.size(F.array_intersect("toks", "own")) >= F.col("need"))
    edges = met.groupBy("src", "dst").agg(F.min("link").alias("link"))
    return edges.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("link", "dst")).alias("seq"))


def resolution_rate(segments: DataFrame, edges_per_link: DataFrame) -> DataFrame:
    """Share of all links with one target or more; links without a token count as unresolved."""
    links = segments.select(F.col("ord").alias("src"), F.posexplode("links").alias("link", "text"))
    hit = edges_per_link.select("src", "link").distinct().withColumn("hit", F.lit(1))
    return links.join(hit, ["src", "link"], "left").agg(
        F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("rate")
    )


def pick_entries(ranked: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k best of each query, segments with a way on first, then by rank."""
    out = edges.select(F.col("src").alias("ord")).distinct().withColumn("on", F.lit(1))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("on", F.lit(0)).desc(), "rank")
    return (
        ranked.join(out, "ord", "left")
        .withColumn("chain", F.row_number().over(order))
        .where(F.col("chain") <= k)
        .select("query_id", "chain", "ord", "score")
    )


def chase(entries: DataFrame, edges: DataFrame, scores: DataFrame, rel: float = 0.5, max_depth: int = 4) -> DataFrame:
    """(query_id, chain, path): from each entry, on to the best-scoring new neighbour.

    A walk ends where the best neighbour scores below ``rel`` times the entry (equal goes
    on), has no neighbour left, or is ``max_depth`` steps long.  Ties go to the first edge.
    """
    state = entries.select(
        "query_id", "chain", F.col("ord").alias("cur"), F.array("ord").alias("path"),
        F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(1e-9)).alias("base"),
    )
    scored = scores.select("query_id", F.col("ord").alias("dst"), F.col("score").alias("s"))
    best = Window.partitionBy("query_id", "chain").orderBy(F.desc("s"), "seq")
    done, state = None, cut(state)
    for _ in range(max_depth):
        onward = cut(
            state.join(edges.select(F.col("src").alias("cur"), "dst", "seq"), "cur")
            .where(~F.array_contains("path", F.col("dst")))
            .join(scored, ["query_id", "dst"], "left")
            .withColumn("s", F.coalesce("s", F.lit(0.0)))
            .withColumn("r", F.row_number().over(best))
            .where((F.col("r") == 1) & (F.col("s") >= rel * F.col("base")))
            .select("query_id", "chain", F.col("dst").alias("cur"), F.concat("path", F.array("dst")).alias("path"), "base")
        )
        ended = state.join(onward.select("query_id", "chain"), ["query_id", "chain"], "left_anti").select("query_id", "chain", "path")
        done = ended if done is None else done.unionByName(ended)
        state = onward
    rest = state.select("query_id", "chain", "path")
    return rest if done is None else done.unionByName(rest)


#: Terms whose numbers are broadcast, those of most segments.
_OFTEN = 500_000


def coded_terms(seg_terms: DataFrame, idf: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((ord, ids, alone) of every segment, first id and weight of each class of terms that weigh alike).

    A term held by several segments is a number, the commonest first by their weight; ``alone`` is the weight
    of the terms that no other segment holds, which can't be covered by any.
    """
    each = seg_terms.select("ord", F.explode(F.array_distinct("terms")).alias("tok"))
    held = each.groupBy("tok").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).join(idf.select("tok", "idf"), "tok")
    held = written(held, "held")
    alone = held.where("n = 1").groupBy("ord").agg(F.sum("idf").alias("alone"))
    ids, _ = ranks.numbered(held.where("n > 1").select("tok", "idf"), ["idf", "tok"])
    ids = written(ids.select("tok", "idf", F.col("rn").cast("int").alias("id")), "ids")
    # A row for each different weight: as many as there are different counts of holders.
    classes = ids.groupBy("idf").agg(F.min("id").alias("id")).orderBy("id").toArrow()
    common, rare = F.broadcast(ids.where(F.col("id") <= _OFTEN).select("tok", "id")), ids.where(F.col("id") > _OFTEN)
    # The common terms of a segment are together again before anything is shuffled.
    own = seg_terms.select("ord", F.explode_outer(F.array_distinct("terms")).alias("tok")).join(common, "tok", "left").select("ord", "id")
    rest = each.join(common, "tok", "left_anti").join(rare, "tok").select("ord", "id")
    sets = own.unionByName(rest).groupBy("ord").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    coded = sets.join(alone, "ord", "left").select("ord", "ids", F.coalesce("alone", F.lit(0.0)).alias("alone"))
    return written(coded, "coded"), classes.column("id").to_numpy(), classes.column("idf").to_numpy()


def _gains(first: np.ndarray, weight: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel: the last three columns (ids, alone, covered) become the weight of the ids that aren't covered, and what is alone."""

    def parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists), dtype=np.int64), lists.value_lengths().to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                ids, rows = parts(batch.column("ids"))
                known, theirs = parts(batch.column("covered"))
                asked, held = rows << 32 | ids, np.append(np.sort(theirs << 32 | known), np.int64(-1))
                fresh = held[np.searchsorted(held[:-1], asked)] != asked
                w = weight[np.searchsorted(first, ids[fresh], side="right") - 1]
                gain = np.bincount(rows[fresh], weights=w, minlength=len(batch)) + batch.column("alone").to_numpy()
                names = batch.schema.names[:-3]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(gain)], [*names, "gain"])

    return run


def chase_coverage(
    entries: DataFrame, edges: DataFrame, seg_terms: DataFrame, idf: DataFrame, scores: DataFrame | None = None,
    rel_floor: float = 0.0, max_depth: int = 3,
) -> DataFrame:
    """(query_id, chain, path): from each entry, on to the neighbour whose new terms weigh most.

    seg_terms: (ord, terms array); idf: (tok, idf).  A step needs a gain above 0 and, with
    ``rel_floor``, a score of that share of the entry's.  Walks carry their path only; the terms that
    meet at a step are numbers.
    """
    coded, first, weight = coded_terms(seg_terms, idf)
    state = entries.join(coded.select("ord"), "ord").select(
        "query_id", "chain", F.col("ord").alias("cur"), F.array("ord").alias("path"),
        F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(1e-9)).alias("base"),
    )
    done, state = None, cut(state)
    for _ in range(max_depth):
        options = (
            state.join(edges.select(F.col("src").alias("cur"), "dst", "seq"), "cur").where(~F.array_contains("path", F.col("dst")))
        )
        if scores is not None and rel_floor > 0:
            s = scores.select("query_id", F.col("ord").alias("dst"), F.col("score").alias("s"))
            options = options.join(s, ["query_id", "dst"], "left").where(F.coalesce("s", F.lit(0.0)) >= rel_floor * F.col("base"))
        offered = options.select("query_id", "chain", "seq", F.col("dst").alias("ord")).join(coded, "ord")
        # A path's few sets, as its kernel row needs them.
        covered = state.select("query_id", "chain", F.explode("path").alias("ord")).join(coded.select("ord", "ids"), "ord").groupBy("query_id", "chain").agg(
            F.flatten(F.collect_list("ids")).alias("covered")
        )
        met = offered.join(covered, ["query_id", "chain"]).select("query_id", "chain", "seq", F.col("ord").alias("dst"), "ids", "alone", "covered")
        schema = StructType([*met.select("query_id", "chain", "seq", "dst").schema.fields, StructField("gain", DoubleType())])
        gains = met.mapInArrow(_gains(first, weight), schema).withColumn("gain", F.round("gain", 9)).where("gain > 0")
        best = gains.groupBy("query_id", "chain").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "seq", "dst"))["dst"].alias("dst"))
        onward = cut(
            state.join(best, ["query_id", "chain"])
            .select("query_id", "chain", F.col("dst").alias("cur"), F.concat("path", F.array("dst")).alias("path"), "base")
        )
        ended = state.join(onward.select("query_id", "chain"), ["query_id", "chain"], "left_anti").select("query_id", "chain", "path")
        done = ended if done is None else done.unionByName(ended)
        state = onward
    rest = state.select("query_id", "chain", "path")
    return rest if done is None else done.unionByName(rest)


def within(entries: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(query_id, ord): all segments that walks of so many steps from the entries could meet, the pairs whose scores they need."""
    met = reach(entries.select("query_id", F.col("ord").alias("node")), edges, steps, None)
    return met.select("query_id", F.col("node").alias("ord"))


def reach(seeds: DataFrame, edges: DataFrame, hops: int = 3, fanout: int | None = 5) -> DataFrame:
    """(query_id, node, hop) of all nodes within ``hops``; each node goes on to its first ``fanout`` edges, None: to all."""
    first = (edges if fanout is None else edges.where(F.col("seq") <= fanout)).select(F.col("src").alias("node"), F.col("dst"))
    seen = seeds.select("query_id", "node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        front = (
            front.join(first, "node").select("query_id", F.col("dst").alias("node")).distinct()
            .join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        front = cut(front)
        seen = seen.unionByName(front)
    return seen


#: What a walk goes by: the best score; the weight of new terms; new terms, above a fifth of the entry's score.
CRITERIA = {"bm25": None, "coverage": 0.0, "coverage_guarded": 0.2}


def chase_by(
    criterion: str, entries: DataFrame, edges: DataFrame, scores: DataFrame, seg_terms: DataFrame, idf: DataFrame, rel: float = 0.5, max_depth: int = 4
) -> DataFrame:
    """(query_id, chain, path) by one of ``CRITERIA``; ``rel`` bounds the walk by score alone."""
    floor = CRITERIA[criterion]
    if floor is None:
        return chase(entries, edges, scores, rel, max_depth)
    return chase_coverage(entries, edges, seg_terms, idf, scores, floor, max_depth)


def symptom_seeds(segments: DataFrame, queries: DataFrame, text: str, entries: int = 3) -> DataFrame:
    """(query_id, node): the ``entries`` segments with symptoms that share most terms with a query, one at least; ties by ``ord``.

    segments: ord, symptoms and ``text``; queries: query_id, symptom.
    """
    own = segments.where(F.size("symptoms") > 0).select("ord", F.explode(F.array_distinct(short_terms(F.col(text)))).alias("tok"))
    asked = queries.select("query_id", F.explode(F.array_distinct(short_terms(F.col("symptom")))).alias("tok"))
    met = own.join(asked, "tok").groupBy("query_id", "ord").agg(F.count(F.lit(1)).alias("overlap"))
    placed = met.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "ord")))
    return placed.where(F.col("r") <= entries).select("query_id", F.col("ord").alias("node"))


def chain_reach(segments: DataFrame, edges: DataFrame, queries: DataFrame, text: str, hops: int = 3, entries: int = 3, fanout: int = 5) -> DataFrame:
    """(query_id, node, hop): segments within ``hops`` of a query's best symptom segments; a query that matches none has no row."""
    return reach(symptom_seeds(segments, queries, text, entries), edges, hops, fanout)


def route(seeds: DataFrame, edges: DataFrame, max_rounds: int = 1000, limits: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, node, cost): least sum of edge costs from the seeds, to every node in reach.

    Each round goes on from the nodes that the round before made cheaper, until there are none.
    ``limits`` tells from the costs so far (query_id, limit), beyond which a query needs no cost: no
    round goes on from where the next step passes it, and costs beyond it may lack or be too high.
    """
    best = cut(seeds.select("query_id", "node").distinct().withColumn("cost", F.lit(0.0)))
    steps = edges.groupBy(F.col("src").alias("node"), "dst").agg(F.min("cost").alias("step"))
    steps, front = cut(steps), best
    least = steps.agg(F.min("step")).first()[0] if limits is not None else None
    for _ in range(max_rounds):
        on = index.sent(front).join(steps, "node").groupBy("query_id", F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("new"))
        front = cut(on.join(best, ["query_id", "node"], "left").where("cost is null or new < cost - 1e-12").select("query_id", "node", F.col("new").alias("cost")))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("query_id", "node").agg(F.min("cost").alias("cost")))
        if least is not None and least >= 0:
            far = F.col("cost") + least > F.col("limit") + 1e-6
            front = cut(front.join(limits(best), "query_id", "left").where(F.col("limit").isNull() | ~far).select("query_id", "node", "cost"))
    raise RuntimeError(f"routes did not settle in {max_rounds} rounds")


def nearest_costs(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, k: int, boosted: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """``route`` as far as ``routed_segments`` with ``k`` needs it: a query's search ends where its k procedures can't change any more."""
    procedures = cut(nodes.where("kind = 'procedure'").select("node"))
    ahead = None if boosted is None else cut(boosted.select("node").distinct())

    def limits(costs: DataFrame) -> DataFrame:
        found = index.sent(costs).join(procedures, "node")
        order = F.col("cost")
        if ahead is not None:
            found = index.sent(found).join(ahead.withColumn("on", F.lit(1)), "node", "left")
            order = order + F.when(F.col("on") == 1, 0.0).otherwise(1.0)
        own = found.withColumn("limit", order)
        placed = own.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("limit")))
        return placed.where(F.col("place") == k).select("query_id", "limit")

    return route(seeds, edges, max_rounds, limits)


def routed_segments(costs: DataFrame, nodes: DataFrame, k: int | None = 20, boosted: DataFrame | None = None) -> DataFrame:
    """(query_id, node, score, place) of procedures in reach, the likeliest first; ``k`` None takes all.

    The score is exp(-cost).  Procedures among ``boosted`` (node), those of subsystems that look
    anomalous, come before others that are no more than one unit of cost cheaper.
    """
    found = costs.join(nodes.where("kind = 'procedure'").select("node"), "node")
    order = F.col("cost")
    if boosted is not None:
        found = found.join(boosted.select("node").distinct().withColumn("on", F.lit(1)), "node", "left")
        order = order + F.when(F.col("on") == 1, 0.0).otherwise(1.0)
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "node")))
    placed = placed.select("query_id", "node", F.exp(-F.col("cost")).alias("score"), "place")
    return placed if k is None else placed.where(F.col("place") <= k)


def pagerank(nodes: DataFrame, edges: DataFrame, *, alpha: float = 0.85, tol: float = 1e-6, max_rounds: int = 300, stride: int = 10) -> DataFrame:
    """(node, rank) on the undirected view; parallel edges weigh more, rank of lone nodes is dealt to all.

    Rounds go on until the ranks of all nodes together move by less than ``tol`` a node,
    which is looked at every ``stride`` rounds; only then is a round written.  What lone
    nodes deal out is in the constant that every node gets, as it settles.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    weighed = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    out = weighed.groupBy("src").agg(F.sum("w").alias("out"))
    steps = cut(weighed.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    every = nodes.select("node").union(steps.select("src")).distinct()
    lone = cut(every.join(steps.select(F.col("src").alias("node")), "node", "left_anti"))
    n, alone = every.count(), lone.count()
    base = (1 - alpha) / max(n - alpha * alone, 1e-9)
    rank = steps.select(F.col("src").alias("node")).distinct().withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(0, max_rounds, stride):
        before = rank
        for _ in range(stride):
            rank = steps.join(rank, steps["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg((base + alpha * F.sum(F.col("rank") * F.col("p"))).alias("rank"))
        rank = cut(rank)
        moved = rank.join(before.select("node", F.col("rank").alias("was")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        if (moved or 0.0) < n * tol:
            break
    else:
        raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")
    return rank.union(lone.select("node", F.lit(base)))


def scaled_prior(ranks: DataFrame, segments: DataFrame | None = None, top: float = 0.1) -> DataFrame:
    """Ranks stretched to 0..top; alike ranks are all 0.  With ``segments`` (node) only theirs take part."""
    if segments is not None:
        ranks = ranks.join(segments.select("node").distinct(), "node", "left_semi")
    ends = ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    span = F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0))
    return ranks.crossJoin(F.broadcast(ends)).select("node", (top * (F.col("rank") - F.col("lo")) / span).alias("prior"))


ship_by_value(__name__)
