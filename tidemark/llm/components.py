"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship_by_value
from ._spark import checkpointed

#: Links that one task contracts among themselves before the distributed rounds.
CHUNK = 1_000_000
#: Edges from which a node is a hub.
HUB = 1 << 14


def least_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable index of each of ``n`` nodes over the links i-j."""
    parent = np.arange(n)
    while len(i):
        ri, rj = parent[i], parent[j]
        apart = ri != rj
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
        while ((up := parent[parent]) != parent).any():
            parent = up
    return parent


def _contract(whole: bool):
    """A task's links as stars: each node with the least node it reaches over them; if ``whole``, roots as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        links = pa.Table.from_batches(tables)
        v, m = links.column("a").to_numpy(), links.column("b").to_numpy()
        nodes, place = np.unique(np.concatenate([v, m]), return_inverse=True)
        place = place.reshape(-1)
        root = least_roots(len(nodes), place[: len(v)], place[len(v) :])
        shown = np.arange(len(nodes)) if whole else np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[shown]), pa.array(nodes[root[shown]])], ["node", "root"])

    return run


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b longs); root is the least node reachable.

    ``edges`` is read twice, so pass a table that is written.  Chunks of ``CHUNK`` links are
    contracted each within a task; a single chunk has seen all links and is done.  Otherwise
    large-star and small-star steps alternate until no root is a child and every child has
    one root.  Minima are pre-aggregated before each shuffle, and hubs meet their edges by a
    broadcast of 2 * links / ``HUB`` rows at most, so no hub's edges meet in one task.  Each
    round is checkpointed, so a lost executor costs no earlier round.
    """
    links = edges.select("a", "b")
    parts = max(1, -(-links.count() // CHUNK))
    dealt = links.coalesce(1) if parts == 1 else links.repartition(parts)
    links = checkpointed(dealt.mapInArrow(_contract(parts == 1), "node long, root long"))
    if parts == 1:
        return links
    links = links.toDF("v", "m")
    most = links.count()
    for _ in range(max_rounds):
        links = checkpointed(_small_star(_large_star(links)), 2 * most)
        ends = links.select("v", F.lit(1).alias("child"), F.lit(0).alias("root")).union(links.select("m", F.lit(0), F.lit(1)))
        torn = ends.groupBy("v").agg(F.sum("child").alias("child"), F.max("root").alias("root")).where("child + root > 1")
        if torn.isEmpty():
            return links.select(F.col("v").alias("node"), F.col("m").alias("root")).union(links.select("m", "m").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _joined(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """``edges`` with what ``least`` (one row per node, its edges counted in n) says of ``key``."""
    hubs = F.broadcast(least.where(F.col("n") >= HUB))
    plain = edges.join(hubs.select(key), key, "left_anti").join(least.where(F.col("n") < HUB), key)
    return plain.union(edges.join(hubs, key).select(*plain.columns))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbours and itself."""
    both = links.select(F.col("v").alias("u"), F.col("m").alias("w")).union(
        links.select(F.col("m").alias("u"), F.col("v").alias("w"))
    )
    least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _joined(both.where("w > u"), least, "u").select(F.col("w").alias("v"), "m").where("v != m").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are handed to the least of them."""
    least = links.groupBy("v").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("n"))
    handed = _joined(links, least, "v")
    return (
        handed.select(F.col("m").alias("v"), F.col("least").alias("m"))
        .union(handed.select("v", F.col("least").alias("m")))
        .where("v != m")
        .distinct()
    )


ship_by_value(__name__)
