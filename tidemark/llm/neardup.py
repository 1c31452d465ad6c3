"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Texts become 64-bit fingerprints in Arrow batches.  Equal fingerprints are one node.
Nodes are grouped by the population counts of their two 32-bit halves and cut into
tiles; two fingerprints within the radius cannot differ by more than it in the sum of
those counts, so only tile pairs within that distance meet.  Each meeting is an
exclusive-or and bit count over whole tiles in numpy.  What leaves it is a spanning
forest of the links it found, never the pairs of a group, and components of the forest
are found by distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship_by_value
from ._bytes import buffers
from ._spark import checkpointed, sent, table
from .components import connected_components, least_roots

RADIUS = 4
SHINGLE = 4
TILE = 8192
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of every ``width``-word shingle; fewer words make one shingle."""
    words = text.lower().split()
    n = len(words)
    if n <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if n else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            out = [fingerprint(shingle_hashes(raw[a:b], width)) for a, b in zip(at, at[1:])]
            fp = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(fp, pa.int64())], ["doc_id", "row", "fp"]
            )

    return run


def row_key() -> Column:
    """Identity of a row by id and text; rows alike in both are one and the same."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp) of every document; null and empty texts have fingerprint zero."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    return rows.mapInArrow(_fingerprints(width), "doc_id long, row long, fp long")


def links_of(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between two tiles (a tile with itself: within it)."""
    same = a is b
    nodes = a if same else np.concatenate([a, b])
    root = np.arange(len(nodes))
    shift = 0 if same else len(a)
    for first in range(0, len(a), rows):
        near = np.bitwise_count(a[first : first + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        # Links already bridged by earlier rows fall away at once.
        i, j = root[i + first], root[j + shift]
        if (i != j).any():
            root = least_roots(len(nodes), i, j)[root]
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _meet(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, own = batch.column("left"), batch.column("right"), batch.column("own").to_pylist()
            for k in range(batch.num_rows):
                a = left[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = a if own[k] else right[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                x, y = links_of(a, b, radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest of every link between the distinct fingerprints ``nodes.fp``."""
    most = nodes.count()
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    classed = nodes.select(
        "fp",
        F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("hi"),
        F.bit_count(low).cast("int").alias("lo"),
    )
    # At most 33 * 33 classes; the number of chunks in each follows its size.
    sizes = classed.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks"))
    tiles = checkpointed(
        classed.join(F.broadcast(sizes), ["hi", "lo"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .groupBy("hi", "lo", "chunk")
        .agg(F.collect_list("fp").alias("fps")),
        most,
    )
    steps = [
        (h, w)
        for h in range(0, radius + 1)
        for w in range(-radius, radius + 1)
        if h + abs(w) <= radius and (h > 0 or w >= 0)
    ]
    offsets = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in steps])
    left = tiles.select(
        F.col("chunk").alias("c1"), F.col("fps").alias("left"), F.explode(offsets).alias("step"), "hi", "lo"
    ).select(
        "c1", "left", (F.col("hi") + F.col("step.h")).alias("hi"), (F.col("lo") + F.col("step.w")).alias("lo"),
        ((F.col("step.h") == 0) & (F.col("step.w") == 0)).alias("same"),
    )
    # A class and number for each tile.  Pairs fetch their right side by tile, so a large class is dealt out too.
    named = sent(tiles.select("hi", "lo", F.col("chunk").alias("c2")), most // tile + 33 * 33)
    pairs = left.join(named, ["hi", "lo"]).where("not same or c1 <= c2")
    pairs = pairs.select("hi", "lo", "c2", "left", F.expr("same and c1 = c2").alias("own"))
    right = tiles.select("hi", "lo", F.col("chunk").alias("c2"), F.col("fps").alias("right"))
    meet = pairs.join(right, ["hi", "lo", "c2"])
    meet = meet.select("left", F.when(F.col("own"), F.array().cast("array<long>")).otherwise(F.col("right")).alias("right"), "own")
    return meet.mapInArrow(_meet(radius), "a long, b long")


def components(marks: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, component_id) of every fingerprint: the least doc_id reachable over links."""
    most = marks.count()
    nodes = checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), most)
    roots = connected_components(checkpointed(near_links(nodes.select("fp"), radius, tile)))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        nodes["fp"], "least", F.coalesce("root", nodes["fp"]).alias("root")
    )
    named = checkpointed(named, most)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null ids are members without being a component's name; a component of null ids
    only has a null name.  Null, empty and blank texts have fingerprint zero.  Repeated rows
    stay repeated; an empty table gives an empty result.
    """
    marks = checkpointed(fingerprints(table(spark, sf_dir, "documents")))
    groups = components(marks)
    return marks.join(groups, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


ship_by_value(__name__)
