"""Exact top-k search: exhaustive term-at-a-time accumulation in blocks.

A vector's components are its terms.  Candidates are packed, in the partitions they are
read in, into blocks of at most ``BLOCK`` rows that hold one posting list per
component: places and weights of the rows where it isn't zero.  Queries are packed into
blocks of sparse rows.  Every query block meets every candidate block once, in a grid of
stripes of candidate blocks and groups of query blocks: a candidate block goes out once
for each ``GROUP`` query blocks and a query block once for each stripe.  A stripe holds
``STRIPE`` candidate blocks at most, so there are as many tasks as the grid has cells
however large it grows; fewer blocks are dealt to ``STRIPES`` stripes.  There, term by
term, a query's weight scatters the weighted postings into a dense integer score array,
a partition selects the block's best, and a window merges the blocks' lists.  Scores are
exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ship_by_value
from ._spark import checkpointed, table

K = 10
SCALE = 1024.0
QUERY_MODULUS = 100
BLOCK = 4096
QUERY_BLOCK = 1024
#: Stripes that a small table is dealt to, and candidate blocks of one stripe of a large one.
STRIPES, STRIPE = 64, 64
#: Query blocks that meet a stripe of candidates together, some 32 MB.
GROUP = 64
_PACKED = "block long, n int, ids binary, values binary"


def _packer(block: int):
    """Rows (vec_id, components) of a partition as blocks with the components row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            nonlocal count
            i, n, v = np.concatenate(ids), np.concatenate(lengths), np.concatenate(flat)
            ids.clear(), flat.clear(), lengths.clear()
            head = np.concatenate([i, n.astype(np.int64)])
            count += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + count - 1]), pa.array([len(i)], pa.int32()), pa.array([head.tobytes()]), pa.array([v.tobytes()])],
                ["block", "n", "ids", "values"],
            )

        for batch in batches:
            column = batch.column("v")
            for first in range(0, batch.num_rows, block):
                piece = column.slice(first, block)
                ids.append(batch.column("vec_id").slice(first, block).to_numpy())
                lengths.append(np.diff(piece.offsets.to_numpy()))
                flat.append(piece.flatten().to_numpy())
                if sum(map(len, ids)) >= block:
                    yield packed()
        if ids:
            yield packed()

    return run


def _unpack(n: int, ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head = np.frombuffer(ids, np.int64)
    return head[:n], head[n:], np.frombuffer(values, np.int64)


def postings(lengths: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """(rows, weights) of each component; rows is None where no row lacks it."""
    n, width = len(lengths), int(lengths.max(initial=0))
    row = np.repeat(np.arange(n), lengths)
    dense = np.zeros((width, n), np.int64)
    dense[np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = values
    out: list[tuple[np.ndarray | None, np.ndarray]] = []
    for term in dense:
        at = np.flatnonzero(term)
        out.append((None, term) if len(at) == n else (at, term[at]))
    return out


def best_of_block(query: np.ndarray, own: int, lists: list, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the block's k best for one query, its own row left out."""
    score = np.zeros(len(ids), np.int64)
    for t in np.flatnonzero(query[: len(lists)]):
        at, weights = lists[t]
        if at is None:
            score += query[t] * weights
        else:
            score[at] += query[t] * weights
    others = np.flatnonzero(ids != own)
    if len(others) > k:
        kept = score[others]
        floor = kept[np.argpartition(kept, len(kept) - k)[len(kept) - k :]].min()
        others = others[kept >= floor]
    order = np.lexsort((ids[others], -score[others]))[:k]
    return ids[others[order]], score[others[order]]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for k_row in range(batch.num_rows):
                r = batch.slice(k_row, 1).to_pylist()[0]
                qid, qlen, qval = _unpack(r["qn"], r["qids"], r["qvalues"])
                # The query blocks that a candidate block meets follow each other.
                if r["block"] != block:
                    block, (ids, lengths, values) = r["block"], _unpack(r["n"], r["ids"], r["values"])
                    lists = postings(lengths, values)
                ends = np.cumsum(qlen)
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for q in range(len(qid)):
                    got, score = best_of_block(qval[ends[q] - qlen[q] : ends[q]], qid[q], lists, ids, k)
                    for c, x in zip(cols, (np.full(len(got), qid[q]), np.full(len(got), (r["qblock"] << 20) + q), got, score)):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["query_id", "place", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k rows of largest inner product.

    vectors, queries: (vec_id long, v array<long>).  Ties go to the smaller vec_id.
    Candidates with the query's own vec_id are left out.
    """
    packed = checkpointed(vectors.mapInArrow(_packer(block), _PACKED))
    n_queries = queries.count()
    asked = queries.repartition(max(1, math.ceil(n_queries / query_block))).mapInArrow(_packer(query_block), _PACKED)
    asked = checkpointed(asked.toDF("qblock", "qn", "qids", "qvalues"))
    blocks = packed.count()
    stripes, groups = max(1, min(blocks, STRIPES), math.ceil(blocks / STRIPE)), max(1, math.ceil(asked.count() / GROUP))
    left = packed.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = asked.withColumn("q", F.pmod(F.xxhash64("qblock"), F.lit(groups)).cast("int")).withColumn(
        "stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    )
    found = left.join(right, ["q", "stripe"]).mapInArrow(_search(k), "query_id long, place long, vec_id long, score long")
    by_query = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): components as floor(1024 * x); vectors that are null or hold a null or no finite number go."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v")
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows by inner product for every row whose vec_id is divisible by 100.

    Rows without a vec_id take no part; ties go to the smaller vec_id; an empty table gives
    an empty result.  Components beyond the long range are held to it, and scores wrap
    beyond 64 bits.  A repeated row is a candidate as often as it
    stands; a query row that stands more than once is asked once.
    """
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    queries = vectors.where(F.col("vec_id") % QUERY_MODULUS == 0).dropDuplicates(["vec_id", "v"])
    return top_k(vectors, queries)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ship_by_value(__name__)
