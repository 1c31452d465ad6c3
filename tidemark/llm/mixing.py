"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

A source's documents are permuted by a seeded hash and fall into ``BLOCKS`` blocks of
equal hash width.  From one row per (source, block) follow, in this order:

* targets: the weighted share of all words, held to ``max_repeat`` times the source's
  size, the excess reshared by weight until no target is above its bound;
* block quotas: the number of block draws whose words come nearest the target; whole
  passes over the source first, then the first ``k`` blocks of the permutation;
* a splitting tree over the output shards: each node halves its draws, and how many of
  each source go left is one multivariate-hypergeometric draw;
* disjoint ranges: a shard takes its quota of a source as the next run of block draws.

A document's copies and shards are then a function of its source and hash and a table
with one row per source, so no window or join moves texts.  Rows are shuffled within
their shard by a second hash.  Reruns agree, as all draws come from ``seed``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, literal_rows, table

BLOCKS = 4096
WEIGHTS = (5, 2, 1)
#: A per-source table below this many bytes is broadcast; a larger one is joined by Spark's own choice.
BROADCAST_BYTES = 8 << 20
#: Words, some 120 MB, for which an output shard gets one more partition.
PART_WORDS = 20_000_000
_TOKEN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key in code-point order with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def permutation_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def block_of(h: Column, blocks: int) -> Column:
    """Block 0 to blocks-1 by the upper bits of the hash."""
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(blocks)).cast("int")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, max_repeat: float = 3.0) -> list[float]:
    """Words wanted of each source, in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    bound = [max_repeat * s for s in sizes]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > bound[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in sorted(over):
            out[i] = bound[i]
            left -= bound[i]
            open_.discard(i)
    return out


#: Draws beyond which numpy draws no hypergeometric numbers.
_MOST_DRAWS = 1_000_000_000


def _drawn(rng: np.random.Generator, have: np.ndarray, draws: int) -> np.ndarray:
    """How many of ``draws`` fall on each source, by one multivariate-hypergeometric draw.

    So many draws that numpy takes none (some 81,000 sources and more) are first split
    between two halves of the sources by the normal limit of the distribution.
    """
    total = int(have.sum())
    if not draws:
        return np.zeros_like(have)
    if len(have) == 1:
        return np.array([draws], np.int64)
    if total < _MOST_DRAWS:
        return rng.multivariate_hypergeometric(have, draws, method="marginals")
    half = max(1, len(have) // 2)
    left = int(have[:half].sum())
    share = left / total
    spread = math.sqrt(draws * share * (1 - share) * (total - draws) / (total - 1))
    taken = int(min(left, draws, max(0, draws - (total - left), round(rng.normal(draws * share, spread)))))
    return np.concatenate([_drawn(rng, have[:half], taken), _drawn(rng, have[half:], draws - taken)])


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """(shard, source) block draws; each tree node splits its draws by one hypergeometric draw."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n_shards, len(quotas)), np.int64)
    stack = [(0, n_shards, np.asarray(quotas, np.int64))]
    while stack:
        first, n, have = stack.pop()
        if n == 1:
            out[first] = have
            continue
        left_n = n // 2
        draws = int(have.sum()) * left_n // n
        left = _drawn(rng, have, draws)
        stack.append((first + left_n, n - left_n, have - left))
        stack.append((first, left_n, left))
    return out


def mixing_plan(
    rows: DataFrame, n_shards: int, seed: int, weights: tuple[int, ...], max_repeat: float, blocks: int
) -> tuple[DataFrame, int]:
    """One row per source: size, target, passes, k and where each shard's run of draws starts; the words of all.

    rows: ``skey``, ``size`` and ``h`` of every document.
    """
    spark = rows.sparkSession
    per_block = checkpointed(
        rows.groupBy("skey", block_of(F.col("h"), blocks).alias("block")).agg(F.sum("size").alias("words")),
        rows.count(),
    )
    sizes = {r["skey"]: r["words"] for r in per_block.groupBy("skey").agg(F.sum("words").alias("words")).collect()}
    keys = sorted(sizes)
    wanted = targets([sizes[k] for k in keys], weights, max_repeat)
    passes, rest = [], []
    for key, goal in zip(keys, wanted):
        whole = min(int(goal // sizes[key]), int(max_repeat)) if sizes[key] else 0
        passes.append(whole)
        rest.append(goal - whole * sizes[key])
    base = literal_rows(
        spark, [{"skey": k, "rest": r} for k, r in zip(keys, rest)], "skey string, rest double"
    )
    upto = Window.partitionBy("skey").orderBy("block")
    # The prefix of blocks whose words come nearest what is still wanted; none counts as well.
    nearest = (
        per_block.join(base, "skey")
        .withColumn("gap", F.abs(F.sum("words").over(upto) - F.col("rest")))
        .where("rest > 0")
        .groupBy("skey")
        .agg(F.min_by(F.col("block") + 1, F.struct("gap", "block")).alias("k"), F.min("gap").alias("gap"), F.first("rest").alias("rest"))
    )
    k_of = {r["skey"]: (r["k"] if r["gap"] <= r["rest"] else 0) for r in nearest.collect()}
    draws = [p * blocks + k_of.get(key, 0) for key, p in zip(keys, passes)]
    starts = np.vstack([np.zeros(len(keys), np.int64), np.cumsum(split_quotas(draws, n_shards, seed), axis=0)[:-1]])
    plan = literal_rows(
        spark,
        [
            {
                "skey": key,
                "source_size": sizes[key],
                "target": wanted[i],
                "passes": passes[i],
                "k": k_of.get(key, 0),
                "starts": starts[:, i].tolist(),
            }
            for i, key in enumerate(keys)
        ],
        "skey string, source_size bigint, target double, passes int, k int, starts array<bigint>",
    )
    plan_bytes = sum(len(key.encode()) + 8 * n_shards + 64 for key in keys)
    return F.broadcast(plan) if plan_bytes <= BROADCAST_BYTES else plan, sum(sizes.values())


def with_copies(rows: DataFrame, plan: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``copies`` and ``shards``: the output shard of each copy."""
    block = block_of(F.col("h"), blocks)
    joined = rows.join(plan, "skey").withColumn(
        "copies", F.col("passes") + F.when(block < F.col("k"), 1).otherwise(0)
    )
    draw = lambda c: (c * blocks + block).cast("long")
    shard = lambda c: F.size(F.filter("starts", lambda s: s <= draw(c))) - 1
    return joined.withColumn(
        "shards",
        F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), shard)).otherwise(
            F.array().cast("array<int>")
        ),
    )


def op5_mixing(spark: SparkSession, sf_dir: str, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """Words that the mix takes of each document.

    Null and empty texts have size 0 and add nothing; a source of size 0 has target 0; a
    null source is a source, the last.  Rows alike in id and text fall into one block and are
    taken alike; null ids are ids like others.  An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    rows = checkpointed(
        docs.select(
            "doc_id",
            source_key(F.col("source")).alias("skey"),
            word_count(F.col("text")).alias("size"),
            permutation_hash(seed).alias("h"),
        )
    )
    plan, _ = mixing_plan(rows, n_shards, seed, WEIGHTS, 3.0, BLOCKS)
    return with_copies(rows, plan, BLOCKS).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "shards",
    )


def mix_documents(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 17,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: float = 3.0,
    blocks: int = BLOCKS,
) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, shuffled within output shards.

    Partitions run from the first output shard to the last, one for each ``PART_WORDS`` of
    it, and rows within them by a hash of row and copy: written out, the order of files
    and rows is that of the mix.  Null and empty texts have size 0; they are copied as
    their block is.  Null sources are one source.  Repeated rows are taken alike.  An empty
    table gives an empty one.  Columns may have any names.
    """
    digest = docs.select(
        source_key(F.col("source")).alias("skey"),
        word_count(F.col("text")).alias("size"),
        permutation_hash(seed).alias("h"),
    )
    plan, words = mixing_plan(digest, n_shards, seed, weights, max_repeat, blocks)
    spread = max(1, -(-words // (n_shards * PART_WORDS)))
    carried = docs.select(
        F.struct(*docs.columns).alias("row"), source_key(F.col("source")).alias("skey"), permutation_hash(seed).alias("h")
    )
    copies = with_copies(carried, plan, blocks).select("row", "h", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed + 1), "h", "copy")
    part = F.col("shard") * spread + F.pmod("order", F.lit(spread)).cast("int")
    return (
        copies.withColumn("order", order)
        .repartitionById(n_shards * spread, part)
        .sortWithinPartitions("order")
        .select("row.*")
    )
