"""Learning from all labelled rows, wherever they lie, by parameter mixing.

Rows are dealt over shards by hash.  In a pass each shard learns from its rows one after
the other, from the state that the pass before left; then every line of the state
becomes the mean over the shards that changed it.  The shards' number follows the rows, so no task
holds more as tables grow, and only one state ever reaches the driver.  Changes are summed as
whole numbers, so that a state does not hang on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship_by_value
from ._spark import checkpointed, release, sent

#: What a change of one is summed as.
_ONE = float(1 << 30)

Learn = Callable[[np.ndarray, Iterator[pa.RecordBatch]], None]


def sharded(docs: DataFrame, ids: DataFrame, shard_rows: int) -> DataFrame:
    """(shard, at, label, text) of all rows of ``docs`` that ``ids`` (__id, __label) names, a shard in one task.

    ``at`` is a hash of id and text and gives the shard, of about ``shard_rows`` rows.
    """
    few = ids.count()
    own = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    n = own.select("__doc").join(sent(ids, few), F.col("__doc") == F.col("__id")).count()
    shards = max(1, -(-n // shard_rows))
    at = F.xxhash64("__id", F.coalesce("text", F.lit("")))
    rows = own.join(sent(ids, few), F.col("__doc") == F.col("__id")).select(
        F.pmod(at, F.lit(shards)).cast("int").alias("shard"), at.alias("at"), F.col("__label").alias("label"), "text"
    )
    return checkpointed(rows.repartitionById(shards, "shard"))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    def slices() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield int(shard[a]), batch.slice(a, b - a)

    for shard, own in groupby(slices(), key=itemgetter(0)):
        yield shard, (batch for _, batch in own)


def learned(rows: DataFrame, state: np.ndarray, learn: Learn, passes: int) -> np.ndarray:
    """``state`` (lines of numbers, whose type stays) after ``passes`` over the ``rows`` of ``sharded``, in another order of hashes each.

    ``learn`` takes a state, which it changes in place, and the batches of one shard.
    """
    columns = [f"d{k}" for k in range(state.shape[1])]
    for n in range(passes):
        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = state) -> Iterator[pa.RecordBatch]:
            for _, own in _by_shard(batches):
                new = start.copy()
                learn(new, own)
                line = np.flatnonzero((new != start).any(1))
                change = np.rint((new[line] - start[line]).astype(np.float64) * _ONE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(line), *map(pa.array, change.T)], ["line", *columns])

        ordered = rows.sortWithinPartitions("shard", F.xxhash64("at", F.lit(n)), "at")
        changes = ordered.mapInArrow(run, "line long, " + ", ".join(f"{c} long" for c in columns))
        # A row for each line of the state.
        got = changes.groupBy("line").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()
        state = state.copy()
        if got.num_rows:
            total = np.stack([got.column(c).to_numpy() for c in columns], 1)
            state[got.column("line").to_numpy()] += total / _ONE / got.column("n").to_numpy()[:, None]
        release(rows.sparkSession)
    return state


ship_by_value(__name__)
