"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

A text's features are its lower-cased and its case-shaped words, its runs of marks, and
pairs of neighbours, hashed into ``BUCKETS`` weights; a feature's value is its share of
all features of the text.  The model is learned by FTRL-proximal updates from all
labelled rows, whose shards' states are averaged after each pass, and scores every
document as one sparse dot product per text, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship_by_value
from ._bytes import LOWER, WORD_OR_MARK, SpanHash, buffers, mix, pieces, runs
from ._mixed import learned, sharded
from ._spark import id_remainder, table

BUCKETS = 1 << 18
#: Labelled rows that are learned from one after the other, before states are averaged.
SHARD_ROWS = 1 << 14
PASSES = 3
KEEP_AT = 0.3
_SCALE = 20.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row of each) of all features of the texts, rows ascending within each of the parts."""
    starts, ends, rows = runs(WORD_OR_MARK[data], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), rows
    folded = SpanHash(LOWER[data])(starts, ends)
    upper = (data >= 65) & (data <= 90)
    caps = np.add.reduceat(np.concatenate([upper, [False]]).astype(np.int32), np.stack([starts, ends], 1).ravel())[::2]
    width = ends - starts
    # Word or marks, how much of it is capital, and its length class.
    shape = (WORD_OR_MARK[data[starts]].astype(np.uint64) * np.uint64(64)
             + np.minimum(caps * 4 // np.maximum(width, 1), 3).astype(np.uint64) * np.uint64(16)
             + np.minimum(width, 15).astype(np.uint64))
    shape = mix(shape + np.uint64(0x51ED))
    near = rows[1:] == rows[:-1]
    pair = mix(folded[:-1] * np.uint64(3) + folded[1:])[near]
    shapes = mix(shape[:-1] * np.uint64(5) + shape[1:])[near]
    marked = rows[1:][near]
    all_ = np.concatenate([folded, shape, pair, shapes])
    return (all_ % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([rows, rows, marked, marked])


def _weight(z: np.ndarray, n: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _update(z: np.ndarray, n: np.ndarray, k: np.ndarray, x: np.ndarray, label: int, alpha: float = 0.3, **rest: float) -> None:
    """One row's step of FTRL-proximal on the sums ``z`` and ``n``; the bias comes last."""
    k, x = np.append(k, BUCKETS), np.append(x, np.float32(1))
    own, squares = z[k], n[k]
    w = _weight(own, squares, alpha, **rest)
    g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
    z[k] = own + g - (np.sqrt(squares + g * g) - np.sqrt(squares)) / alpha * w
    n[k] = squares + g * g


def train(buckets: np.ndarray, values: np.ndarray, ends: np.ndarray, labels: list[int], passes: int = PASSES, seed: int = 5,
          **rates: float) -> tuple[np.ndarray, float]:
    """FTRL-proximal over rows ``ends[i]:ends[i + 1]`` of (bucket, value); (weights, bias)."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(labels)):
            _update(z, n, buckets[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]], labels[i], **rates)
    all_ = _weight(z, n, **rates)
    return all_[:BUCKETS], float(all_[BUCKETS])


def feature_rows(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text, a bucket once with its share of all features."""
    data, offsets = buffers(text)
    for a, b in pieces(offsets):
        k, rows = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        keys, counts = np.unique(rows * BUCKETS + k, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(1, b - a) * BUCKETS)
        total = np.maximum(np.bincount(rows, minlength=b - a), 1)
        shares = (counts * _SCALE / total[keys // BUCKETS]).astype(np.float32)
        yield from zip(np.split(keys % BUCKETS, cuts), np.split(shares, cuts))


def _learn(state: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
    """Follow the leader over one shard's rows; ``state`` holds z and n of each bucket and of the bias."""
    z, n = np.ascontiguousarray(state[:, 0]), np.ascontiguousarray(state[:, 1])
    for batch in batches:
        for (k, x), label in zip(feature_rows(batch.column("text")), batch.column("label").to_pylist()):
            _update(z, n, k, x, label)
    state[:, 0], state[:, 1] = z, n


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """(__id, __label) of labelled ids outside the held-out fold; one labelled more than once counts once, with its largest label."""
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max(label).cast("int").alias("__label"))
    )


def training_rows(docs: DataFrame, labels: DataFrame, label: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, at, label, text) of all rows with labelled ids outside the held-out fold, of any length.

    An id labelled more than once counts once, with its largest label.
    """
    return sharded(docs, labelled_ids(labels, label), shard_rows)


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(weights, bias) from all labelled rows; without any the model scores every text by its bias, 0.5."""
    rows = training_rows(docs, labels, "quality", shard_rows)
    state = learned(rows, np.zeros((BUCKETS + 1, 2)), _learn, passes)
    all_ = _weight(state[:, 0], state[:, 1])
    return all_[:BUCKETS], float(all_[BUCKETS])


def scores(text: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Score of each text; an empty one is scored by the bias alone."""
    data, offsets = buffers(text)
    out = np.zeros(len(offsets) - 1)
    for a, b in pieces(offsets):
        k, rows = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        dots = np.bincount(rows, weights=weights[k], minlength=b - a)
        out[a:b] = dots * _SCALE / np.maximum(np.bincount(rows, minlength=b - a), 1)
    return 1.0 / (1.0 + np.exp(-np.clip(out + bias, -30, 30)))


def _sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(weights)
    return at.astype(np.int32), weights[at].astype(np.float32)


def _dense(model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    weights = np.zeros(BUCKETS)
    weights[model[0]] = model[1]
    return weights


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every document."""
    packed, bias = _sparse(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _dense(packed)
        for batch in batches:
            s = scores(batch.column("text"), weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: tuple[np.ndarray, float], keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that score at least ``keep_at``, all columns as they are, whatever their names.

    Null and empty texts are scored by the bias; repeated rows stay or go together.
    """
    packed, bias = _sparse(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _dense(packed)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text"), weights, bias) >= keep_at))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; predicted is 1 from a score of 0.3 on.

    Null texts count as empty; null ids are kept and count as held out; repeated rows score
    alike; an empty table gives an empty result, and without labels every score is 0.5.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"),
    )


ship_by_value(__name__)
