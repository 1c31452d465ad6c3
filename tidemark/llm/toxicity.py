"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of its hash and of its first 4, 6 and 8
bytes, so that unseen words share what their beginnings taught.  Filters of several
widths slide over the whole text, each filter keeps its greatest value, and one linear
layer gives the logit.  The net learns from all labelled rows, whose shards' nets are
averaged after each pass, but for a fifth of them.  All of that fifth calibrates one
threshold for each language, told by function words of the text itself; scores are
shifted so that this threshold lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from . import ship_by_value
from ._bytes import LOWER, WORD, SpanHash, buffers, pieces, runs
from ._mixed import learned
from ._spark import checkpointed, id_remainder, table
from .quality import training_rows

BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS = 12, 16, (1, 2, 3)
PAD = max(WIDTHS) - 1
PREFIXES = (4, 6, 8)
#: Labelled rows that are learned from one after the other, before nets are averaged.
SHARD_ROWS = 1 << 13
PASSES, BATCH, RATE = 6, 32, 0.08
#: Words whose feature maps are held at once while learning; a longer text is taken alone.
MAP_WORDS = 1 << 16

#: Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the and of to in that is with for",
    "de": "der die und das mit nicht den von auf",
    "fr": "le la les des et un une dans pour",
    "es": "el los las del que con por una para",
}


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, k) for k, line in enumerate(FUNCTION_WORDS.values()) for w in line.split()]
    data = np.frombuffer(" ".join(w for w, _ in words).encode(), np.uint8)
    starts, ends, _ = runs(WORD[data], np.array([0, len(data)]))
    hashes = SpanHash(data)(starts, ends)
    order = np.argsort(hashes)
    return hashes[order], np.array([k for _, k in words])[order]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed features of each word, row of each word, language of each row)."""
    starts, ends, rows = runs(WORD[data], offsets)
    n_rows, n_lang = len(offsets) - 1, len(FUNCTION_WORDS)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), rows, np.full(n_rows, n_lang)
    span = SpanHash(LOWER[data])
    word = span(starts, ends)
    columns = [word] + [span(starts, np.minimum(ends, starts + p)) * np.uint64(2 * p + 1) for p in PREFIXES]
    known, lang = _language_table()
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    hit = known[at] == word
    votes = np.bincount(rows[hit] * n_lang + lang[at[hit]], minlength=n_rows * n_lang).reshape(n_rows, n_lang)
    told = np.where(votes.max(1) > 0, votes.argmax(1), n_lang)
    return np.stack([(c >> np.uint64(13)) % np.uint64(BUCKETS) for c in columns], 1).astype(np.int32), rows, told


class Net:
    """Embeddings, filters and the output layer; the last embedding row is padding and stays zero."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = len(WIDTHS) * FILTERS
        self.emb = np.vstack([rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(f, np.float32)
        self.out = rng.normal(0, 0.3, f).astype(np.float32)
        self.shift = np.float32(-1.0)

    def maps(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(word vectors, feature maps of each width) of a padded row of words."""
        x = self.emb[ids].sum(1)
        maps = []
        for w, k in zip(WIDTHS, self.filters):
            m = x[: len(x) - PAD] @ k[0]
            for j in range(1, w):
                m += x[j : len(x) - PAD + j] @ k[j]
            maps.append(m)
        return x, maps

    def logits(self, ids: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Logit of each row; words are given in row order."""
        counts = np.bincount(rows, minlength=n_rows)
        padded, firsts = padding(ids, rows, counts)
        pooled = np.zeros((n_rows, len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(counts)
        if len(full):
            _, maps = self.maps(padded)
            edges = np.stack([firsts[full], firsts[full] + counts[full]], 1).ravel()
            for k, m in enumerate(maps):
                m = np.vstack([m, np.full((1, FILTERS), -np.inf, np.float32)])
                pooled[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(m, edges, axis=0)[::2]
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift


def padding(ids: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with ``PAD`` empty ones after each row, and where each row begins."""
    firsts = np.concatenate([[0], np.cumsum(counts + PAD)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    out = np.full((len(ids) + PAD * len(counts), ids.shape[1]), BUCKETS, np.int32)
    out[np.arange(len(ids)) + PAD * rows] = ids
    return out, firsts


def squares_of(net: Net) -> dict:
    """Adagrad's sums of squares before the first step."""
    like = lambda x: np.full(np.shape(x), 1e-3, np.float32)
    return {"emb": np.full(BUCKETS + 1, 1e-3, np.float32), "out": like(net.out), "bias": like(net.bias), "shift": like(net.shift),
            "filters": [like(k) for k in net.filters]}


def _small(net: Net, grad2: dict) -> list[np.ndarray]:
    return [*net.filters, net.bias, net.out, net.shift, *grad2["filters"], grad2["bias"], grad2["out"], grad2["shift"]]


def packed(net: Net, grad2: dict) -> np.ndarray:
    """Lines of floats: each embedding with its sum of squares, then all else, filled up with zeros."""
    rest = np.concatenate([np.ravel(x) for x in _small(net, grad2)])
    rest = np.concatenate([rest, np.zeros(-len(rest) % (DIM + 1))]).reshape(-1, DIM + 1)
    return np.vstack([np.hstack([net.emb, grad2["emb"][:, None]]), rest]).astype(np.float32)


def unpacked(state: np.ndarray) -> tuple[Net, dict]:
    net = Net()
    grad2 = squares_of(net)
    net.emb, grad2["emb"] = state[: BUCKETS + 1, :DIM].copy(), state[: BUCKETS + 1, DIM].copy()
    flat, parts, at = state[BUCKETS + 1 :].ravel(), [], 0
    for x in _small(net, grad2):
        parts.append(flat[at : at + np.size(x)].reshape(np.shape(x)).copy())
        at += np.size(x)
    n = len(WIDTHS)
    net.filters, (net.bias, net.out, net.shift) = parts[:n], parts[n : n + 3]
    grad2["filters"], (grad2["bias"], grad2["out"], grad2["shift"]) = parts[n + 3 : 2 * n + 3], parts[2 * n + 3 :]
    return net, grad2


def _pooled(net: Net, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(greatest value of each filter, and by width the words and the vectors where it was greatest)."""
    n, counts = len(docs), np.array([len(d) for d in docs])
    padded, firsts = padding(np.concatenate(docs), np.repeat(np.arange(n), counts), counts)
    x, maps = net.maps(padded)
    pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    ids, vectors = [], []
    for k, (w, m) in enumerate(zip(WIDTHS, maps)):
        where = np.zeros((n, FILTERS), np.int64)
        for r in np.flatnonzero(counts):
            part = m[firsts[r] : firsts[r] + counts[r]]
            top = part.argmax(0)
            where[r] = firsts[r] + top
            pooled[r, k * FILTERS : (k + 1) * FILTERS] = part[top, np.arange(FILTERS)]
        # Only those of a last text without words would lie beyond the end; their pull is zero.
        at = np.minimum(where[:, :, None] + np.arange(w), len(padded) - 1)
        ids.append(padded[at])
        vectors.append(x[at])
    return pooled, ids, vectors


def _step(net: Net, grad2: dict, docs: list[np.ndarray], y: np.ndarray, rate: float) -> None:
    """Adagrad on the log loss; the gradient of a pooled filter reaches the words where it was greatest."""
    n, counts = len(docs), np.array([len(d) for d in docs])
    group = (np.cumsum(counts) - counts) // MAP_WORDS
    parts = [_pooled(net, [docs[i] for i in np.flatnonzero(group == g)]) for g in np.unique(group)]
    pooled = np.concatenate([p for p, _, _ in parts])
    active = np.maximum(pooled + net.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.shift, -30, 30)))
    d = ((p - y) / n).astype(np.float32)
    d_out = d @ active
    d_pool = d[:, None] * net.out * (active > 0) * (counts > 0)[:, None]
    touched, pulls = [], []
    for k, w in enumerate(WIDTHS):
        g = d_pool[:, k * FILTERS : (k + 1) * FILTERS]
        ids, x = (np.concatenate([part[c][k] for part in parts]) for c in (1, 2))
        d_filter = np.einsum("nf,nfjd->jdf", g, x)
        touched.append(ids.reshape(-1, ids.shape[-1]))
        pulls.append(np.einsum("nf,jdf->nfjd", g, net.filters[k]).reshape(-1, DIM))
        grad2["filters"][k] += d_filter**2
        net.filters[k] -= rate * d_filter / np.sqrt(grad2["filters"][k])
    touched, pulls = np.concatenate(touched), np.concatenate(pulls)
    live = np.abs(pulls).sum(1) > 0
    ids = touched[live].ravel()
    if len(ids):
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        rows = ids[order][firsts]
        total = np.add.reduceat(np.repeat(pulls[live], touched.shape[1], axis=0)[order], firsts, axis=0)
        total[rows == BUCKETS] = 0
        grad2["emb"][rows] += (total**2).mean(1)
        net.emb[rows] -= rate * total / np.sqrt(grad2["emb"][rows])[:, None]
    for name, g in (("out", d_out), ("bias", d_pool.sum(0)), ("shift", d.sum())):
        grad2[name] = grad2[name] + g**2
        setattr(net, name, (getattr(net, name) - rate * g / np.sqrt(grad2[name])).astype(np.float32))


def _learn(state: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
    """One pass of Adagrad over a shard's rows, ``BATCH`` at a time."""
    net, grad2 = unpacked(state)
    rows = ((ids, label) for batch in batches for (ids, _), label in zip(token_rows(batch.column("text")), batch.column("label").to_pylist()))
    while some := list(islice(rows, BATCH)):
        _step(net, grad2, [ids for ids, _ in some], np.array([label for _, label in some]), RATE)
    state[:] = packed(net, grad2)


#: What a false alarm's rate weighs against that of a missed toxic text.
ALARM_WEIGHT = 3.0


def token_rows(text: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """(hashed features of its words, language) of each text."""
    data, offsets = buffers(text)
    for a, b in pieces(offsets):
        ids, rows, told = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield from zip(np.split(ids, np.searchsorted(rows, np.arange(1, b - a))), told.tolist())


def calibrated(rows: DataFrame, net: Net, alarm_weight: float = ALARM_WEIGHT, least: int = 15) -> np.ndarray:
    """A threshold for each language and for texts of none, from all ``rows`` (label, text).

    It is the cut of the least share of missed positives plus ``alarm_weight`` times that of false alarms, midway
    between its neighbours.  Fewer than ``least`` examples of a label fall back on all languages' threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, told = logits(batch.column("text"), net)
            yield pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), batch.column("label"), pa.array(s.astype(np.float64))], ["lang", "label", "s"])

    scored = checkpointed(rows.select("label", "text").mapInArrow(run, "lang int, label int, s double"))
    # Language -1 is all of them.
    scored = scored.select(F.explode(F.array("lang", F.lit(-1))).alias("lang"), F.col("label").cast("boolean").alias("label"), "s")
    cuts = {r["lang"]: r for r in ranks.least_cost_cuts(scored, "s", "label", "lang", alarm_weight).collect()}  # a row a language
    fits = lambda g, n: g in cuts and min(cuts[g]["p"], cuts[g]["q"]) >= n
    overall = cuts[-1]["cut"] if fits(-1, 1) else 0.0
    return np.array([cuts[g]["cut"] if fits(g, least) else overall for g in range(len(FUNCTION_WORDS) + 1)])


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, passes: int = PASSES) -> tuple[Net, np.ndarray]:
    """(net, thresholds) from all labelled rows; about every fifth, by hash, only calibrates, the others are learned from."""
    rows = training_rows(docs, labels, "toxic", shard_rows)
    calibrates = F.pmod(F.xxhash64("at"), F.lit(5)) == 0
    net = Net()
    net, _ = unpacked(learned(rows.where(~calibrates), packed(net, squares_of(net)), _learn, passes))
    return net, calibrated(rows.where(calibrates), net)


def logits(text: pa.Array, net: Net) -> tuple[np.ndarray, np.ndarray]:
    """(logit, language) of each text."""
    data, offsets = buffers(text)
    out, langs = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for a, b in pieces(offsets, 1 << 19):
        ids, rows, langs[a:b] = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out[a:b] = net.logits(ids, rows, b - a)
    return out, langs


def scores(text: pa.Array, net: Net, thresholds: np.ndarray) -> np.ndarray:
    out, langs = logits(text, net)
    return 1 / (1 + np.exp(-np.clip(out - thresholds[langs], -30, 30)))


def score_documents(docs: DataFrame, model: tuple[Net, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every document."""
    net, thresholds = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column("text"), net, thresholds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document.

    Null and empty texts have no word and are scored by the output layer's shift alone.
    Null ids are kept and count as held out; repeated rows score alike; an empty table gives
    an empty result, and without labels the untrained net scores.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


ship_by_value(__name__)
