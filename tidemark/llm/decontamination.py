"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact verification.

For every benchmark item, windows of as many words as the item has slide over each
document.  A window's 64-bit SimHash (word by word, from prefix sums of bit votes) is
looked up in a multi-index over the items' fingerprints: four 16-bit blocks, each
searched within 3 bits, which finds every item within ``RADIUS`` = 15 bits.  What is
found is verified by the exact weighted similarity of 5-word shingles, 0.8 or more.

A window without a single shingle of any item has similarity 0 whatever its
fingerprint, so only windows that hold at least one are fingerprinted.

A radius guarantees fingerprints, not similarities: of long items' windows at 0.8 a fifth
lies beyond 15 bits.  So the weight of the item's shingles that a window holds is summed
as well, which bounds its similarity from above, and windows that can reach 0.8 are
verified too.  With both nothing at 0.8 or more is lost, whatever an item's length.

Items travel to the executors in slices of at most ``SLICE_BYTES`` of text, one pass
each, so what is broadcast is bounded and every item is searched.  Weights follow the
whole benchmark: shingles that several items share are counted before it is sliced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship_by_value
from ._bytes import WORD, SpanHash, buffers, mix, pieces, runs
from ._spark import table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
SLICE_BYTES = 16 << 20
#: Relative error that sums of weights may have.
_SLACK = 1e-9
_BLOCKS, _BLOCK_BITS = 4, 16
_NEAR = np.array(
    [sum(1 << i for i in c) for k in range(RADIUS // _BLOCKS + 1) for c in combinations(range(_BLOCK_BITS), k)], np.int64
)
_STEP = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(SHINGLE)], np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    starts, ends, rows = runs(WORD[data], offsets)
    return SpanHash(data)(starts, ends), rows


def folded(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffers of the lower-cased texts, letters outside ASCII included."""
    return buffers(pc.utf8_lower(text))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += words[j : j + n] * _STEP[j]
    return mix(out)


def votes(words: np.ndarray) -> np.ndarray:
    """Prefix sums of the words' bit votes: row i holds the votes of the first i words."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, out=out[1:])
    return out


def simhash(prefix: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the windows of ``length`` words at ``starts``."""
    on = prefix[starts + length] - prefix[starts] > 0
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()


class Index:
    """Items with their shingles and the multi-index of their fingerprints.

    n_items and shared (width -> hash -> items, of those in several) are of the whole
    benchmark; without them, ``items`` are all there is.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], n_items: int | None = None, shared: dict[int, dict[int, int]] | None = None):
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        for item, text in dict.fromkeys(items):
            words, _ = words_of(*folded(pa.array([text], pa.string())))
            if len(words):
                self.ids.append(item)
                self.words.append(words)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.fps = np.array([simhash(votes(w), np.zeros(1, np.int64), len(w))[0] for w in self.words], np.uint64)
        self.n_items = len(self.ids) if n_items is None else n_items
        self.widths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.shared: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = np.minimum(self.lengths, SHINGLE)
        for width in np.unique(own).tolist():
            pairs = [(np.unique(shingle_hashes(self.words[i], width)), i) for i in np.flatnonzero(own == width)]
            hashes = np.concatenate([h for h, _ in pairs])
            items_ = np.concatenate([np.full(len(h), i) for h, i in pairs])
            order = np.argsort(hashes, kind="stable")
            keys, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
            bits = max(16, int(len(keys) * 16).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[(keys & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.widths[width] = (keys, np.append(first, len(order)), items_[order], seen)
            if shared is None:
                common, of = keys[count > 1], count[count > 1]
            else:
                known = sorted(shared.get(width, {}).items())
                common, of = np.array([k for k, _ in known], np.uint64), np.array([n for _, n in known], np.int64)
            self.shared[width] = (common, 1 + np.log(self.n_items / of))
        #: Weight of each item's shingles, as often as they stand.
        self.weights = np.array([self.weight(shingle_hashes(w, min(len(w), SHINGLE)), min(len(w), SHINGLE)).sum() for w in self.words])
        self.blocks = []
        for b in range(_BLOCKS):
            value = (self.fps >> np.uint64(b * _BLOCK_BITS)).astype(np.int64) & 0xFFFF
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.searchsorted(value[order], np.arange((1 << _BLOCK_BITS) + 1)), order))

    def weight(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Rarer shingles weigh more; one that no item has weighs like one of a single item."""
        keys, weights = self.shared[width]
        out = np.full(len(hashes), 1 + np.log(self.n_items))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            out = np.where(keys[at] == hashes, weights[at], out)
        return out

    def within(self, fps: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of every item of ``length`` words within the radius."""
        found = []
        for b, (starts, order) in enumerate(self.blocks):
            value = (fps >> np.uint64(b * _BLOCK_BITS)).astype(np.int64) & 0xFFFF
            key = value[:, None] ^ _NEAR[None, :]
            n = starts[key + 1] - starts[key]
            w, m = np.nonzero(n)
            reps, base = n[w, m], starts[key[w, m]]
            step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            found.append(np.stack([np.repeat(w, reps), order[np.repeat(base, reps) + step]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        w, i = pairs[:, 0], pairs[:, 1]
        good = (self.lengths[i] == length) & (np.bitwise_count(fps[w] ^ self.fps[i]) <= RADIUS)
        return w[good], i[good]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Twice the shared weight over the weight of both, shingles counted as often as they stand."""
        width = min(len(self.words[item]), SHINGLE)
        a, ca = np.unique(shingle_hashes(window, width), return_counts=True)
        b, cb = np.unique(shingle_hashes(self.words[item], width), return_counts=True)
        both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = (np.minimum(ca[ia], cb[ib]) * self.weight(both, width)).sum()
        total = (ca * self.weight(a, width)).sum() + (cb * self.weight(b, width)).sum()
        return float(2 * shared / total) if total else 0.0

    def hits(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each width: word positions whose shingle some item has, and the shingle's number."""
        out = []
        for width, (keys, _, _, seen) in self.widths.items():
            h = shingle_hashes(words, width)
            at = np.flatnonzero(seen[(h & np.uint64(len(seen) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            good = (keys[k] == h[at]) & (rows[at] == rows[at + width - 1])
            out.append((width, at[good], k[good]))
        return out

    def leaks(self, words: np.ndarray, hits: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, float]]:
        """(item, first word, similarity): the best window of each item found in one text."""
        n, prefix, best = len(words), None, {}
        for width, at, k in hits:
            _, starts, items, _ = self.widths[width]
            lengths: dict[int, list[np.ndarray]] = {}
            for p, s in zip(at.tolist(), k.tolist()):
                for length in set(self.lengths[items[starts[s] : starts[s + 1]]].tolist()):
                    lengths.setdefault(length, []).append(p)
            for length, places in lengths.items():
                size = min(length, n)  # a text shorter than the item is one window
                edge = np.zeros(n - size + 2, np.int32)
                p = np.array(places)
                np.add.at(edge, np.clip(p - (size - width), 0, n - size), 1)
                np.add.at(edge, np.minimum(p, n - size) + 1, -1)
                windows = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                prefix = votes(words) if prefix is None else prefix
                for a in range(0, len(windows), 512):
                    part = windows[a : a + 512]
                    for w, item in zip(*self.within(simhash(prefix, part, size), length)):
                        s = int(part[w])
                        sim = self.similarity(words[s : s + size], item)
                        if sim >= SIMILARITY and (item not in best or sim > best[item][1]):
                            best[item] = (s, sim)
            self._bounded(words, width, at, k, best)
        return [(i, s, sim) for i, (s, sim) in sorted(best.items())]

    def _bounded(self, words: np.ndarray, width: int, at: np.ndarray, k: np.ndarray, best: dict[int, tuple[int, float]]) -> None:
        """Adds to ``best`` what windows reach whose hits' weight lets them reach ``SIMILARITY``, beyond what it holds."""
        keys, starts, items, _ = self.widths[width]
        many = starts[k + 1] - starts[k]
        item = items[np.repeat(starts[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        place, gain = np.repeat(at, many), np.repeat(self.weight(keys[k], width), many)
        # A window weighs at least what it shares, so 2 h / (h + item) bounds its similarity.
        held = np.bincount(item, gain, minlength=len(self.weights))
        able = np.flatnonzero(held * (2 - SIMILARITY) >= SIMILARITY * self.weights * (1 - _SLACK))
        able = able[held[able] > 0]
        if not len(able):
            return
        n = len(words)
        whole = np.concatenate([[0.0], np.cumsum(self.weight(shingle_hashes(words, width), width))])
        for i in able.tolist():
            own = item == i
            size = min(int(self.lengths[i]), n)
            shared = np.zeros(n - width + 2)
            np.add.at(shared, place[own] + 1, gain[own])
            shared = np.cumsum(shared)
            first = np.arange(n - size + 1)
            last = first + size - width + 1
            bound = 2 * np.minimum(shared[last] - shared[first], self.weights[i]) / (whole[last] - whole[first] + self.weights[i])
            windows = np.flatnonzero(bound >= SIMILARITY * (1 - _SLACK))
            for s in windows[np.argsort(-bound[windows], kind="stable")].tolist():
                at_least = best[i][1] if i in best else SIMILARITY
                if bound[s] < at_least * (1 - _SLACK):
                    break
                sim = self.similarity(words[s : s + size], i)
                if sim >= SIMILARITY and (i not in best or sim > best[i][1] or sim == best[i][1] and s < best[i][0]):
                    best[i] = (s, sim)

    def search(self, text: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(row, leaks) of the rows that hold any."""
        data, offsets = folded(text)
        for a, b in pieces(offsets):
            words, rows = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            hits = self.hits(words, rows)
            edges = np.searchsorted(rows, np.arange(b - a + 1))
            for r in np.unique(np.concatenate([rows[at] for _, at, _ in hits])).tolist():
                lo, hi = edges[r], edges[r + 1]
                own = [(w, at[m] - lo, k[m]) for w, at, k in hits if (m := (at >= lo) & (at < hi)).any()]
                if found := self.leaks(words[lo:hi], own):
                    yield a + r, found


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, hash) of an item's distinct shingles, and (0, 0) once for the item; none without a word."""
    for batch in batches:
        for text in batch.column("text"):
            words, _ = words_of(*folded(pa.array([text.as_py()], pa.string())))
            if len(words):
                width = min(len(words), SHINGLE)
                hashes = np.append(np.unique(shingle_hashes(words, width)), np.uint64(0))
                widths = np.append(np.full(len(hashes) - 1, width, np.int32), np.int32(0))
                yield pa.RecordBatch.from_arrays([pa.array(widths), pa.array(hashes.view(np.int64))], ["width", "hash"])


def indexes(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> list[Index]:
    """One index for each slice of the benchmark's items; items without a word are left out.

    Only shingles that several items share are collected, for their weights.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // slice_bytes))
    n_items, shared = 0, {}
    counted = items.select("text").mapInArrow(_item_shingles, "width int, hash long").groupBy("width", "hash").agg(F.count(F.lit(1)).alias("n"))
    for r in counted.where("n > 1 or width = 0").collect():
        if r["width"]:
            shared.setdefault(r["width"], {})[r["hash"] % (1 << 64)] = r["n"]
        else:
            n_items = r["n"]
    sliced = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    out = []
    for k in range(n):
        rows = sliced.where(F.col("slice") == k).select("item_id", "text").orderBy("item_id", "text").collect()
        if (index := Index([(r["item_id"], r["text"]) for r in rows], n_items, shared)).ids:
            out.append(index)
    return out


def find_leaks(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) of each leaked item in each document.

    Null and empty texts and those without an item's shingle give no row; null ids are kept;
    repeated rows are answered as often as they stand; of windows alike the first is shown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for r, found in index.search(batch.column("text")):
                for item, first, sim in found:
                    rows.append(r)
                    out.append((index.ids[item], first, int(index.lengths[item]), sim))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
                ["doc_id", "item_id", "first_word", "n_words", "similarity"],
            )

    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds; clean documents have none.

    Of windows alike in similarity the first is shown.  Null and empty texts hold nothing;
    null ids are kept.  Repeated documents are reported as often as they stand, repeated
    items once.  An empty table of documents or items gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    parts = [find_leaks(docs, index) for index in indexes(table(spark, sf_dir, "benchmark"))]
    if not parts:
        return find_leaks(docs.limit(0), Index([(0, "none")]))
    return reduce(DataFrame.union, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are, whatever their names.

    Null and empty texts hold nothing and stay; so do repeated rows, each by itself.  An
    empty benchmark keeps all, an empty table stays empty.
    """
    for index in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _ in index.search(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ship_by_value(__name__)
