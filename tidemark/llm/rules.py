"""Quality rules: statistics of each whole text, two fixed rules, and an isolation forest on the rest.

A text's statistics are counts that one Arrow kernel takes over its words and lines.
Texts of few words, or mostly of repeated windows, fail at once.  The others are judged by
an isolation forest on the statistics as shares: each tree splits a small sample at
random places, and a text that few splits set apart from the rest is odd.  The forest and
its threshold come from all labelled rows, but for the trees' own samples; every document is
judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship_by_value
from ._bytes import buffers, kind_table, pieces, runs
from ..operators import ranks
from ._spark import checkpointed, id_remainder, table
from .quality import labelled_ids

LEAST_WORDS = 50
#: Per cent of words in repeated windows beyond which a text fails.
MOST_REPEATED = 50
WINDOW = 3
TREES, SAMPLE, DEPTH = 100, 1024, 14
#: Shares below this are much alike.
LEAST_SHARE = 0.01
#: The share of good labelled rows that the threshold may give up.
GIVEN_UP = 0.001

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_same")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
FEATURES = ("word length", "symbols", "equal lines", "repeated windows", "capitals", "digits", "marks", "word said again")

_WORD = kind_table(word=bytes(b for b in range(256) if b != 32 and not 9 <= b <= 13))
_SYMBOL = kind_table(mark=b"#*$%&|<>").astype(bool)
_UPPER, _LETTER, _DIGIT = np.zeros((3, 256), bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_MARK = kind_table(mark=b"!?").astype(bool)


def _ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """(a number for each span, alike for equal bytes only; how many numbers)."""
    width = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(width, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], width)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def _pairs(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, int]:
    """(a number for each pair of numbers, alike for equal pairs only; how many)."""
    known, number = np.unique(a * n_b + b, return_inverse=True)
    return number, len(known)


def _counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``COUNTS`` for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    starts, ends, rows = runs(_WORD[data], offsets)
    if not len(starts):
        return out
    per_row = lambda marked, of: np.bincount(of[marked], minlength=n)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    out[:, 0] = np.bincount(rows, minlength=n)
    out[:, 1] = per_row((_WORD[data] != 0) & (data & 0xC0 != 0x80), row_of)
    out[:, 2] = per_row(_SYMBOL[data], row_of)

    # Lines that hold a word: between line ends and borders of texts.
    borders = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    line = np.unique(np.searchsorted(borders, starts, side="right") - 1)
    line_row = np.searchsorted(offsets, borders[line], side="right") - 1
    number, kinds = _ids(data, borders[line], borders[line + 1])
    lines = np.bincount(line_row, minlength=n)
    different = np.unique(line_row * np.int64(kinds) + number)
    out[:, 5] = lines
    out[:, 3] = lines - np.bincount(different // kinds, minlength=n)

    number, kinds = _ids(data, starts, ends)
    same = (rows[1:] == rows[:-1]) & (number[1:] == number[:-1])
    out[:, 10] = np.bincount(rows[1:][same], minlength=n)
    if len(number) >= WINDOW:
        window, many = number[: len(number) - WINDOW + 1], kinds
        for k in range(1, WINDOW):
            window, many = _pairs(window, number[k : len(number) - WINDOW + 1 + k], kinds)
        inside = rows[: len(window)] == rows[WINDOW - 1 :]
        first = np.flatnonzero(inside)
        _, which, times = np.unique(rows[first] * np.int64(many) + window[first], return_inverse=True, return_counts=True)
        twice = first[times[which] > 1]
        cover = np.zeros(len(number) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.subtract.at(cover, twice + WINDOW, 1)
        out[:, 4] = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    for column, kind in ((6, _UPPER), (7, _LETTER), (8, _DIGIT), (9, _MARK)):
        out[:, column] = per_row(kind[data], row_of)
    return out


def counts(text: pa.Array) -> np.ndarray:
    """``COUNTS`` of each text; a null or empty one has zeros."""
    data, offsets = buffers(text)
    parts = [_counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)


def shares(n: np.ndarray) -> np.ndarray:
    """``FEATURES`` of each row of ``COUNTS``: logarithms of shares, so that a text's length isn't odd in itself."""
    c = dict(zip(COUNTS, n.T.astype(float)))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    parts = np.stack([
        chars / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_digits"] / chars, c["n_marks"] / words, c["n_same"] / words,
    ], 1)
    return np.log(parts + LEAST_SHARE).astype(np.float32)


def base_failed(n: np.ndarray) -> np.ndarray:
    return (n[:, 0] < LEAST_WORDS) | (100 * n[:, 4] > MOST_REPEATED * n[:, 0])


class Forest(NamedTuple):
    """Trees as arrays: (tree, node) -> feature, place of the split, children, and path length at a leaf."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    length: np.ndarray
    depth: int
    usual: float
    threshold: float


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, seed: int = 12) -> Forest:
    """A forest over samples of the rows of ``x``.

    A split lies anywhere in a node's part of the ``box``, not only between the node's own
    rows: what none of the sample looks like soon falls where no row is.
    """
    rng = np.random.default_rng(seed)
    take = min(len(x), sample)
    grown = []
    for _ in range(trees):
        feature, at, left, length = [-1], [0.0], [0], [0.0]
        open_ = [(0, rng.choice(len(x), take, replace=False) if take else np.zeros(0, int), 0, *box)]
        while open_:
            node, rows, level, low, high = open_.pop()
            wide = np.flatnonzero(high > low)
            if level == depth or len(rows) <= 1 or not len(wide):
                length[node] = level + _usual_path(len(rows))
                continue
            f = int(rng.choice(wide))
            feature[node], at[node], left[node] = f, rng.uniform(low[f], high[f]), len(feature)
            below = x[rows, f] < at[node]
            under, over = high.copy(), low.copy()
            under[f] = over[f] = at[node]
            open_ += [(len(feature), rows[below], level + 1, low, under), (len(feature) + 1, rows[~below], level + 1, over, high)]
            for column, empty in ((feature, -1), (at, 0.0), (left, 0), (length, 0.0)):
                column += [empty, empty]
        grown.append((feature, at, left, length))
    size = max((len(g[0]) for g in grown), default=1)
    columns = [np.array([c + [0] * (size - len(c)) for c in column], kind) for column, kind in zip(zip(*grown), (np.int8, np.float32, np.int32, np.float32))]
    return Forest(*columns, depth, max(_usual_path(take), 1e-9), np.inf)


def oddness(forest: Forest, x: np.ndarray, block: int = 4096) -> np.ndarray:
    """2 ** -(mean path length / usual one) of each row: towards 1 for what few splits set apart."""
    out = np.zeros(len(x))
    tree = np.arange(len(forest.feature))[None, :]
    for a in range(0, len(x), block):
        part = x[a : a + block]
        row = np.arange(len(part))[:, None]
        node = np.zeros((len(part), len(forest.feature)), np.int32)
        for _ in range(forest.depth):
            f = forest.feature[tree, node]
            onward = forest.left[tree, node] + (part[row, np.maximum(f, 0)] >= forest.at[tree, node])
            node = np.where(f >= 0, onward, node)
        out[a : a + block] = 2.0 ** (-forest.length[tree, node].mean(1) / forest.usual)
    return out


def reach(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The box that holds all rows."""
    return (x.min(0), x.max(0)) if len(x) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))


def calibrated(forest: Forest, x: np.ndarray, odd: np.ndarray, given_up: float = GIVEN_UP) -> Forest:
    """The forest with the lowest threshold that gives up at most ``given_up`` of the rows not ``odd``.

    It lies midway to the next higher row that is odd; without labelled rows nothing is dropped.
    """
    s = oddness(forest, x)
    good, bad = np.sort(s[~odd]), np.sort(s[odd])
    if not len(good) or not len(bad):
        return forest
    lowest = good[len(good) - 1 - int(len(good) * given_up)]
    above = bad[bad > lowest]
    return forest._replace(threshold=float((lowest + above[0]) / 2) if len(above) else np.inf)


_SHARES = [f"f{k}" for k in range(len(FEATURES))]


def _share_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shares) of the rows that pass the fixed rules."""
    for batch in batches:
        n = counts(batch.column("text"))
        passed = ~base_failed(n)
        yield pa.RecordBatch.from_arrays([batch.column("__id").filter(pa.array(passed)), *map(pa.array, shares(n[passed]).T)], ["__id", *_SHARES])


def labelled_shares(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, odd, shares) of all labelled rows outside the held-out fold that pass the fixed rules; no text is shuffled."""
    own = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").mapInArrow(_share_rows, "__id long, " + ", ".join(f"{c} float" for c in _SHARES))
    return checkpointed(own.join(labelled_ids(labels, "quality"), "__id").select("__id", (F.col("__label") == 0).alias("odd"), *_SHARES))


def threshold(rows: DataFrame, forest: Forest, given_up: float = GIVEN_UP) -> float:
    """``calibrated``'s threshold, from all rows (odd, shares); their scores are ranked by ranges, only two of them are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = oddness(forest, np.stack([batch.column(c).to_numpy() for c in _SHARES], 1))
            yield pa.RecordBatch.from_arrays([batch.column("odd"), pa.array(s)], ["odd", "s"])

    scored = checkpointed(rows.select("odd", *_SHARES).mapInArrow(run, "odd boolean, s double"))
    placed, total = ranks.numbered(scored.where("not odd"), ["s"])
    n = total.first()["total"]
    if not n:
        return np.inf
    lowest = placed.where(F.col("rn") == n - int(n * given_up)).first()["s"]
    above = scored.where(F.col("odd") & (F.col("s") > lowest)).agg(F.min("s")).first()[0]
    return np.inf if above is None else (lowest + above) / 2


def fit(docs: DataFrame, labels: DataFrame, pool: int = TREES * SAMPLE) -> Forest:
    """Box and threshold of all labelled rows that pass the fixed rules, outside the held-out fold.

    Each tree of an isolation forest is grown on a small sample by its method; the samples are drawn from ``pool`` good
    rows in hash order, as many as all trees together take.
    """
    rows = labelled_shares(docs, labels)
    ends = rows.agg(*[F.min(c).alias(f"lo_{c}") for c in _SHARES], *[F.max(c).alias(f"hi_{c}") for c in _SHARES]).first()
    box = tuple(np.array([ends[f"{side}_{c}"] or 0.0 for c in _SHARES], np.float32) for side in ("lo", "hi"))
    got = rows.where("not odd").orderBy(F.xxhash64("__id"), "__id", *_SHARES).limit(pool).select(*_SHARES).toArrow()
    forest = grow(np.stack([got.column(c).to_numpy() for c in _SHARES], 1), box)
    return forest._replace(threshold=float(threshold(rows, forest)))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, counts, base_failed, oddness, kept) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counts(batch.column("text"))
            failed, s = base_failed(n), oddness(forest, shares(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, n.T), pa.array(failed), pa.array(s), pa.array(~failed & (s < forest.threshold))],
                ["doc_id", *COUNTS, "base_failed", "oddness", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, {SCHEMA}, base_failed boolean, oddness double, kept boolean"
    )


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fixed rules and the forest's verdict of every document.

    Null and empty texts have zeros and fail; null ids are kept and are held out; repeated rows are judged
    alike; an empty table gives an empty result; without labels of both kinds only the fixed
    rules drop.  Columns beside doc_id and text are not read.
    """
    docs = table(spark, sf_dir, "documents")
    forest = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, forest).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "oddness",
        F.coalesce(id_remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
    )


ship_by_value(__name__)
