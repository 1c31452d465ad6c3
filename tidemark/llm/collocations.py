"""Phrase collocations: n-grams of whole texts counted by language, scored by their worst cut.

All 1- to ``max_words``-grams become rows (language, phrase, occurrences) and are added
up by language and phrase.  Candidates meet the counts of what each cut leaves on either
side, are scored in exact decimals, give way to one-word extensions that hold half of
their occurrences, and are ranked within their language.

Most n-grams are too rare to matter.  Passes ahead add up occurrences by hash alone and
note the hashes that reach ``least`` in a bitmap of fixed size: words first, then each
longer kind, of which only those are counted whose two parts, one word shorter, have their
bits set.  The last pass makes rows of the n-grams whose bit is set.  Every n-gram
that occurs ``least`` times has its bit set, whatever else shares it, as its parts occur as
often, so nothing is lost: a fuller bitmap only lets more rare ones through to the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import ship_by_value
from ._bytes import LOWER, SpanHash, buffers, kind_table, mix, pieces, runs
from ._spark import checkpointed, release, table

MAX_WORDS = 3
LEAST = 10
#: Per cent of a phrase's occurrences from which on an extension takes its place.
SHARE = 50
TOP = 2000
UNKNOWN = "und"
#: Bits of the bitmap, 16 MB, and of the hashes that are added up for it.
SIEVE_BITS = 1 << 27
HASH_BITS = 40
#: Words that a kernel gathers before it adds up what is alike.
BUFFER_WORDS = 1 << 19
#: Rows of a batch that a kernel hands back.
OUT_ROWS = 1 << 16
#: Parts of a language that are ranked apart before the last ranking.
PARTS = 64

#: Spaces and tabs part words; these marks and line ends part pieces, over which no phrase goes.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORD = kind_table(word=bytes(b for b in range(256) if b not in b" \t" + _BREAKS))
_BREAK = kind_table(mark=_BREAKS)


class Grams:
    """Words of some texts with a hash of every n-gram that stays within a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, max_words: int):
        """langs: a 64-bit hash of each text's language, which goes into the n-grams' hashes."""
        lower = LOWER[data]
        starts, ends, rows = runs(_WORD[lower], offsets)
        self.rows = rows
        broken = np.concatenate([[0], np.cumsum(_BREAK[lower], dtype=np.int64)])[starts]
        joined = (rows[1:] == rows[:-1]) & (broken[1:] == broken[:-1])
        # The words again, one space after each, so that every n-gram is one span.
        width = ends - starts + 1
        self.ends = np.cumsum(width)
        self.starts = self.ends - width
        at = np.arange(self.ends[-1] if len(width) else 0) + np.repeat(starts - self.starts, width)
        self.text = lower[np.minimum(at, max(len(lower) - 1, 0))]
        self.text[self.ends - 1] = 32
        word = SpanHash(self.text)(self.starts, self.ends - 1)
        #: For each length the first words of its n-grams, and their hashes.
        self.first: list[np.ndarray] = []
        self.hash: list[np.ndarray] = []
        whole, mixed = np.ones(len(word), bool), word
        for n in range(1, max_words + 1):
            if n > 1:
                if len(mixed) < 2:
                    whole, mixed = whole[:0], mixed[:0]
                else:
                    whole = whole[:-1] & joined[n - 2 :]
                    mixed = mix(mixed[:-1] * np.uint64(2 * n + 1) + word[n - 1 :])
            first = np.flatnonzero(whole)
            self.first.append(first)
            self.hash.append(mix(mixed[first] ^ langs[rows[first]]) >> np.uint64(64 - HASH_BITS))

    def phrases(self, n: int, first: np.ndarray) -> pa.Array:
        """The n-grams that begin at the given words, as binary values."""
        starts, ends = self.starts[first], self.ends[first + n - 1] - 1
        width = ends - starts
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(width, out=offsets[1:])
        at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], width)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(self.text[at])])


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, number of each row's language, hash of each row's language)."""
    coded = column.fill_null(UNKNOWN).dictionary_encode()
    names = coded.dictionary.to_pylist()
    data, offsets = buffers(coded.dictionary)
    hashes = SpanHash(data)(offsets[:-1], offsets[1:])
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return names, codes, hashes[codes] if len(codes) else np.zeros(0, np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[Grams, list[str], np.ndarray]]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        names, codes, hashes = _languages(batch.column("lang"))
        for a, b in pieces(offsets):
            yield Grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hashes[a:b], max_words), names, codes[a:b]


def _set(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each hash is set."""
    slot = hashes & np.uint64(bits - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _hash_counts(length: int, buffer_words: int, sieve: Broadcast | None, bits: int):
    """Kernel: (h, n) of the hashes of n-grams of this length, alike ones of a buffer added up.

    With ``sieve`` only n-grams take part whose first and last n - 1 words have their bits set.
    """

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        for a in range(0, len(h), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + OUT_ROWS].astype(np.int64)), pa.array(n[a : a + OUT_ROWS])], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sieve.value, np.uint64) if sieve is not None else None
        held: list[np.ndarray] = []
        size = 0
        for grams, _, _ in _texts(batches, length):
            hashes = grams.hash[-1]
            if bitmap is not None:
                often = np.zeros(len(grams.rows), bool)
                often[grams.first[-2]] = _set(bitmap, grams.hash[-2], bits)
                first = grams.first[-1]
                hashes = hashes[often[first] & often[np.minimum(first + 1, max(len(often) - 1, 0))]]
            held.append(hashes)
            size += len(hashes)
            if size >= buffer_words:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return run


def _phrase_counts(max_words: int, buffer_words: int, sieve: Broadcast, bits: int):
    """Kernel: (key, n) of n-grams whose bit is set, by phrase, tab and language; an empty phrase counts all words of a language."""

    def emit(held: list, totals: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for words in range(1, max_words + 1):
            some = [x for x in held if x[0] == words and len(x[1])]
            if not some:
                continue
            coded = pa.concat_arrays([x[1] for x in some]).dictionary_encode()
            names = sorted({name for x in some for name in x[3]})
            place = {name: i for i, name in enumerate(names)}
            lang = np.concatenate([np.array([place[name] for name in x[3]])[x[2]] for x in some])
            keys, n = np.unique(coded.indices.to_numpy() * np.int64(len(names)) + lang, return_counts=True)
            for a in range(0, len(keys), OUT_ROWS):
                part = keys[a : a + OUT_ROWS]
                phrase = coded.dictionary.take(pa.array(part // len(names))).cast(pa.binary()).cast(pa.string())
                key = pc.binary_join_element_wise(phrase, pa.array(names).take(pa.array(part % len(names))), "\t")
                yield pa.RecordBatch.from_arrays([key, pa.array(n[a : a + OUT_ROWS])], ["key", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(["\t" + name for name in totals], pa.string()), pa.array(list(totals.values()), pa.int64())], ["key", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sieve.value, np.uint64)
        held: list = []
        totals: dict[str, int] = {}
        words = 0
        for grams, names, codes in _texts(batches, max_words):
            for name, n in zip(names, np.bincount(codes[grams.rows], minlength=len(names)).tolist()):
                if n:
                    totals[name] = totals.get(name, 0) + n
            for k in range(max_words):
                first = grams.first[k][_set(bitmap, grams.hash[k], bits)]
                held.append((k + 1, grams.phrases(k + 1, first), codes[grams.rows[first]], names))
            words += len(grams.rows)
            if words >= buffer_words:
                yield from emit(held, totals)
                held, totals, words = [], {}, 0
        yield from emit(held, totals)

    return run


def sieve_of(docs: DataFrame, least: int, max_words: int, bits: int = SIEVE_BITS, buffer_words: int = BUFFER_WORDS) -> Broadcast:
    """Bitmap with a set bit for the hash of every n-gram that occurs ``least`` times; ``bits`` is a power of two.

    The driver gets its cells of 64 bits that aren't zero, ``bits`` / 64 at most.
    """
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = np.zeros(bits // 64, np.int64)
    sieve = None
    for length in range(1, max_words + 1):
        counts = docs.mapInArrow(_hash_counts(length, buffer_words, sieve, bits), "h long, n long")
        often = counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        got = often.groupBy(F.shiftright(slot, 6).cast("int").alias("cell")).agg(F.bit_or(bit).alias("set")).toArrow()
        bitmap[got.column("cell").to_numpy()] |= got.column("set").to_numpy()
        sieve = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
        del counts, often, got
        release(docs.sparkSession)
    return sieve


def phrase_counts(
    docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, bits: int = SIEVE_BITS, buffer_words: int = BUFFER_WORDS
) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to ``max_words`` words with ``least`` occurrences or more.

    A row of ``words`` 0 holds the count of all words of the language.
    """
    texts = docs.select("text", "lang")
    sieve = sieve_of(texts, least, max_words, bits, buffer_words)
    rows = texts.mapInArrow(_phrase_counts(max_words, buffer_words, sieve, bits), "key string, n long")
    counts = rows.groupBy("key").agg(F.sum("n").alias("f")).withColumn("phrase", F.substring_index("key", "\t", 1))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return counts.select(F.expr("substring(key, length(phrase) + 2)").alias("lang"), "phrase", words.alias("words"), "f").where(
        (F.col("words") == 0) | (F.col("f") >= least)
    )


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of each candidate at its lowest-scoring cut.

    Products are decimals of 38 digits, exact up to 1e16 occurrences of a phrase.
    """
    known = counts.select("lang", "phrase", "f")
    # A cut is its two parts, so that no phrase travels twice.
    cut = counts.where("words >= 2").select(
        "lang", "words", F.col("f").alias("a"), "phrase", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.select("lang", "words", "a", "k", "head", F.expr("substring(phrase, length(head) + 2)").alias("rest"))
    met = cut.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    ).select("lang", F.concat_ws(" ", "head", "rest").alias("phrase"), "words", "a", "k", "l", "r")
    exact = F.expr("(cast(1000000 as decimal(7, 0)) * (cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    least = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("least")
    return met.groupBy("lang", "phrase", "words", "a").agg(least).select(
        "lang", "phrase", "words", "a", "least.l", "least.r", "least.score"
    )


def unextended(candidates: DataFrame, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """The candidates that no longer phrase with ``share`` per cent of their occurrences holds.

    Phrases one word longer are enough: what lies between a candidate and a longer phrase
    occurs at least as often as the longer one.
    """
    inner = F.expr("array(substring(phrase, length(substring_index(phrase, ' ', 1)) + 2), substring_index(phrase, ' ', words - 1))")
    longer = counts.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "f")
    widest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    c, w = candidates.alias("c"), widest.alias("w")
    # In decimals, as 100 times a count may pass 64 bits.
    holds = F.expr(f"w.lang = c.lang AND w.phrase = c.phrase AND cast(w.longer as decimal(19, 0)) * 100 >= cast(c.a as decimal(19, 0)) * {int(share)}")
    return c.join(w, holds, "left_anti")


def ranked(candidates: DataFrame, top: int = TOP, parts: int = PARTS) -> DataFrame:
    """The first ``top`` of each language, with ``rank``.

    Each task's rows are of one of ``parts``, which are ranked first: what leaves a task, and
    what meets in the last ranking, is ``top`` rows of a language at most.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.spark_partition_id(), F.lit(parts))
    first = candidates.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    ).where(F.col("rank") <= top).drop("rank", "part")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, share: int = SHARE, top: int = TOP, bits: int = SIEVE_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best collocations of each language.

    Null texts are empty, a null language is ``und``; repeated rows count as often as they
    stand; texts without words and empty tables give no row; ties go to the more frequent
    phrase, then to the smaller in byte order.
    """
    counts = checkpointed(phrase_counts(docs, least, max_words, bits))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    best = ranked(unextended(scored(counts.where("words > 0")), counts), top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two to three words of each language of ``documents``.

    Edge cases are those of ``collocations``; columns beside text and lang are not read.
    """
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH p AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
e AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
o AS (
  SELECT lang, 1 AS words, w[i] AS phrase FROM e UNION ALL
  SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM e WHERE i + 1 <= len(w) UNION ALL
  SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM e WHERE i + 2 <= len(w)
), f AS (SELECT lang, words, phrase, count(*) AS f FROM o GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words >= 2 AND f >= {LEAST}),
k AS (SELECT lang, words, phrase, a, w, unnest(range(1, words)) AS k FROM c),
s AS (
  SELECT k.lang, k.words, k.phrase, k.a, k.k, l.f AS l, r.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') AND l.words = k.k
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ') AND r.words = k.words - k.k
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE words = 3 UNION ALL
  SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE words = 3
), d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.a >= {SHARE} * b.a)),
g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score FROM g JOIN t USING (lang) WHERE rank <= {TOP}
"""

ship_by_value(__name__)
