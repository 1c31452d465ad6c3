"""Cross-tokenizer alignment: two tokenizers' tokens over the same bytes, their groups and links.

Texts are encoded once, whole, and the ids written as a table.  Every further step reads
that table: an interval index over the second tokenizer's token ends answers, by
bisection, which of its tokens each token of the first overlaps.  Where both end at one
byte nothing spans the place, and a group ends.

Encoding works on different stretches of text, which are cut at single spaces between
visible characters.  Neither tokenizer joins anything over such a place (``_cuttable``
looks at both; otherwise whole texts are encoded), so the ids are those of the whole text.

How many documents hold a pair of ids linked is added up over the corpus and comes back as
a broadcast table, in slices of at most ``SLICE`` pairs: one for the usual vocabularies.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ship_by_value
from ._bytes import buffers, pieces
from ._spark import table, written

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded, and A tokens that are aligned, at a time.
ENCODE_BYTES, ALIGN_TOKENS = 1 << 20, 1 << 18
#: Stretches of text whose ids a task remembers, and those that it encodes at a time.
KNOWN, LOT = 1 << 19, 1 << 14
#: Pairs of a broadcast slice, 17 bytes each.
SLICE = 1 << 22
#: Pairs that a task gathers before it adds up what is alike.
GATHERED = 1 << 21

#: Fixed value: how byte-level tokenizers of this kind part a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
#: First byte of Latin letters with accents, which are never white space.
_LATIN = 0xC3


def byte_of_character() -> dict[str, int]:
    """The usual byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary(NamedTuple):
    """Bytes of each id in one buffer, and their lengths."""

    data: np.ndarray
    starts: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        width = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(width) - width, width)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_spread(self.starts[ids], self.width[ids])]


def _spread(starts: np.ndarray, width: np.ndarray) -> np.ndarray:
    """start, start + 1, ... ``width`` places for each of the spans."""
    ends = np.cumsum(width)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - width), width)


def vocabulary_a(definition: str) -> Vocabulary:
    """Token bytes of a byte-level tokenizer; ids that don't exist have none."""
    parsed = json.loads(definition)
    names = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
    plain, out = byte_of_character(), [b""] * (max(names.values()) + 1)
    for name, k in names.items():
        out[k] = bytes(plain[c] for c in name) if all(c in plain for c in name) else name.encode()
    return Vocabulary.of(out)


def vocabulary_b(model: bytes) -> Vocabulary:
    """Token bytes of a sentence-piece model: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    return Vocabulary.of([
        bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in range(n)
    ])


def _cuttable(definition: str, model: bytes) -> bool:
    """Whether ids of stretches, cut at single spaces between visible characters, are those of the whole text."""
    import sentencepiece

    parsed = json.loads(definition)
    before = parsed.get("pre_tokenizer") or {}
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    inside = any("▁" in sp.id_to_piece(k).lstrip("▁") for k in range(sp.get_piece_size()))
    return parsed.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex", True)) and not inside


def ranks(definition: str) -> dict[bytes, int] | None:
    """Token bytes and ids of plain byte-level BPE whose ids follow the order of its merges; None for any other."""
    parsed = json.loads(definition)
    model, before = parsed["model"], parsed.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    unusual = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if not plain or parsed.get("normalizer") is not None or any(model.get(k) for k in unusual):
        return None
    special, byte = {t["id"] for t in parsed["added_tokens"]}, byte_of_character()
    names = {name: k for name, k in model["vocab"].items() if k not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(names) != 256 + len(merges) or any(names.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    return {bytes(byte[c] for c in name): k for name, k in names.items()}


def encoder_a(definition: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids without special tokens.  Where ids are merge ranks, an engine that works on ranks gives the same, several times faster."""
    ranked = ranks(definition)
    if ranked is not None:
        import tiktoken

        encoding = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranked, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class _Encoder:
    """Ids of both tokenizers for stretches of text, those seen before from memory."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece

        self.a = encoder_a(definition)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.words = vocabulary_a(definition), vocabulary_b(model)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.width = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.whole = np.zeros(0, bool)

    def _learn(self, new: pa.Array) -> None:
        if len(new) > LOT:
            for first in range(0, len(new), LOT):
                self._learn(new.slice(first, LOT))
            return
        texts = new.to_pylist()
        spaced = [" " + t for t in texts]
        lists = self.a(spaced), self.b.encode(texts, num_threads=1)
        data, offsets = buffers(pa.array(spaced, pa.large_string()))
        whole = np.ones(len(texts), bool)
        for k, ids in enumerate(lists):
            width = np.array([len(x) for x in ids], np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(width.sum()))
            ends = np.concatenate([[0], np.cumsum(width)])
            sizes = np.concatenate([[0], np.cumsum(self.words[k].width[flat])])[ends]
            sized = np.diff(sizes) == np.diff(offsets)
            # The bytes of those whose length fits are compared at once.
            keep = np.repeat(sized, width)
            same = self.words[k].joined(flat[keep]) == data[np.repeat(sized, np.diff(offsets))]
            bad = np.repeat(np.flatnonzero(sized), np.diff(offsets)[sized])[~same]
            whole &= sized
            whole[bad] = False
            self.ids[k], self.width[k] = np.concatenate([self.ids[k], flat]), np.concatenate([self.width[k], width])
        self.whole = np.concatenate([self.whole, whole])
        self.known = pa.concat_arrays([self.known, new])

    def __call__(self, different: pa.Array) -> tuple[np.ndarray, list]:
        """(place of each stretch among the known, [(ids, starts, width)] of both, whole) after learning new ones."""
        if len(self.known) > KNOWN:
            self._forget()
        at = pc.index_in(different, value_set=self.known)
        if at.null_count:
            self._learn(different.filter(pc.is_null(at)))
            at = pc.index_in(different, value_set=self.known)
        return at.to_numpy(), [(i, np.cumsum(w, dtype=np.int64) - w, w) for i, w in zip(self.ids, self.width)], self.whole


def _stretches(data: np.ndarray, offsets: np.ndarray, cut: bool) -> tuple[pa.Array, np.ndarray]:
    """(each stretch of the texts without the space before it, row of each); empty texts have none."""
    if cut and len(data) > 2:
        plain = _PLAIN[data]
        before, after = plain.copy(), plain | (data == _LATIN)
        before[1:] |= data[:-1] == _LATIN
        spaces = np.flatnonzero((data[1:-1] == 32) & before[:-2] & after[2:]) + 1
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        # A space that opens or closes a text stays within it.
        spaces = spaces[~border[spaces] & ~border[spaces + 1]]
        starts = np.concatenate([offsets[:-1][np.diff(offsets) > 0], spaces + 1])
        ends = np.concatenate([spaces, offsets[1:][np.diff(offsets) > 0]])
        starts.sort(), ends.sort()
    else:
        some = np.diff(offsets) > 0
        starts, ends = offsets[:-1][some], offsets[1:][some]
    width = ends - starts
    places = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    held = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[_spread(starts, width)])))
    return held, np.searchsorted(offsets, starts, side="right") - 1


def _packed_ids(ids: np.ndarray, counts: np.ndarray, kind: type) -> pa.Array:
    """Ids of each row as one binary value."""
    size = np.dtype(kind).itemsize
    offsets = (np.concatenate([[0], np.cumsum(counts)]) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids.astype(kind)))])


def _encode(definition: Broadcast, model: Broadcast, cut: bool, kinds: tuple[type, type]):
    """Kernel: (doc_id, a, b) with the ids of both tokenizers; none if either changes the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Encoder(definition.value, model.value)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for first, last in pieces(offsets, ENCODE_BYTES):
                n = last - first
                held, rows = _stretches(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], cut)
                coded = held.dictionary_encode()
                place, ids, whole = encode(coded.dictionary)
                each = place[coded.indices.to_numpy()] if len(held) else np.zeros(0, np.int64)
                good = np.bincount(rows[~whole[each]], minlength=n) == 0
                each, rows = each[good[rows]], rows[good[rows]]
                columns = []
                for (flat, starts, width), kind in zip(ids, kinds):
                    counts = np.bincount(rows, weights=width[each], minlength=n).astype(np.int64)
                    columns.append(_packed_ids(flat[_spread(starts[each], width[each])], counts, kind))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), *columns], ["doc_id", "a", "b"])

    return run


class Aligned(NamedTuple):
    """Tokens of some rows side by side: ids, rows, group ends, and for each A token its B tokens [lo, hi)."""

    ids: tuple[np.ndarray, np.ndarray]
    rows: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    lo: np.ndarray
    hi: np.ndarray


def align(ids: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], width: tuple[np.ndarray, np.ndarray]) -> Aligned:
    """Both tokenizers' tokens of rows with equal bytes; ``width`` gives an id's bytes, ``counts`` a row's tokens."""
    end_a, end_b = (np.cumsum(w[i]) for w, i in zip(width, ids))
    lo = np.searchsorted(end_b, end_a - width[0][ids[0]], side="right")
    last = np.searchsorted(end_b, end_a, side="left")
    closes = end_b[last] == end_a
    closed = np.zeros(len(end_b), bool)
    closed[last[closes]] = True
    rows = tuple(np.repeat(np.arange(len(c)), c) for c in counts)
    return Aligned(ids, rows, (closes, closed), lo, last + 1)


def _aligned(batch: pa.RecordBatch, kinds: tuple[type, type], width: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, Aligned]]:
    """(first row, rows, alignment) of parts of a batch of encoded rows."""
    flat, starts = [], []
    for name, kind in zip("ab", kinds):
        column = batch.column(name).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        flat.append(raw.view(kind))
        starts.append((ends - ends[0]) // np.dtype(kind).itemsize)
    for first, last in pieces(starts[0], ALIGN_TOKENS):
        ids = tuple(f[s[first] : s[last]].astype(np.int64) for f, s in zip(flat, starts))
        yield first, last - first, align(ids, tuple(np.diff(s[first : last + 1]) for s in starts), width)


def _links(x: Aligned, n_b: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, row, times) of every pair of ids linked within a row, by pair and then row."""
    many = x.hi - x.lo
    pairs = np.repeat(x.ids[0] * n_b, many) + x.ids[1][_spread(x.lo, many)]
    if len(pairs) and int(pairs.max()) >= 2**62 // rows:
        raise OverflowError("pair and row don't fit 62 bits")
    keys = pairs * rows + np.repeat(x.rows[0], many)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first] // rows, keys[first] % rows, np.diff(np.append(first, len(keys)))


def _pair_counts(kinds: tuple[type, type], width: tuple[np.ndarray, np.ndarray]):
    """Kernel: (pair, n) with the number of rows that hold the pair linked."""
    n_b = len(width[1])

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        return pairs[first], np.add.reduceat(counts, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, n, x in _aligned(batch, kinds, width):
                pairs, _, _ = _links(x, n_b, n)
                if len(pairs):
                    parts.append(added([(pairs, np.ones(len(pairs), np.int64))]))
                    size += len(parts[-1][0])
                if size > GATHERED:
                    parts = [added(parts)]
                    size = len(parts[0][0])
                    if size > GATHERED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0]), pa.array(parts[0][1])], ["pair", "n"])
                        parts, size = [], 0
        if parts:
            pairs, counts = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    return run


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits of 0 to n-1 as bytes with room for a mark, their number)."""
    texts = [str(k).encode() for k in range(n)]
    size = len(texts[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(size) for t in texts), np.uint8).reshape(n, size), np.array([len(t) for t in texts])


def group_texts(x: Aligned, rows: int, digits: tuple[np.ndarray, np.ndarray]) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` of each row: the groups' A ids, then their B ids."""
    n_a, n_b = len(x.ids[0]), len(x.ids[1])
    group = [np.cumsum(e) - e for e in x.ends]
    end_a, end_b = (np.flatnonzero(e) + 1 for e in x.ends)
    start_b = np.concatenate([[0], end_b[:-1]]) if len(end_b) else end_b
    order = np.empty(n_a + n_b, np.int64)
    order[np.arange(n_a) + start_b[group[0]]] = x.ids[0]
    order[np.arange(n_b) + end_a[group[1]]] = x.ids[1]
    mark = np.empty(n_a + n_b, np.uint8)
    mark[np.arange(n_a) + start_b[group[0]]] = np.where(x.ends[0], ord("|"), ord(","))
    mark[np.arange(n_b) + end_a[group[1]]] = np.where(x.ends[1], ord(";"), ord(","))
    text, size = digits[0][order], digits[1][order]
    text[np.arange(len(order)), size] = mark
    flat = text[np.arange(text.shape[1]) <= size[:, None]]
    tokens = sum(np.bincount(r, minlength=rows) for r in x.rows)
    ends = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(tokens)])]
    whole = memoryview(flat)
    return [whole[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _digests(kinds: tuple[type, type], width: tuple[np.ndarray, np.ndarray], known: Broadcast, with_groups: bool):
    """Kernel: the columns of op11 for each row; links of pairs that ``known`` lacks add nothing."""
    n_b = len(width[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        pairs, counts, best = (np.frombuffer(x, k) for x, k in zip(known.value, (np.int64, np.int64, np.bool_)))
        digits = _decimals(max(map(len, width)))
        for batch in batches:
            for first, n, x in _aligned(batch, kinds, width):
                pair, row, times = _links(x, n_b, n)
                at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                at, row, times = at[hit], row[hit], times[hit]
                n_best = np.zeros(n, np.int64)
                count_sum = np.zeros(n, np.int64)
                np.add.at(n_best, row, times * best[at])
                np.add.at(count_sum, row, times * counts[at])
                per_row = lambda of, w=None: np.bincount(of, w, minlength=n).astype(np.int64) if with_groups else np.zeros(n, np.int64)
                texts = group_texts(x, n, digits) if with_groups else [b""] * n
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(first, n), batch.column("doc_id").slice(first, n), pa.array(per_row(x.rows[0])), pa.array(per_row(x.rows[1])),
                    pa.array(per_row(x.rows[0][x.ends[0]])), pa.array(per_row(x.rows[0], x.hi - x.lo)), pa.array(n_best), pa.array(count_sum),
                    pa.array([hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts]),
                ], ["row", "doc_id", *_NUMBERS, "groups_sha256"])

    return run


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_DIGEST = "row long, doc_id long, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", groups_sha256 string"


class Pair(NamedTuple):
    """Two tokenizers, as the driver read their files: token bytes and kinds of packed ids."""

    definition: str
    model: bytes
    words: tuple[Vocabulary, Vocabulary]
    kinds: tuple[type, type]

    @classmethod
    def read(cls, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> Pair:
        definition, model = Path(folder, a_file).read_text(encoding="utf-8"), Path(folder, b_file).read_bytes()
        words = vocabulary_a(definition), vocabulary_b(model)
        return cls(definition, model, words, tuple(np.uint16 if len(w.width) <= 1 << 16 else np.uint32 for w in words))

    @property
    def width(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words[0].width, self.words[1].width


def encoded(docs: DataFrame, pair: Pair) -> DataFrame:
    """(row, doc_id, a, b): ids of both tokenizers, packed, written to the shared folder; ``row`` tells repeats apart.

    Texts that are null or empty, or whose bytes a tokenizer changes, have none.  The files of
    the tokenizers go to the executors with the job.
    """
    sc = docs.sparkSession.sparkContext
    kernel = _encode(sc.broadcast(pair.definition), sc.broadcast(pair.model), _cuttable(pair.definition, pair.model), pair.kinds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, a binary, b binary")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "a", "b"), "tokens")


def groups(tokens: DataFrame, pair: Pair) -> DataFrame:
    """(row, doc_id, a, b, group_a, group_b): ids as arrays and, for each group, its number of A and of B tokens."""
    kinds, width = pair.kinds, pair.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda values, rows, n: np.split(values, np.cumsum(np.bincount(rows, minlength=n))[:-1])
        for batch in batches:
            for first, n, x in _aligned(batch, kinds, width):
                lists = [cut(i, r, n) for i, r in zip(x.ids, x.rows)]
                lists += [cut(np.diff(np.flatnonzero(e) + 1, prepend=0), r[e], n) for e, r in zip(x.ends, x.rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, n), batch.column("doc_id").slice(first, n), *(pa.array(v, pa.list_(pa.int32())) for v in lists)],
                    ["row", "doc_id", "a", "b", "group_a", "group_b"],
                )

    return tokens.mapInArrow(run, "row long, doc_id long, a array<int>, b array<int>, group_a array<int>, group_b array<int>")


def pair_counts(tokens: DataFrame, pair: Pair) -> DataFrame:
    """(pair, n, best): in how many rows two ids are linked, and whether no pair of its A id has more; pair is a * size of B + b."""
    counts = tokens.select("a", "b").mapInArrow(_pair_counts(pair.kinds, pair.width), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # An A id has at most as many pairs as B has ids.
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {len(pair.words[1].width)}")))
    return counts.withColumn("best", F.col("n") == most)


def digests(tokens: DataFrame, pair: Pair, slice_pairs: int = SLICE) -> DataFrame:
    """The columns of op11 from encoded rows; more than ``slice_pairs`` pairs take a pass for each slice of them."""
    sc = tokens.sparkSession.sparkContext
    counts = written(pair_counts(tokens, pair), "pairs")
    slices = max(1, -(-counts.count() // slice_pairs))
    parts = []
    for k in range(slices):
        got = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).toArrow().sort_by("pair")
        sent = [got.column(c).to_numpy().tobytes() for c in ("pair", "n", "best")]
        parts.append(tokens.mapInArrow(_digests(pair.kinds, pair.width, sc.broadcast(sent), k == 0), _DIGEST))
    if slices == 1:
        return parts[0].drop("row")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    total = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in _NUMBERS), F.max("groups_sha256").alias("groups_sha256"))
    return total.drop("row")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers over every document.

    Null and empty texts, and texts whose bytes a tokenizer changes, have zeros and an empty
    digest; null ids are kept; repeated rows are answered as often as they stand and count
    each; an empty table gives an empty result.  Columns beside doc_id and text are not read.
    """
    pair = Pair.read()
    tokens = encoded(table(spark, sf_dir, "documents"), pair)
    return digests(tokens, pair).select("doc_id", *_NUMBERS, "groups_sha256")


ship_by_value(__name__)
