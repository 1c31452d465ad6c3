"""SimHash near-duplicates of whole texts: tiled exact comparison, then verified similarity.

Texts become sets of 5-word shingles, each set a node with a 256-bit fingerprint.  Sets
alike in 0.8 or more differ in size by a quarter at most, so nodes are classed by size
(a factor of 1.25 each) and only equal and adjacent classes meet.  Within a class tiles
of at most about ``TILE`` nodes run along the population count, and tile pairs whose
counts differ beyond the radius are skipped.  A meeting is an exclusive-or and bit count
over whole tiles in numpy.

What leaves a meeting is a nearest spanning forest of its candidates, never the pairs of
a group.  Each link of the forest is verified on the shingle sets.  Where candidates hang
together, though verified links leave them in several components, a false neighbour may
have hidden the true one.  Of these, sets that share one of their rarest shingles are
compared exactly, in blocks: a set alike to another in 0.8 shares one of the rarest fifth
of its shingles with it, so pages that merely share a template never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ship_by_value
from ._bytes import LOWER, SpanHash, buffers, kind_table, mix, pieces, runs
from ._spark import BROADCAST_ROWS, checkpointed, packed, sent
from .components import connected_components, least_roots
from .neardup import row_key

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint.
WORDS = 4
#: Differing bits of 256 up to which two sets are candidates.  The worst pair of sets at
#: 0.8 differs in 41.2 bits on average with a deviation of 5.9, so this is 4.5 deviations on.
RADIUS = 68
#: Sets of 4 and 5 shingles spread wider: 48 bits on average with a deviation of 6.2.
TINY, TINY_RADIUS = 6, 77
TILE = 8192
#: Pairs that one numpy step compares.
STEP = 1 << 16
_NAMES = [f"w{w}" for w in range(WORDS)]
_SALTS = np.array([w * 0x9E3779B97F4A7C15 % (1 << 64) for w in range(WORDS)], np.uint64)
_PLACE = np.array([pow(0xD1342543DE82EF95, j + 1, 1 << 64) for j in range(SHINGLE)], np.uint64)
_SPACE = bytes([32, *range(9, 14)])
_NOT_SPACE = kind_table(word=bytes(b for b in range(256) if b not in _SPACE))


def shingle_sets(text: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct 64-bit shingle hashes of every text, ascending.

    Words are runs of anything but space and \\t to \\r, A-Z lower-cased; fewer words than
    ``width`` make one shingle, no word makes none.
    """
    data, offsets = buffers(text)
    for a, b in pieces(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, rows = runs(_NOT_SPACE[part], offsets[a : b + 1] - offsets[a])
        words = SpanHash(part)(starts, ends)
        n = max(0, len(words) - width + 1)
        each = np.zeros(n, np.uint64)
        for j in range(width):
            each += words[j : j + n] * _PLACE[j]
        each = mix(each)
        edges = np.searchsorted(rows, np.arange(b - a + 1)).tolist()
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo >= width:
                yield np.unique(each[lo : hi - width + 1])
            elif hi > lo:
                yield mix(np.array([(words[lo:hi] * _PLACE[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """``WORDS`` words: a bit is 1 if set in over half the hashes; later words mix the hashes anew."""
    out = np.zeros(WORDS, np.uint64)
    if len(h):
        for w in range(WORDS):
            lanes = (mix(h ^ _SALTS[w]) if w else h).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[w] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.zeros((batch.num_rows, WORDS), np.uint64)
        node, size = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32)
        for k, h in enumerate(shingle_sets(batch.column("text"))):
            words[k], size[k], node[k] = fingerprint(h), len(h), xxhash.xxh64_intdigest(h.tobytes())
        words = words.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(node.view(np.int64)), pa.array(size),
             *(pa.array(np.ascontiguousarray(words[:, w])) for w in range(WORDS))],
            ["doc_id", "row", "node", "size", *_NAMES],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [h.view(np.int64) for h in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest, nearest first."""
    root, taken = np.arange(n), []
    for far in np.unique(distance):
        at = np.flatnonzero(distance == far)
        x, y = root[i[at]], root[j[at]]
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        # Of the links between the same two parts one will do.
        _, first = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)
        up: dict[int, int] = {}

        def find(v: int) -> int:
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        for k in first.tolist():
            a, b = find(int(x[k])), find(int(y[k]))
            if a != b:
                up[max(a, b)] = min(a, b)
                taken.append(int(at[k]))
        if up:
            move = np.arange(n)
            for v in up:
                move[v] = find(v)
            root = move[root]
    return np.array(taken, np.int64)


def links_of(a: np.ndarray, size_a: np.ndarray, b: np.ndarray | None, size_b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, then b) of the links of a nearest spanning forest of all candidates.

    ``a[w]`` and ``b[w]`` hold word w of every node; without b, all of a meet each other.
    Candidates are within the radius and differ in size by a quarter at most.
    """
    other, sizes = (a, size_a) if b is None else (b, size_b)
    shift = 0 if b is None else a.shape[1]
    total = shift + other.shape[1]
    if not a.shape[1] or not other.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    widest = TINY_RADIUS if min(size_a.min(), sizes.min()) < TINY else RADIUS
    rows = max(1, STEP // other.shape[1])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def forest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, far = (np.concatenate(c) for c in zip(*found))
        kept = nearest_forest(total, x, y, far)
        return x[kept], y[kept], far[kept]

    for first in range(0, a.shape[1], rows):
        # All 256 bits differ at most, which wraps to 0; such a pair is verified like any other.
        far = np.bitwise_count(a[0, first : first + rows, None] ^ other[0][None, :])
        for w in range(1, WORDS):
            far += np.bitwise_count(a[w, first : first + rows, None] ^ other[w][None, :])
        at = np.flatnonzero(far <= widest)
        if not len(at):
            continue
        i, j = at // other.shape[1] + first, at % other.shape[1]
        small, large = np.minimum(size_a[i], sizes[j]), np.maximum(size_a[i], sizes[j])
        near = (5 * small >= 4 * large) & (far.ravel()[at] <= np.where(small < TINY, TINY_RADIUS, RADIUS))
        if b is None:
            near &= i < j
        if near.any():
            found.append((i[near], j[near] + shift, far.ravel()[at[near]]))
            held += int(near.sum())
            if held > 1_000_000:  # the forest of a forest and more links is the forest of all
                found = [forest()]
                held = len(found[0][0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, _ = forest()
    return x, y


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def unpack(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = cell.values
        words = np.stack([v.field(n).to_numpy().view(np.uint64) for n in _NAMES])
        return v.field("node").to_numpy(), words, v.field("size").to_numpy().astype(np.int64)

    for batch in batches:
        for k in range(batch.num_rows):
            nodes, a, size_a = unpack(batch.column("left")[k])
            b = size_b = None
            if batch.column("right")[k].is_valid:
                more, b, size_b = unpack(batch.column("right")[k])
                nodes = np.concatenate([nodes, more])
            x, y = links_of(a, size_a, b, size_b)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])


def candidate_links(nodes: DataFrame, n_nodes: int, tile: int = TILE) -> DataFrame:
    """(a, b): nearest spanning forests of the candidates among ``nodes`` (node, size, w0, w1, ...).

    Sets under 4 shingles are alike only if equal, so they meet nobody.  A tile is a run of
    the order by population count within a size class; nodes of one count are dealt by hash.
    Tiles keep their size however many there are, and tile pairs carry two of them each.
    """
    pop = sum((F.bit_count(n) for n in _NAMES[1:]), F.bit_count(_NAMES[0])).cast("int")
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1.25))).cast("int")
    classed = nodes.where("size >= 4").withColumns({"c": size_class, "pop": pop})
    # One row for each class and count: some 60 classes, 257 counts.
    counts = checkpointed(classed.groupBy("c", "pop").agg(F.count(F.lit(1)).alias("n")), 60 * 257)
    before = F.sum("n").over(Window.partitionBy("c").orderBy("pop")) - F.col("n")
    start = packed(counts, 60 * 257).withColumn("start", before)
    place = F.col("start") + F.pmod(F.xxhash64("node"), F.col("n"))
    tiles = checkpointed(
        classed.join(F.broadcast(start), ["c", "pop"])
        .withColumn("t", F.floor(place / tile).cast("long"))
        .groupBy("c", "t")
        .agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"), F.collect_list(F.struct("node", "size", *_NAMES)).alias("fps")),
        n_nodes,
    )
    first = tiles.select(
        F.col("c").alias("c1"), F.col("t").alias("t1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("fps").alias("left"),
        F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("c2"),
    )
    second = tiles.select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # Class 7 and below holds the sets of 4 and 5 shingles.
    reach = F.when(F.col("c1") <= 7, TINY_RADIUS).otherwise(RADIUS)
    # A tile's number, class and counts: one row for each tile, two for a class more.
    pairs = first.join(sent(second, n_nodes // tile + 60), "c2").where(
        ((F.col("c1") < F.col("c2")) | (F.col("t1") <= F.col("t2"))) & (F.greatest("lo1", "lo2") - F.least("hi1", "hi2") <= reach)
    )
    own = (F.col("c1") == F.col("c2")) & (F.col("t1") == F.col("t2"))
    right = tiles.select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("fps").alias("right"))
    both = pairs.select("c2", "t2", "left", own.alias("own")).join(right, ["c2", "t2"])
    return both.select("left", F.when(~F.col("own"), F.col("right")).alias("right")).mapInArrow(_meet, "a long, b long")


#: Rows of the sieve that keeps most texts without a candidate out of the shuffle.
SIEVE = 1 << 17


def sets_of(rows: DataFrame, needed: DataFrame, n_needed: int) -> DataFrame:
    """(node, shingles) of ``needed`` (row, node), cut anew from the texts of ``rows`` (row, text).

    Rows alike in id and text have one row key; they give the same set, and one is taken.
    They are folded before they shuffle, so none of them makes a key hot.
    """
    texts = rows.select("row", "text")
    if n_needed <= SIEVE:
        sifted = texts.join(F.broadcast(needed.select("row")), "row", "left_semi")
    else:
        bucket = F.pmod(F.col("row"), F.lit(SIEVE)).cast("int")
        sieve = F.broadcast(needed.select(bucket.alias("bucket")).distinct())
        sifted = texts.withColumn("bucket", bucket).join(sieve, "bucket", "left_semi").drop("bucket")
    once = sifted.dropDuplicates(["row"]).join(sent(needed, n_needed), "row")
    return once.select("node", "text").mapInArrow(_sets, "node long, shingles array<long>")


def alike(shared: Column, left: Column, right: Column, similarity: float) -> Column:
    return shared + 1e-9 >= similarity * (left + right - shared)


#: Links of one node that its set meets in one task.
HUB = 1000


def _with_sets(links: DataFrame, sets: DataFrame, key: str, name: str) -> DataFrame:
    """``links`` with the set of their end ``key``; a hub's set goes to one more task for each ``HUB`` of its links."""
    # links / HUB rows at most.
    hubs = F.broadcast(links.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / HUB).alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = links.join(hubs, key, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), salts)).drop("salts")
    held = sets.toDF(key, name).join(hubs, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return dealt.join(held.drop("salts"), [key, "salt"]).drop("salt")


def verified(links: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links whose shingle sets (node, shingles) are alike in ``similarity`` or more, exactly counted."""
    both = _with_sets(_with_sets(links, sets, "a", "x"), sets, "b", "y")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(alike(shared, F.size("x"), F.size("y"), similarity)).select("a", "b")


#: Sets, and shingles of them, that one side of a block takes.
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
_COLUMNS = 4096


def exact_links_of(
    values: np.ndarray, sizes: np.ndarray, part: np.ndarray, right: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, by names of parts, of all pairs of sets that are alike enough.

    The sets lie one after another in ``values``. Those of ``right`` meet the others only;
    without any, all meet all.
    """
    l, r = np.flatnonzero(~right), np.flatnonzero(right)
    if not len(r):
        r = l
    elif not len(l):
        return part[:0], part[:0]
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    many = count > 1  # a shingle of one set is shared by none
    column = np.cumsum(many) - 1
    row = np.repeat(np.arange(len(sizes)), sizes)[many[place]]
    place = column[place[many[place]]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    shared = np.zeros((len(l), len(r)), np.float32)
    width = int(many.sum())
    for first in range(0, width, _COLUMNS):
        a, b = np.searchsorted(place, [first, first + _COLUMNS])
        has = np.zeros((len(sizes), min(_COLUMNS, width - first)), np.float32)
        has[row[a:b], place[a:b] - first] = 1
        shared += has[l] @ has[r].T
    shared = shared.astype(np.float64)
    near = shared + 1e-9 >= similarity * (sizes[l][:, None] + sizes[r][None, :] - shared)
    i, j = np.nonzero(near)
    names, at = np.unique(part, return_inverse=True)
    root = least_roots(len(names), at[l[i]], at[r[j]])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _meet_exactly(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("members"):
                v = cell.values
                sets = v.field("shingles")
                x, y = exact_links_of(
                    sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy()), v.field("part").to_numpy(),
                    v.field("right").to_numpy(zero_copy_only=False), similarity,
                )
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def rare_groups(sets: DataFrame, similarity: float = SIMILARITY, n_sets: int = 1 << 40, volume: int = 1 << 40) -> DataFrame:
    """(node, group): sets (node, shingles) that hang together by shared rare shingles; sets that share none have no row.

    Two sets alike in ``similarity`` share at least that part of either, so each has one of
    the shared ones among the first (1 - similarity) of its shingles and one more, in any
    order that is the same for all sets.  By rarity, few sets meet in a shingle.  Shingles of
    one set are shared by none and stay out, though they count as first ones.  ``n_sets`` and
    ``volume`` tell how many sets and shingles there are at most; small tables are packed.
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = each.join(sent(common, volume // 2), "shingle", "left").select("node", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "shingle").alias("s"))
    held = marked.groupBy("node").agg(F.sort_array(F.collect_list("s")).alias("all"))
    size = F.size("all")
    first = F.slice("all", 1, (size - F.ceil(size * similarity - 1e-9) + 1).cast("int"))
    edges = held.select(F.col("node").alias("a"), F.explode(F.filter(first, lambda s: s["n"] > 1)).alias("s")).select("a", F.col("s.shingle").alias("b"))
    edges = checkpointed(edges, volume) if volume <= BROADCAST_ROWS else checkpointed(edges)
    # A shingle stands for those that share it; one that happens to equal a node's number only joins two groups.
    return connected_components(edges).toDF("node", "group").join(sent(sets.select("node"), n_sets), "node", "left_semi")


def _in_several(members: DataFrame, n: int) -> DataFrame:
    """The rows of ``members`` (node, group, part, size), ``n`` at most, whose group has several parts."""
    several = members.groupBy("group").agg((F.min("part") != F.max("part")).alias("several")).where("several").select("group")
    return members.join(sent(several, n), "group", "left_semi").select("node", "group", "part", "size")


def missed_links(
    links: DataFrame, roots: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK
) -> DataFrame | None:
    """Links between components ``roots`` (node, root) that the unverified ``links`` hold together; None if there can't be any.

    ``links`` span all candidates, so no pair of candidates lies outside one of their
    components.  Of such a group, sets that hang together by rare shingles are a group of
    their own, and every pair of its sets of two parts is counted exactly.
    A group is cut into blocks of at most ``block`` sets and ``BLOCK_SHINGLES`` shingles, and
    each two blocks meet by themselves; a part that fills blocks has its own, which do not
    meet each other, as what one part holds is joined already.
    """
    group = connected_components(links).toDF("node", "group")
    n = group.count()
    part = sent(roots.toDF("node", "part"), n)
    members = group.join(part, "node", "left").select("node", "group", F.coalesce("part", "node").alias("part"))
    members = packed(checkpointed(sizes.join(sent(members, n), "node").select("node", "group", "part", "size"), n), n)
    torn = packed(checkpointed(_in_several(members, n), n), n)
    n_torn, volume = torn.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n_torn:
        return None
    near = rare_groups(sets.join(sent(torn.select("node"), n_torn), "node"), similarity, n_torn, volume).withColumnRenamed("group", "near")
    # Two groups that happen to get one number are compared as one.
    members = torn.join(sent(near, n_torn), "node").select("node", F.xxhash64("group", "near").alias("group"), "part", "size")
    members = packed(checkpointed(members, n_torn), n_torn)
    members = packed(checkpointed(_in_several(members, n_torn), n_torn), n_torn)
    parts = members.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
    chunks = F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sum("volume") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    # A part that fills blocks is a pool of its own; the rest of a group is one pool.
    pure = (F.col("n") >= block) | (F.col("volume") >= BLOCK_SHINGLES)
    dealt = packed(checkpointed(parts.withColumn("pool", F.when(pure, F.col("part"))), n_torn), n_torn)
    if dealt.isEmpty():
        return None
    pools = dealt.groupBy("group", "pool").agg(chunks.alias("chunks"))
    name = F.struct(F.col("pool").isNull().alias("mixed"), "pool")
    mine = pools.select("group", name.alias("p"), F.col("chunks").alias("own"))
    theirs = pools.select("group", name.alias("q"), F.col("chunks").alias("others"))
    meet = mine.join(theirs, "group").where("p != q or p.mixed")
    placed = (
        members.join(sent(dealt.select("group", "part", "pool"), n_torn), ["group", "part"])
        .select("group", "node", "part", name.alias("p"))
        .join(meet, ["group", "p"])
        .withColumn("c", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    )
    right = (F.col("p") > F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("c") > F.col("d")))
    here, there = F.struct("p", "c"), F.struct(F.col("q").alias("p"), F.col("d").alias("c"))
    key = F.xxhash64("group", F.when(F.col("right"), there).otherwise(here), F.when(F.col("right"), here).otherwise(there))
    blocks = (
        placed.withColumn("right", right).select("node", "part", "right", key.alias("key"))
        .join(sets, "node")
        .groupBy("key").agg(F.collect_list(F.struct("part", "right", "shingles")).alias("members"))
    )
    return blocks.select("members").mapInArrow(_meet_exactly(similarity), "a long, b long")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of texts alike in 0.8 or more of their 5-word shingles.

    Groups are the components of all links.  The smallest doc_id of each stays (null ids
    last, then by row key) with all its columns; no document goes that is not linked to
    another.  Null and empty texts and texts of spaces hold no shingle and are alike.
    Repeated rows (same id and text) are one.  An empty table gives an empty one.
    Columns may have any names.  Nodes and rows are known by 64-bit hashes: two unlike
    ones merge with a chance of n * n / 2**65.
    """
    own = "row"
    while own in docs.columns:
        own += "_"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    marks = rows.mapInArrow(_marks, "doc_id long, row long, node long, size int, " + ", ".join(f"{n} long" for n in _NAMES))
    # Equal sets are one node with one row; copies fold before they shuffle.
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = checkpointed(marks.groupBy("node", "size", *_NAMES).agg(F.min(ranked).alias("first")))
    n = nodes.count()
    heads = nodes.select("node", "size", F.col("first.row").alias("row"), "first")
    links = checkpointed(candidate_links(nodes.select("node", "size", *_NAMES), n))
    n_links = links.count()
    links = packed(links, n_links)
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    needed = checkpointed(heads.select("row", "node").join(sent(ends, 2 * n_links), "node", "left_semi"), 2 * n_links)
    sets = checkpointed(sets_of(rows, needed, needed.count()))
    good = packed(checkpointed(verified(links, sets, similarity)), n_links)
    roots = connected_components(good)
    more = missed_links(links, roots, heads.select("node", "size"), sets, similarity)
    if more is not None:
        roots = connected_components(checkpointed(good.union(more)))
    grouped = heads.join(sent(roots, 2 * n_links), "node", "left")
    kept = grouped.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(own))
    return docs.withColumn(own, row_key()).dropDuplicates([own]).join(kept, own, "left_semi").select(*docs.columns)


ship_by_value(__name__)
