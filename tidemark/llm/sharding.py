"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of ``CELLS`` cells.  A row goes to the
first point clockwise of the cell its key hashes to.  A shard takes rows up to its
quota; the rows beyond it continue clockwise to the next point whose shard has room.
Which rows go on depends on nothing but their rank within their arc, so the whole
placement follows from one count per arc: at most ``n_shards * vnodes`` numbers
reach the driver, however many rows there are.

Rows are ranked inside (cell, sub-bucket) windows, and small tables of offsets turn that
into ranks within arcs and slots within shards.  A cell has a sub-bucket for each
``WINDOW_ROWS`` of its rows, so neither a whole shard nor one hot key is a window.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, literal_rows, table

CELLS = 1 << 14
#: Rows of a cell for which it gets one more sub-bucket.
WINDOW_ROWS = 100_000


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all points in ring order; a taken cell moves a point on by one."""
    if n_shards < 1 or vnodes < 1 or n_shards * vnodes > CELLS // 2:
        raise ValueError(f"n_shards * vnodes must lie between 1 and {CELLS // 2}")
    owner: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(n_shards):
            cell = int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % CELLS
            while cell in owner:
                cell = (cell + 1) % CELLS
            owner[cell] = s
    return sorted(owner.items())


def quotas(total: int, n_shards: int, load_factor: float | None) -> list[int]:
    """Rows that each shard may hold: counts at most one apart, or ``load_factor`` times the mean."""
    if load_factor is None:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    if load_factor < 1:
        raise ValueError("load_factor must be at least 1")
    return [-int(-load_factor * total // n_shards)] * n_shards


def place(loads: list[int], owners: list[int], caps: list[int]) -> list[dict]:
    """Segments of arc ranks with the shard and first slot of each.

    First every shard takes rows of its own arcs, in ring order, up to its quota.
    Then what is left of each arc goes on clockwise, in ring order of the arcs.
    """
    room, used, out, left = list(caps), [0] * len(caps), [], []

    def put(arc: int, lo: int, n: int, shard: int) -> None:
        out.append({"arc": arc, "lo": lo, "hi": lo + n, "shard": shard, "slot0": used[shard]})
        used[shard] += n
        room[shard] -= n

    for arc, n in enumerate(loads):
        s = owners[arc]
        if take := min(n, room[s]):
            put(arc, 0, take, s)
        if n > take:
            left.append((arc, take, n - take))
    for arc, lo, n in left:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            if take := min(n, room[owners[at]]):
                put(arc, lo, take, owners[at])
                lo, n = lo + take, n - take
    return out


def ring_shards(
    df: DataFrame,
    key: str,
    spread: Column,
    order: list[str],
    n_shards: int = 40,
    vnodes: int = 64,
    load_factor: float | None = None,
) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 within the shard).

    key: column whose value decides the place on the ring (nulls share one place).
    spread: what splits the rows of one heavily repeated key into sub-buckets; it must be
        the same whenever ``df`` is read again.
    order: columns that order rows of one key; rows equal in all of them are alike.
    load_factor: None for counts at most one apart, else the bound over the mean.

    Null keys, repeated rows and empty tables are placed like any other rows.
    Names that start with ``__ring`` must be free.
    """
    spark = df.sparkSession
    points = ring_points(n_shards, vnodes)
    owners = [s for _, s in points]
    # The cells after the previous point up to this one are this arc; the first arc wraps round.
    arcs, previous = [], -1
    for arc, (cell, _) in enumerate(points):
        arcs.append({"__ring_arc": arc, "a": previous + 1, "b": cell, "turn": 1})
        previous = cell
    if previous < CELLS - 1:
        arcs.append({"__ring_arc": 0, "a": previous + 1, "b": CELLS - 1, "turn": 0})
    cells = literal_rows(spark, arcs, "__ring_arc int, a int, b int, turn int").select(
        "__ring_arc", "turn", F.explode(F.sequence("a", "b")).alias("__ring_cell")
    )
    celled = df.withColumn("__ring_cell", F.pmod(F.xxhash64(F.col(key)), F.lit(CELLS)).cast("int"))
    # CELLS rows; their sub-buckets number CELLS and one for each WINDOW_ROWS at most, so all of it may be broadcast.
    subs = celled.groupBy("__ring_cell").agg(F.ceil(F.count(F.lit(1)) / WINDOW_ROWS).alias("__ring_subs"))
    tagged = celled.join(F.broadcast(checkpointed(subs, CELLS)), "__ring_cell").withColumn(
        "__ring_sub", F.pmod(F.xxhash64(F.col(key), spread), F.col("__ring_subs")).cast("int")
    )
    counted = tagged.groupBy("__ring_cell", "__ring_sub").agg(F.count(F.lit(1)).alias("n"))
    in_arc = Window.partitionBy("__ring_arc").orderBy("turn", "__ring_cell", "__ring_sub")
    offsets = checkpointed(
        counted.join(F.broadcast(cells), "__ring_cell").select(
            "__ring_cell",
            "__ring_sub",
            "__ring_arc",
            "n",
            (F.sum("n").over(in_arc) - F.col("n")).alias("__ring_before"),
        ),
        CELLS,
    )
    loads = [0] * len(points)
    for row in offsets.groupBy("__ring_arc").agg(F.sum("n").alias("n")).collect():
        loads[row["__ring_arc"]] = row["n"]
    segments = literal_rows(
        spark,
        place(loads, owners, quotas(sum(loads), n_shards, load_factor)),
        "arc int, lo bigint, hi bigint, shard int, slot0 bigint",
    ).toDF("__ring_arc", "__ring_lo", "__ring_hi", "__ring_shard", "__ring_slot0")
    within = Window.partitionBy("__ring_cell", "__ring_sub").orderBy(key, *order)
    ranked = (
        tagged.withColumn("__ring_rank", F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(offsets.drop("n")), ["__ring_cell", "__ring_sub"])
        .withColumn("__ring_rank", F.col("__ring_rank") + F.col("__ring_before"))
        .join(F.broadcast(segments), "__ring_arc")
        .where("__ring_rank >= __ring_lo and __ring_rank < __ring_hi")
    )
    return ranked.select(
        *df.columns,
        F.col("__ring_shard").alias("shard"),
        (F.col("__ring_slot0") + F.col("__ring_rank") - F.col("__ring_lo")).alias("slot"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size and crc32 of each text; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``rows``: counts at most one apart.

    Null ids and null texts are placed like any other; repeated rows stay as often as they
    stand and may lie in different shards; an empty table gives an empty result.
    """
    rows = digest(table(spark, sf_dir, "documents")).withColumn("part", F.spark_partition_id())
    out = ring_shards(checkpointed(rows), "doc_id", F.struct("text_crc32", "part"), ["size", "text_crc32"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def file_place(docs: DataFrame) -> tuple[Column, Column] | None:
    """File and row of every row, as long as ``docs`` is a plain read of files; else None."""
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["file_name"], meta["row_index"])
    except AnalysisException:
        return None
    return meta["file_name"], meta["row_index"]


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The rows of ``docs`` with their shard and slot, for the pipeline.

    Read from files, each row is a key of its own, so copies of a document part, and slots
    follow the order of the files (by name) and of the rows in them: a shuffled input
    stays shuffled within every shard.  Otherwise the key is the doc_id, and slots follow
    the ring.  Columns named shard or slot come back as shard_input and slot_input.
    Null ids, null texts, repeated rows and empty tables are placed like any others.
    """
    docs = docs.withColumnsRenamed({c: f"{c}_input" for c in ("shard", "slot") if c in docs.columns})
    place = file_place(docs)
    if place is None:
        crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
        tagged = docs.withColumn("__ring_crc", crc)
        return ring_shards(tagged, "doc_id", F.col("__ring_crc"), ["__ring_crc"], n_shards).drop("__ring_crc")
    names = ["__ring_file", "__ring_row"]
    placed = docs.withColumns(dict(zip(names, place)))
    # Writers number their files; the rest of a name differs from run to run.
    part = F.regexp_extract("__ring_file", r"^part-([0-9]+)", 1)
    keys = checkpointed(placed.select(*names, F.xxhash64("doc_id", part, "__ring_row").alias("key")))
    dealt = checkpointed(ring_shards(keys, "key", F.col("__ring_row"), names, n_shards).select(*names, "shard"))
    # One row for each shard and file.
    counts = dealt.groupBy("shard", "__ring_file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__ring_file")) - F.col("n")
    offsets = counts.select("shard", "__ring_file", before.alias("__ring_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "__ring_file").orderBy("__ring_row"))
    slots = dealt.withColumn("__ring_rank", rank).join(offsets, ["shard", "__ring_file"])
    slots = slots.select(*names, "shard", (F.col("__ring_before") + F.col("__ring_rank") - 1).cast("long").alias("slot"))
    return placed.join(slots, names).select(*docs.columns, "shard", "slot")
