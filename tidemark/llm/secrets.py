r"""Secret scans: corpus-wide ownership frequency.

Candidates are the base patterns' values and long tokens that mix letters and digits.
Their hashes are aggregated over the whole corpus, first by distinct repository within
an owner, then by distinct owner.  A value that ``EXAMPLE_OWNERS`` owners or
``EXAMPLE_REPOSITORIES`` repositories hold, of whatever owner, is a copied example; one
that few hold, with enough different characters, looks live.  Live tokens that no base
span covers are added to the document's spans; base spans always stay.

Here a document is a repository and its source the owner.  Both aggregations combine
before their shuffle.  Values that many documents hold are few by that very count, so
their verdicts go out by broadcast and a common value costs no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import match_spans
from ._spark import checkpointed, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
_MAYBE_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
KINDS = ("assign", "access", "hex", "live")
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 20
#: Repositories from which a value's verdict is broadcast.
COMMON = 1000
LIVE_CHARACTERS = 8
_SEEN = "array<struct<start:int,kind:int,end:int,verdict:string>>"
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def spans(text: Column, pattern: str, kind: int, value_group: int, least: int) -> Column:
    """Spans of leftmost non-overlapping matches whose value has ``least`` characters or more."""

    def span(m: Column) -> Column:
        value = F.regexp_extract(m["hit"], pattern, value_group) if value_group else m["hit"]
        return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), value.alias("value"))

    return F.filter(F.transform(match_spans(text, pattern), span), lambda s: F.length(s["value"]) >= least)


def _joined(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and further candidates of every document, in one pass over the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    # A text without a long token can hold neither an access key nor a hex run.
    long_ = F.col("long")
    found = docs.select("doc_id", "source", text.alias("text"), F.xxhash64("doc_id", "source", "text").alias("row")).withColumn(
        "long", F.col("text").rlike(TOKEN)
    )
    t = F.col("text")
    found = found.select(
        "doc_id",
        "source",
        "row",
        F.when(t.rlike(_MAYBE_ASSIGN), spans(t, ASSIGN, 0, 2, 6)).otherwise(none).alias("assign"),
        F.when(long_ & t.contains("AKIA"), spans(t, ACCESS, 1, 0, 20)).otherwise(none).alias("access"),
        F.when(long_ & t.rlike(HEX), spans(t, HEX, 2, 0, 24)).otherwise(none).alias("hex"),
        F.when(long_ & t.rlike("[0-9]"), spans(t, TOKEN, 3, 0, 20)).otherwise(none).alias("tokens"),
    )
    tokens = F.filter(
        "tokens",
        lambda s: s["value"].rlike("[0-9]")
        & s["value"].rlike("[A-Za-z]")
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))).select(
        "doc_id",
        "source",
        "row",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.transform(
            F.array_sort(F.concat("base", tokens)),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["kind"].alias("kind"),
                s["end"].alias("end"),
                F.sha2(s["value"], 256).alias("hash"),
                (F.size(F.array_distinct(F.split(s["value"], ""))) >= LIVE_CHARACTERS).alias("varied"),
            ),
        ).alias("candidates"),
    )


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate value; null is an owner or repository of its own."""
    held = scanned.select(
        "doc_id", "source", F.explode(F.array_distinct(F.transform("candidates", lambda c: c["hash"]))).alias("hash")
    )
    by_owner = held.distinct().groupBy("hash", "source").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with how many of its values look live or copied.

    Null texts are empty; a null id is one repository, a null source one owner.  Repeated
    rows stay as often as they stand and count once.  An empty table gives an empty result.
    """
    scanned = checkpointed(scan(table(spark, sf_dir, "documents")))
    some = scanned.where(F.size("candidates") > 0)
    owned = ownership(some)
    # Texts without a candidate have no span and skip the joins.
    each = some.select("row", F.explode("candidates").alias("c"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    owned = checkpointed(owned.select("hash", copied.alias("copied"), (F.col("repositories") >= COMMON).alias("common")))
    verdict = F.when(F.col("copied"), "example").when(F.col("c.varied"), "live").otherwise("plain").alias("verdict")
    # Candidates / COMMON rows at most.
    common = F.broadcast(owned.where("common").select(F.col("hash").alias("h"), "copied"))
    seen = each.join(common, F.col("c.hash") == F.col("h"), "left")
    rare = seen.where("h is null").select("row", "c").join(owned.where("not common"), F.col("c.hash") == F.col("hash"))
    judged = seen.where("h is not null").select("row", "c", verdict).union(rare.select("row", "c", verdict))
    # A set: rows alike bring the same spans again.
    by_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("c.start", "c.kind", "c.end", "verdict"))).alias("all")
    )
    count = lambda v: F.size(F.filter("all", lambda s: s["verdict"] == v)).cast("long")
    shown = F.filter("all", lambda s: (s["kind"] < 3) | (s["verdict"] == "live"))
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    with_some = some.join(by_row, "row", "left").withColumn("all", F.coalesce("all", F.array().cast(_SEEN))).select(
        *columns, _joined(shown).alias("spans"), count("live").alias("n_live"), count("example").alias("n_example")
    )
    without = scanned.where(F.size("candidates") == 0).select(
        *columns, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example")
    )
    return with_some.union(without)


def _oracle() -> str:
    def rows(kind: int, pattern: str, least: int, group: int = 0) -> str:
        p = pattern.replace("'", "''")
        value = f"regexp_extract(hit, '{p}', {group})" if group else "hit"
        return f"""
  SELECT r, {kind} AS kind, CAST(pos AS BIGINT) AS "start", CAST(pos + length(hit) AS BIGINT) AS "end", value FROM (
    SELECT r, hits[j] AS hit, coalesce(list_sum([length(g) FOR g IN gaps[1:j]]), 0) + coalesce(list_sum([length(h) FOR h IN hits[1:j - 1]]), 0) AS pos,
      {value.replace('hit', 'hits[j]')} AS value
    FROM (SELECT r, hits, gaps, unnest(range(1, len(hits) + 1)) AS j FROM (
      SELECT r, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM d)))
  WHERE length(value) >= {least}"""

    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    text = f"""string_agg({name} || ':' || "start" || ':' || "end", ',' ORDER BY "start", kind)"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
b AS ({rows(0, ASSIGN, 6, 2)} UNION ALL {rows(1, ACCESS, 20)} UNION ALL {rows(2, HEX, 24)}),
t AS ({rows(3, TOKEN, 20)}),
x AS (
  SELECT * FROM b UNION ALL
  SELECT * FROM t WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = t.r AND b."start" < t."end" AND t."start" < b."end")
), o AS (
  SELECT value, count(DISTINCT coalesce('0' || source, '1')) AS owners,
    count(DISTINCT (coalesce('0' || source, '1'), coalesce('0' || doc_id, '1'))) AS repositories FROM x JOIN d USING (r) GROUP BY value
), j AS (
  SELECT x.*, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} THEN 'example' WHEN len(list_distinct(string_split(x.value, ''))) >= {LIVE_CHARACTERS} THEN 'live' ELSE 'plain' END AS verdict
  FROM x JOIN o USING (value)
), a AS (
  SELECT r, {text} FILTER (WHERE kind < 3 OR verdict = 'live') AS spans, count(*) FILTER (WHERE verdict = 'live') AS n_live,
    count(*) FILTER (WHERE verdict = 'example') AS n_example
  FROM j GROUP BY r
), c AS (
  SELECT r, {text} AS base, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
    count(*) FILTER (WHERE kind = 2) AS n_hex FROM b GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN a USING (r) LEFT JOIN c USING (r)
"""


ORACLE = _oracle()
