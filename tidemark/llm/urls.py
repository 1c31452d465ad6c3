"""URL filters: a trie over reversed host labels and path segments.

Each rule is a host, a path prefix and a verdict.  The trie's upper levels are host
labels from the last to the first; under each host hangs a trie of its path's whole
segments, whose nodes hold the rules that go on into part of a segment.  A url walks
its labels as far as they go, so the deepest host met is the most specific, and the
longest path prefix under it wins; hosts above are asked only if none fits.  Between an
allow and a block entry of one place, the block holds.

The trie is broadcast with its functions; its size is the rule list's, which the caller
gives and ``MAX_RULES`` bounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship_by_value
from ._spark import table

MAX_RULES = 1_000_000
#: (verdict, host, path) of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first ``://``, A-Z lower-cased, and the path up to ``?`` or ``#``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host, path = (rest[:end], "") if slash < 0 else (rest[:slash], rest[slash:end])
    return host.encode().lower().decode(), path


class Trie:
    """Longest-match rules over hosts and paths."""

    def __init__(self, rules: Iterable[tuple[str, str, str]], default: str = "allow"):
        self.default = default
        self.root: dict = {}
        for n, (verdict, host, path) in enumerate(rules, 1):
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, tail = path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault((segment,), {})
            ends = node.setdefault("", {})
            if ends.get(tail, ("", ""))[0] != "block":
                ends[tail] = (verdict, host + path)

    def _path(self, node: dict, segments: list[str]) -> tuple[str, str] | None:
        """The rule with the longest prefix of the path, from whole segments and the start of the next."""
        best = None
        for segment in segments:
            fits = [tail for tail in node.get("", ()) if segment.startswith(tail)]
            if fits:
                best = node[""][max(fits, key=len)]
            if (node := node.get((segment,))) is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule, verdict)."""
        node, found, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node and (rule := self._path(node["/"], segments)):
                found = rule
        return (None, self.default) if found is None else (found[1], found[0])


def judge(pages: DataFrame, trie: Trie) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [trie.match(h, p) for h, p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    schema = "page_id long, host string, path string, rule string, verdict string"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, schema)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; pages that no rule fits are allowed.

    A null url or one without ``://`` has an empty host and path, which no rule fits.  Null
    ids are kept, repeated rows are judged as often as they stand, an empty table gives an
    empty result; columns beside page_id and url are not read.
    """
    return judge(table(spark, sf_dir, "pages"), Trie(RULES))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u
), r AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
  END AS rule FROM p
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

ship_by_value(__name__)
