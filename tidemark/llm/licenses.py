"""License scans: diagonal voting over word k-grams.

All rolling k-gram hashes of every text are joined to the positions of the templates'
k-grams.  A hit votes for the diagonal text position minus template position; diagonals
that lie next to each other are merged, as a word added or left out moves a quotation
to the next one; a merged span is verified by the share of the template's words that
its hits cover.  The template table is a constant of this module, so its side of the
join is broadcast; nothing else is.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, literal_rows, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
COVERAGE = 0.8
NEIGHBOURS = 2
#: (phrase, label) of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, words) that diagonal voting looks for.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("proprietary", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null is empty."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.coalesce(F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase)), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def row_key() -> Column:
    """Rows alike in id and text have the same hits, so they share one key."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    rows, seen = [], set()
    for n, (label, line) in enumerate(templates):
        w = line.split()
        for i in range(len(w) - K + 1):
            gram = tuple(w[i : i + K])
            rows.append({"template": n, "template_label": label, "length": len(w), "at": i, "gram": gram, "head": gram not in seen})
            seen.add(gram)
    grams = literal_rows(spark, rows, "template int, template_label string, length int, at int, gram array<string>, head boolean")
    hash_ = F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(K)]).alias("hash")
    return grams.select("template", "template_label", "length", "at", "head", hash_)


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One head row for each text and one for each hit, from one pass over the texts.

    Every k-gram is joined to the templates'; of those without a hit only a text's first
    row goes on (pos 0, or null for texts of fewer words), so what is written is small.
    """
    none = F.array().cast("array<int>")
    grams = lambda words: F.when(
        F.size(words) >= K,
        F.transform(F.sequence(F.lit(0), F.size(words) - K), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)])),
    )
    # One value bound by an outer lambda, so that no rewrite computes the words more than once.
    cut = F.transform(
        F.array(F.struct(words_of(F.col("text")).alias("words"), folded(F.col("text")).contains("license").alias("maybe"))),
        lambda t: F.struct(
            F.size(t["words"]).cast("long").alias("n_words"),
            *[F.when(t["maybe"], places(t["words"], p)).otherwise(none).alias(label) for p, label in PHRASES],
            grams(t["words"]).alias("grams"),
        ),
    )
    # Spark must not cut a text once for each field that is read.
    texts = docs.select("doc_id", row_key().alias("row"), F.inline(cut))
    each = texts.select("doc_id", "row", "n_words", *[label for _, label in PHRASES], F.posexplode_outer("grams").alias("pos", "hash"))
    hits = each.join(F.broadcast(template_grams(docs.sparkSession, templates)), "hash", "left")
    return hits.where("template is not null or pos is null or pos = 0").drop("hash")


def matches(hits: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(row, label, share, verified, first, last): each merged span of each template, first and last word."""
    diagonals = hits.groupBy("row", "template", F.col("template_label").alias("label"), "length", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max(F.col("pos") + K - 1).alias("last"), F.collect_set("at").alias("ats")
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS).cast("int")
    spans = (
        diagonals.withColumn("apart", F.coalesce(apart, F.lit(0)))
        .withColumn("span", F.sum("apart").over(along))
        .groupBy("row", "template", "label", "length", "span")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        )
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + K - 1)))))
    return spans.select(
        "row", "label", (covered / F.col("length")).alias("share"), (covered / F.col("length") >= coverage).alias("verified"), "first", "last"
    )


def places(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase begins."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + j) == part)
        return F.coalesce(test, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and voted templates of every document.

    Null and empty texts have no word and no label.  Null ids are kept, repeated rows stay
    repeated, an empty table gives an empty result.
    """
    marked = checkpointed(scanned(table(spark, sf_dir, "documents")))
    found = matches(marked.where("template is not null")).groupBy("row").agg(
        F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("voted"), F.max("share").alias("share")
    )
    # A first k-gram may hit several templates; one of its rows is the head.
    first = F.col("pos").isNull() | (F.col("pos") == 0) & F.coalesce("head", F.lit(True))
    base = marked.where(first)
    labels = [label for _, label in PHRASES]
    starts = F.concat(*labels)
    own = F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(x)) for x in labels]), lambda x: x.isNotNull())
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return base.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.coalesce("voted", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """The same in SQL, with the words themselves in place of their hashes."""
    grams = []
    for n, (label, line) in enumerate(TEMPLATES):
        w = line.split()
        grams += [f"({n}, '{label}', {len(w)}, {i}, '{' '.join(w[i : i + K])}')" for i in range(len(w) - K + 1)]
    phrase = lambda p: " AND ".join(f"words[i + {j}] = '{x}'" for j, x in enumerate(p.split()))
    bases = ", ".join(
        f"[i - 1 FOR i IN range(1, len(words) + 1) IF coalesce({phrase(p)}, false)] AS b_{label}" for p, label in PHRASES
    )
    own = " || ".join(f"CASE WHEN len(b_{label}) > 0 THEN ['{label}'] ELSE [] END" for _, label in PHRASES)
    starts = " || ".join(f"b_{label}" for _, label in PHRASES)
    return rf"""
WITH g(template, label, length, place, gram) AS (VALUES {", ".join(grams)}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS words FROM documents
), k AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= {K}
), h AS (
  SELECT r, template, label, length, place, i - 1 AS pos FROM (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM k) JOIN g USING (gram)
), v AS (
  SELECT r, template, label, length, pos - place AS diagonal, list(DISTINCT place) AS ats FROM h GROUP BY ALL
), a AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {NEIGHBOURS} THEN 1 ELSE 0 END AS apart FROM v
), m AS (
  SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM a
), c AS (
  SELECT r, label, length, len(list_distinct(flatten([[x, x + 1, x + 2] FOR x IN flatten(list(ats))]))) / length AS share
  FROM m GROUP BY r, template, label, length, span
), f AS (
  SELECT r, list(DISTINCT label) FILTER (WHERE share >= {COVERAGE}) AS voted, max(share) AS share FROM c GROUP BY r
), b AS (
  SELECT r, doc_id, len(words) AS n_words, {bases} FROM d
), o AS (
  SELECT r, doc_id, n_words, {starts} AS starts, {own} AS own FROM b
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base,
  CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(own)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(own || coalesce(voted, []))), ','), '') AS labels,
  CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM o LEFT JOIN f USING (r)
"""


ORACLE = _oracle()
