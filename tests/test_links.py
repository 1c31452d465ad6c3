"""Link resolution by rare tokens against all pairs."""

import random

import pytest

from conftest import rows
from tidemark.operators import graph

SEGMENT = "ord long, label string, links array<string>"


def resolved_plainly(segments, always_two):
    out = []
    for src, _, links in segments:
        best = {}
        for k, text in enumerate(links or []):
            toks = set((text or "").split())
            need = 2 if always_two else 1 if len(toks) <= 2 else max(2, len(toks) // 2)
            for dst, label, _ in segments:
                if dst != src and toks and len(toks & set((label or "").split())) >= need:
                    best.setdefault(dst, k)
        out += [(src, dst, i) for i, (_, dst) in enumerate(sorted((k, d) for d, k in best.items()), 1)]
    return sorted(out)


@pytest.mark.parametrize("always_two", [False, True])
def test_links_agree_with_all_pairs(spark, always_two):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(30)]
    text = lambda most: " ".join(rng.choice(words[: rng.choice([3, 30])]) for _ in range(rng.randint(0, most)))
    segments = [(i, rng.choice([text(6), text(6), None]), rng.choice([[text(7) for _ in range(rng.randint(0, 3))], None])) for i in range(80)]
    segments += [(100, "word1 word2", ["", None, "unseen words alone", "word1 unseen"])]
    got = sorted(rows(graph.resolve_links(spark.createDataFrame(segments, SEGMENT), always_two).select("src", "dst", "seq")))
    assert got == resolved_plainly(segments, always_two) and len(got) > 50


def test_a_token_that_is_everywhere_makes_no_candidates(spark):
    """400 labels share a word that every link names too: 160,000 pairs hold it, 400 are candidates."""
    segments = [(i, f"procedure unit{i}", [f"procedure unit{(i + 1) % 400} step"]) for i in range(400)]
    df = spark.createDataFrame(segments, SEGMENT)
    assert graph.link_candidates(df).count() <= 800
    assert sorted(rows(graph.resolve_links(df).select("src", "dst"))) == sorted((i, (i + 1) % 400) for i in range(400))
    assert graph.resolve_links(df.limit(0)).count() == 0
