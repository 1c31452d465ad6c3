"""Walks by each criterion, reach from matched symptoms, nested chains."""

import random

import pytest

from conftest import rows
from tidemark.operators import graph
from tidemark.plans import diagnose


def walked_plainly(entry, base, edges, terms, idf, score, floor, rel, depth):
    path, covered = [entry], set(terms[entry])
    for _ in range(depth):
        options = [(seq, n) for seq, n in edges[path[-1]] if n not in path]
        if floor is None:
            best = sorted((-score.get(n, 0.0), seq, n) for seq, n in options)
            if not best or -best[0][0] < rel * base:
                break
        else:
            options = [(seq, n) for seq, n in options if floor == 0 or score.get(n, 0.0) >= floor * base]
            best = sorted((-round(sum(idf[t] for t in terms[n] - covered), 9), seq, n) for seq, n in options)
            if not best or best[0][0] >= 0:
                break
        path.append(best[0][2])
        covered |= terms[path[-1]]
    return path


@pytest.mark.parametrize("criterion", ["bm25", "coverage", "coverage_guarded"])
def test_walks_follow_their_criterion(spark, criterion):
    rng = random.Random(6)
    n = 40
    terms = {i: {f"t{rng.randrange(60)}" for _ in range(8)} for i in range(n)}
    idf = {f"t{k}": 0.5 + k / 7 for k in range(60)}
    edges = {i: [(k + 1, d) for k, d in enumerate(rng.sample(range(n), 5)) if d != i] for i in range(n)}
    score = {i: round(rng.random(), 6) for i in range(n) if rng.random() < 0.8}
    entries = [(7, c, o, max(score.get(o, 0.0), 0.3)) for c, o in enumerate(rng.sample(range(n), 12), 1)]
    got = graph.chase_by(
        criterion, spark.createDataFrame(entries, "query_id long, chain int, ord long, score double"),
        spark.createDataFrame([(s, d, q) for s, out in edges.items() for q, d in out], "src long, dst long, seq int"),
        spark.createDataFrame([(7, o, s) for o, s in score.items()], "query_id long, ord long, score double"),
        spark.createDataFrame([(o, sorted(t)) for o, t in terms.items()], "ord long, terms array<string>"),
        spark.createDataFrame(list(idf.items()), "tok string, idf double"), rel=0.4, max_depth=3,
    )
    found = {r["chain"]: r["path"] for r in got.collect()}
    floor = graph.CRITERIA[criterion]
    want = {c: walked_plainly(o, b, edges, terms, idf, score, floor, 0.4, 3) for _, c, o, b in entries}
    assert found == want and (criterion != "bm25" or len({len(p) for p in want.values()}) > 1)
    assert criterion != "coverage_guarded" or any(want[c] != walked_plainly(o, b, edges, terms, idf, score, 0.0, 0.4, 3) for _, c, o, b in entries)


def test_reach_starts_at_matched_symptoms(spark):
    segments = spark.createDataFrame(
        [(0, "pump pressure low", ["x"]), (1, "pump noise", ["x"]), (2, "pressure low alarm", ["x"]), (3, "pump pressure low", []), (4, "pump", ["x"]), (5, "other", ["x"])],
        "ord long, label string, symptoms array<string>",
    )
    queries = spark.createDataFrame([(1, "pump pressure low"), (2, "nothing alike")], "query_id long, symptom string")
    assert sorted(rows(graph.symptom_seeds(segments, queries, "label"))) == [(1, 0), (1, 1), (1, 2)]
    edges = spark.createDataFrame([(0, 10, 1), (10, 11, 1), (11, 12, 1), (12, 13, 1)] + [(1, 20 + k, k) for k in range(1, 8)], "src long, dst long, seq int")
    got = {n: h for q, n, h in rows(graph.chain_reach(segments, edges, queries, "label"))}
    assert got == {0: 0, 1: 0, 2: 0, 10: 1, 11: 2, 12: 3} | {20 + k: 1 for k in range(1, 6)}


def test_nested_chains_hold_what_the_block_shows(spark):
    segments = spark.createDataFrame(
        [(0, "a", "doc1", "relay", "sig", "first  text\n" + "x" * 200), (1, "b", "doc2", "", "the signature", "second"), (2, "c", None, None, None, None)],
        "ord long, id string, source_doc string, component string, signature string, raw_text string",
    )
    paths = spark.createDataFrame([(5, 2, [2]), (5, 1, [0, 1])], "query_id long, chain int, path array<long>")
    (query, chains), = rows(diagnose.nested_chains(paths, segments))
    assert query == 5 and [(c["chain"], c["entry_doc"], c["n_steps"]) for c in chains] == [(1, "doc1", 2), (2, None, 1)]
    steps = chains[0]["steps"]
    assert [(s["tag"], s["label"], s["doc"], s["id"]) for s in steps] == [("[C1.1]", "relay", "doc1", "a"), ("[C1.2]", "the signature", "doc2", "b")]
    assert steps[0]["snippet"] == ("first text " + "x" * 200)[:120] and chains[1]["steps"][0]["label"] == "(section)"
    (_, block), = rows(diagnose.render_chains(paths, segments))
    assert all(s["tag"] in block and s["label"] in block for c in chains for s in c["steps"])


@pytest.mark.parametrize("often", [0, 3, 500])
def test_coverage_walks_meet_on_numbers(spark, monkeypatch, often):
    """However many terms count as common, sets are numbers, and walks are those over the terms themselves."""
    monkeypatch.setattr(graph, "_OFTEN", often)
    rng = random.Random(8)
    terms = {i: {f"t{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randrange(12))} for i in range(30)}
    held = [t for s in terms.values() for t in s]
    idf = {t: round(5 / held.count(t), 3) for t in set(held)}
    seg_terms = spark.createDataFrame([(o, sorted(t)) for o, t in terms.items()], "ord long, terms array<string>")
    weights = spark.createDataFrame(list(idf.items()), "tok string, idf double")
    coded, first, weight = graph.coded_terms(seg_terms, weights)
    shared = {t for t in idf if held.count(t) > 1}
    got = {r["ord"]: r for r in coded.collect()}
    assert set(got) == set(terms) and list(first) == sorted(first) and len(set(weight)) == len(weight)
    for o, own in terms.items():
        assert len(got[o]["ids"]) == len(own & shared) and got[o]["alone"] == pytest.approx(sum(idf[t] for t in own - shared))
    edges = {i: [(k + 1, d) for k, d in enumerate(rng.sample(range(30), 4)) if d != i] for i in range(30)}
    walks = graph.chase_coverage(
        spark.createDataFrame([(1, i, i, 1.0) for i in range(30)], "query_id long, chain int, ord long, score double"),
        spark.createDataFrame([(s, d, q) for s, out in edges.items() for q, d in out], "src long, dst long, seq int"), seg_terms, weights, max_depth=2,
    )
    assert {r["chain"]: r["path"] for r in walks.collect()} == {i: walked_plainly(i, 1.0, edges, terms, idf, {}, 0.0, 0.4, 2) for i in range(30)}
