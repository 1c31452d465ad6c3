import math
import re
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import evals, filters, graph, index, pages, sessions
from tidemark.plans import diagnose


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_boilerplate_clauses(spark):
    words = "alpha beta gamma delta epsilon zeta "
    texts = ["one two three four five", words, words + "List of Tables", words + "figure figure page figure", words + "was changed", words * 2 + "changed", None]
    assert column(spark, texts, filters.is_boilerplate) == [True, False, True, True, True, False, True]


def test_gate(spark):
    assert column(spark, ["the Rover TV camera froze", "main bus b undervolt", "water in the suit during EVA", None], filters.out_of_domain) == ["Rover", None, None, None]


def test_labels(spark):
    assert column(spark, ["EPS", "EVA suit", "other", None], filters.scope_label) == [True, False, None, None]
    assert column(spark, ["crew health", "LM dps"], lambda c: filters.scope_label(c, True)) == [False, True]
    assert column(spark, ["", "SKIP it", "**skip", "a cause"], filters.is_skip) == [True, True, True, False]


def test_subsystem_names(spark):
    df = spark.createDataFrame(
        [("the gimbal drifted", "GNC", False), ("the gimbal drifted", "EPS", False), ("anything", "", False), ("gimbal", "gnc", True), ("odd thing (x)", "thing (q)", False), (None, "eps", False)],
        "d string, s string, no boolean",
    )
    got = [r[0] for r in df.select(filters.names_subsystem(F.col("d"), F.col("s"), F.col("no"))).collect()]
    assert got == [True, False, True, False, True, False]


def test_document_names(spark):
    assert column(spark, ["x-report", "Flight-Rules", "b-mp-1", "b-fr", "zz"], filters.document_type) == [
        "anomaly_report", "flight_rule", "malfunction_procedure", "flight_rule", "malfunction_procedure"]
    assert [tuple(x) for x in column(spark, ["lm-timeline", "timeline-review", "zz"], filters.document_class)] == [
        ("OPERATIONAL", "timeline"), ("HISTORICAL", "review"), ("HISTORICAL", "(none)")]


DOCS = [(0, "pump leak pump"), (1, "pump valve"), (2, "pump tank"), (3, "bus fuse relay")]


def test_bm25_by_hand(spark):
    idx = index.build_index(spark.createDataFrame(DOCS, "ord long, t string"), F.col("t"))
    got = {r["ord"]: r["score"] for r in index.score(idx, spark.createDataFrame([(1, ["pump", "leak", "leak"])], "query_id int, toks array<string>")).collect()}
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in dict(pump=3, leak=1, valve=1, tank=1, bus=1, fuse=1, relay=1).items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    avg = 10 / 4
    part = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {0: part("pump", 2, 3) + 2 * part("leak", 1, 3), 1: part("pump", 1, 2), 2: part("pump", 1, 2)}
    assert got == pytest.approx(want)
    top = index.top_k(spark.createDataFrame([(1, o, s) for o, s in want.items()], "query_id int, ord long, score double"), 2)
    assert [r["ord"] for r in top.orderBy("rank").collect()] == [0, 1]


@pytest.mark.parametrize("positive", [True, False])
def test_best_segments_are_those_of_all_scores(spark, monkeypatch, positive):
    """Each task keeps its best: no row for every query and segment, ties by key, and blocks of queries and segments don't show."""
    monkeypatch.setattr(index, "_QUERIES", 3)
    monkeypatch.setattr(index, "_SEGMENTS", 4)
    texts = [(o, " ".join(f"w{(o * k) % 13}" for k in range(o % 7))) for o in range(40)] + [(99, None), (50, "w1 w2"), (51, "w1 w2")]
    seg = spark.createDataFrame(texts, "ord long, t string")
    queries = spark.createDataFrame([(q, [f"w{q}", f"w{q + 2}", "w0"] if q else ["none"]) for q in range(8)], "query_id int, toks array<string>")
    idx = index.build_index(seg, F.col("t"))
    scores = index.score(idx, queries).withColumn("score", F.round("score", 9))
    want = index.top_k(scores if positive else index.all_scores(scores, seg, queries, 5), 5, positive=positive)
    got = index.best(idx, queries, 5, positive)
    key = lambda df: sorted(rows(df.select("query_id", "rank", "ord", F.round("score", 8))))
    assert key(got) == key(want) and len({r[0] for r in key(got)}) == (7 if positive else 8)
    pairs = spark.createDataFrame([(1, 50), (1, 39), (2, 50), (5, 99)], "query_id int, ord long")
    some = {(r[0], r[1]): r[2] for r in rows(index.score(idx, queries, pairs=pairs))}
    every = {(r[0], r[1]): r[2] for r in rows(index.score(idx, queries))}
    assert some == pytest.approx({p: every[p] for p in ((1, 50), (1, 39), (2, 50), (5, 99)) if p in every})


def test_fallback_serves_what_salience_cannot(spark):
    idx = index.build_index(spark.createDataFrame(DOCS, "ord long, t string"), F.col("t"))
    asked = spark.createDataFrame([(1, "the pump valve rattled"), (2, "BUS noise"), (3, "nothing known")], "query_id int, symptom string")
    assert {(r["query_id"], r["variant"]) for r in index.effective_scores(idx, asked).collect()} == {(1, "fallback"), (2, "salience")}


def test_coverage_and_fusion(spark):
    vocab = spark.createDataFrame([("pump",), ("valve",)], "tok string")
    asked = spark.createDataFrame([(1, "pump and seal pump"), (2, "")], "query_id int, symptom string")
    assert dict(rows(index.coverage(asked, vocab))) == {1: pytest.approx(1 / 3), 2: 0.0}
    ranked = spark.createDataFrame([(1, "a", 7, 0), (1, "b", 7, 1), (1, "c", 7, 0)], "query_id int, list string, id int, pos int")
    assert rows(index.fuse_rankings(ranked, {"a": 1.0, "b": 2.0})) == [(1, 7, pytest.approx(1 / 61 + 2 / 62))]


def test_links_need_half_their_tokens(spark):
    seg = spark.createDataFrame(
        [(0, ["pump"], "one"), (1, ["pump seal"], "pump"), (2, ["pump seal valve gear nut"], "valve"), (3, [""], "pump seal valve"), (4, None, "gear nut")],
        "ord long, links array<string>, label string",
    )
    edges = rows(graph.resolve_links(seg).select("src", "dst", "seq"))
    assert sorted(edges) == [(0, 1, 1), (0, 3, 2), (1, 3, 1), (2, 3, 1), (2, 4, 2)]


def _walk(spark, edges, scores, **kw):
    e = spark.createDataFrame(edges, "src long, dst long, seq int")
    s = spark.createDataFrame([(1, o, x) for o, x in scores.items()], "query_id int, ord long, score double")
    entry = spark.createDataFrame([(1, 1, 0, scores.get(0, 0.0))], "query_id int, chain int, ord long, score double")
    return rows(graph.chase(entry, e, s, **kw).select("path"))[0][0]


def test_chase(spark):
    edges = [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 3, 2), (3, 4, 1)]
    assert _walk(spark, edges, {0: 4.0, 1: 3.0, 2: 3.0, 3: 2.0, 4: 1.9}) == [0, 1, 3]  # tie to the first, floor kept, then below it
    assert _walk(spark, edges, {0: 4.0, 1: 4.0, 3: 4.0, 4: 4.0}, max_depth=2) == [0, 1, 3]
    assert _walk(spark, edges, {0: 4.0}) == [0]
    assert _walk(spark, edges, {2: 1.0}) == [0, 2]  # an entry without a score takes any


def test_coverage_chase_counts_new_terms_only(spark):
    e = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (2, 1, 1)], "src long, dst long, seq int")
    terms = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["c", "d"])], "ord long, terms array<string>")
    idf = spark.createDataFrame([("a", 9.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)], "tok string, idf double")
    entry = spark.createDataFrame([(1, 1, 0, 1.0)], "query_id int, chain int, ord long, score double")
    assert rows(graph.chase_coverage(entry, e, terms, idf).select("path")) == [([0, 2, 1],)]


def test_reach_and_route(spark):
    e = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 2, 5.0), (1, 2, 1, 1.0), (2, 0, 1, 1.0)], "src long, dst long, seq int, cost double")
    seeds = spark.createDataFrame([(1, 0)], "query_id int, node long")
    assert sorted(rows(graph.reach(seeds, e, hops=2, fanout=1).select("node", "hop"))) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(rows(graph.route(seeds, e, 3).select("node", "cost"))) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("lone",)], "node string")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = dict(rows(graph.pagerank(nodes, e, tol=1e-8)))
    assert sum(got.values()) == pytest.approx(1) and got["b"] > got["a"] == pytest.approx(got["c"]) and got["lone"] < got["a"]
    prior = dict(rows(graph.scaled_prior(spark.createDataFrame(list(got.items()), "node string, rank double"))))
    assert prior["b"] == pytest.approx(0.1) and prior["lone"] == 0


def test_auc(spark):
    def auc(pairs):
        return evals.auc(spark.createDataFrame(pairs, "x double, y boolean"), "x", "y").first()[0]

    assert auc([(1.0, True), (1.0, False)]) == 0.5
    assert auc([(2.0, True), (1.0, False)]) == 1.0
    assert auc([(2.0, True)]) == 0.5
    data = [(float(i * 7 % 5), i % 3 == 0) for i in range(20)]
    assert auc(data) + auc([(-x, y) for x, y in data]) == pytest.approx(1)


@pytest.mark.parametrize(("n", "want"), [(4, [4] * 4), (5, [0, 1, 2, 3, 4]), (7, [0, 1, 2, 3, 4, 4, 4]), (10, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4])])
def test_last_bin_takes_the_remainder(spark, n, want):
    df = spark.range(n).withColumn("v", F.col("id").cast("double"))
    assert [r["bin"] for r in evals.bins_last_wide(df, "v", "id").orderBy("id").collect()] == want


@pytest.mark.parametrize(("n", "want"), [(1, (0, 0, 0, 0)), (5, (3, 4, 0, 2)), (20, (18, 19, 1, 10))])
def test_percentile_forms(spark, n, want):
    forms = ("p95_low", "p95_high", "p05", "upper_median")
    assert tuple(spark.range(n).agg(*[evals.order_statistic(F.col("id"), f) for f in forms]).first()) == want


def test_vote_breaks_ties_by_name_and_skips_echo(spark):
    pts = spark.createDataFrame([(1, ["valve", "pump"], ["pump"]), (1, ["pump", "valve", "seal"], ["pump"]), (1, ["seal"], ["pump"])], "query_id int, terms array<string>, echo array<string>")
    assert rows(evals.echo_free_vote(pts)) == [(1, "seal", 2)]


def test_permutation_p_value(spark):
    df = spark.createDataFrame([(i, float(i), i >= 10) for i in range(20)], "id int, x double, y boolean")
    auc, p = evals.permutation_test(df, "x", "y", replicates=50).first()
    assert auc == 1.0 and p == pytest.approx(1 / 51)


def test_held_out_draws(spark):
    df = spark.createDataFrame([(i, float(i), i >= 50) for i in range(100)], "id int, score double, label boolean")
    got = rows(evals.held_out_auc(df, "score", "label", replicates=30).select("rep", "auc"))
    assert len(got) == 30 and all(a == 1.0 for _, a in got)
    noise = df.withColumn("label", F.col("id") % 2 == 0)
    again = [sorted(rows(evals.held_out_auc(noise, "score", "label", replicates=30).select("rep", "auc"))) for _ in range(2)]
    assert again[0] == again[1] and len({a for _, a in again[0]}) > 20
    assert abs(sum(a for _, a in again[0]) / 30 - 0.5) < 0.1


def test_sessions(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "HIT"), (1, 3, "c"), (2, 1, "x")], "s int, t int, w string")
    assert rows(sessions.cumulative(df, "s", "t", "w").orderBy("s", "t").select("transcript")) == [("a",), ("a HIT",), ("a HIT c",), ("x",)]
    assert sorted(rows(sessions.until_hit(df, "s", "t", F.col("w") == "HIT").select("s", "t"))) == [(1, 1), (1, 2), (2, 1)]
    done = spark.createDataFrame([(1,)], "s int")
    once = sessions.not_done(df, done, ["s"])
    assert rows(once.select("s")) == [(2,)] and rows(sessions.not_done(once, done, ["s"]).select("s")) == [(2,)]
    assert rows(sessions.last_per_key(df, "s", "t").orderBy("s").select("w")) == [("c",), ("x",)]


def test_page_spans(spark):
    p = spark.createDataFrame([("d", 1, "x" * 10, 80.0), ("d", 2, "", 0.0), ("d", 3, "y" * 10, 60.0)], "doc string, page int, text string, conf double")
    off = pages.page_offsets(p)
    assert [r["off"] for r in off.orderBy("page").collect()] == [0, 11, 12]
    segs = spark.createDataFrame([("d", 0, 10), ("d", 5, 20), ("d", 10, 11), ("d", 500, 9000)], "doc string, start long, end long")
    assert {(r["start"], r["confidence"]) for r in pages.span_confidence(segs, off, width=8).collect()} == {(0, 80.0), (5, 140 / 3), (10, 0.0), (500, 0.0)}


def test_headings(spark):
    docs = spark.createDataFrame([("d", "2.4.1 Start\nProcedure 7-2 next\nno 3.1 heading\n FR-ECLSS-014.3 x"), ("e", None)], "doc string, text string")
    assert [tuple(r)[1:] for r in pages.headings(docs).orderBy("start").collect()] == [(0, "2.4.1"), (12, "Procedure 7-2"), (46, "FR-ECLSS-014.3")]


def test_headings_as_python_tells_lines_and_digits(spark):
    text = "1.2²\n1.2é\n3.4_\n\x1c5.6\u2028 7.8\r9.1\n\n \u00a0٣.٤ x\nProcedure\n7-2\nAR-X-1.5.6"
    got = pages.headings(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert [tuple(r)[1:] for r in got.orderBy("start").collect()] == [(m.start(), m.group(1)) for m in re.finditer(pages.HEADING, text)]


def test_functions_travel_without_the_package():
    """What runs on executors loads in a process that can't import the package."""
    for module, function in ((diagnose, diagnose.echo_generator), (diagnose, diagnose.with_retries(diagnose.echo_generator))):
        code = "import pickle, sys; f = pickle.load(sys.stdin.buffer); print(f('a\\nb', '[S1]'), 'tidemark' in sys.modules)"
        sent = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(function), capture_output=True, cwd="/", env={})
        assert sent.stdout.decode().strip() == "b [S1] False", sent.stderr.decode()


def test_triples(spark):
    good = '{"triples":[{"subject":"pump","subject_type":"Component","relation":"locatedIn","object":"loop","object_type":"Subsystem"},{"subject":"x","subject_type":"Odd","relation":"causes","object":"y","object_type":"Fault"}]}'
    t = filters.closed_schema(pages.parsed_triples(spark.createDataFrame([(1, good), (2, "no json")], "seg_id int, payload string")))
    r = pages.triples_to_segments(t).first()
    assert (r["subsystem"], r["component"], r["links_to"], r["signature"]) == ("loop", "pump", [], "loop, pump")


def test_anchors_look_at_a_text_normalised_once(spark):
    """No pattern runs over the text within what is done for each anchor."""
    df = spark.createDataFrame([("The Er--An unit",), (None,)], "t string")
    got = df.select(evals.anchor_coverage(F.col("t"), F.array(*map(F.lit, ("er an", "zz", "UNIT")))).alias("a"))
    assert [(r["a"]["coverage"], list(r["a"]["hits"])) for r in got.collect()] == [(pytest.approx(2 / 3), ["er an", "UNIT"]), (0.0, [])]
    each = re.findall(r"contains\(([^,]*),", str(evals.anchor_coverage(F.col("t"), F.array(F.lit("zz")))))
    assert each and not any("replace" in x for x in each)
