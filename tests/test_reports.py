"""Reports, routes, symptom graphs, readers and the generator's contract, by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import analysis, evals, graph, index, reports
from tidemark.plans import diagnose
from tidemark.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


SEG = "id string, subsystem string, component string, symptoms array<string>, links_to array<string>"


def test_symptom_graph_by_hand(spark):
    seg = spark.createDataFrame([("p1", "eps", "Bus", ["Low Volts"], ["p2", "gone"]), ("p2", "", None, None, None), ("p3", None, "fan", ["low volts"], [])], SEG)
    nodes, edges = analysis.symptom_graph(seg)
    assert rows(edges) == sorted([
        ("eps", "p1", "has_procedure"), ("Bus", "p1", "has_procedure"), ("eps", "Bus", "has_component"), ("symptom::low volts", "p1", "indicates"),
        ("symptom::low volts", "eps", "associated_with"), ("p1", "p2", "related_to"), ("p1", "gone", "related_to"), ("fan", "p3", "has_procedure"),
        ("symptom::low volts", "p3", "indicates"),
    ], key=repr)
    kinds = {r["node"]: r["kind"] for r in nodes.collect()}
    assert kinds == {"p1": "procedure", "p2": "procedure", "p3": "procedure", "eps": "subsystem", "Bus": "component", "fan": "component", "symptom::low volts": "symptom", "gone": None}
    asked = spark.createDataFrame([(1, "low volts on the bus"), (2, "nothing")], "query_id int, symptom string")
    assert rows(analysis.matching_symptoms(nodes, asked).select("query_id", "node", "overlap")) == [(1, "symptom::low volts", 2)]


def test_route_settles_on_the_cheapest_way(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 1.0), ("c", "d", 1.0), ("d", "b", 1.0), ("b", "a", 1.0), ("b", "e", 0.5)], "src string, dst string, cost double")
    got = graph.route(spark.createDataFrame([(1, "a")], "query_id int, node string"), edges)
    assert rows(got) == [(1, "a", 0.0), (1, "b", 3.0), (1, "c", 1.0), (1, "d", 2.0), (1, "e", 3.5)]
    nodes = spark.createDataFrame([("b", "procedure"), ("c", "procedure"), ("d", "symptom"), ("e", "procedure")], "node string, kind string")
    found = graph.routed_segments(got, nodes, 2).collect()
    assert sorted((r["place"], r["node"]) for r in found) == [(1, "c"), (2, "b")] and {r["node"]: r["score"] for r in found}["c"] == pytest.approx(math.exp(-1))
    near = graph.routed_segments(got, nodes, None, nodes.where("node = 'b'"))
    assert sorted((r["place"], r["node"]) for r in near.collect()) == [(1, "c"), (2, "b"), (3, "e")]


def test_resolution_rate_and_two_tokens(spark):
    seg = spark.createDataFrame([(1, ["main bus", "zz"], "main bus"), (2, [], "main bus volts"), (3, [], "bus")], "ord int, links array<string>, label string")
    assert rows(graph.resolve_links(seg).select("src", "dst")) == [(1, 2), (1, 3)]
    assert rows(graph.resolve_links(seg, always_two=True).select("src", "dst")) == [(1, 2)]
    hit = spark.createDataFrame([(1, 0)], "src int, link int")
    assert rows(graph.resolution_rate(seg, hit)) == [(0.5,)]


def test_subsets_and_components(spark):
    r = spark.createDataFrame([(1, "the motors", False), (2, "a ring", False), (3, "motor", True)], "id int, decision string, declined boolean")
    parts = spark.createDataFrame([(1, "motor", 1), (1, "seal", 2), (2, "o-ring", 1), (3, "motor", 1)], "id int, part string, place int")
    assert rows(analysis.component_scores(r, parts)) == [(1, True, True, True, 0.5), (2, False, False, True, 0.0), (3, False, False, False, 0.0)]
    got = analysis.subset_report(r, {"all": F.lit(True), "odd": F.col("id") % 2 == 1, "none": F.lit(False)}, {"declined": F.col("declined").cast("int")})
    assert {x[0]: tuple(x)[1:] for x in got.select("subset", "n", "declined").collect()} == {"all": (3, pytest.approx(1 / 3)), "odd": (2, 0.5), "none": (0, None)}


def test_reports_by_hand(spark):
    runs = spark.createDataFrame([(k, float(k)) for k in range(7)], "run long, seconds double")
    assert tuple(reports.latency_summary(runs).first()) == (5, 4.0, 5.0, 2.0, 6.0)
    syms = spark.createDataFrame([("a",), ("b",), ("c",)], "symptom string")
    assert rows(reports.cycled(syms, 5, "symptom").select("run", "symptom")) == [(0, "a"), (1, "b"), (2, "c"), (3, "a"), (4, "b")]
    t = spark.createDataFrame([("s1", "x", "c", "y", "c"), ("s2", "x", "c", "x", "c")], "seg_id string, subject string, subject_type string, object string, object_type string")
    assert rows(reports.entity_occurrences(t)) == [("x", "c", ["s1", "s2"]), ("y", "c", ["s1"])]
    found = spark.createDataFrame([("kept", 3148.0), ("dropped", 1.0)], "check string, value double")
    assert {r["check"]: r["ok"] for r in reports.release_checks(found, {"kept": 3148, "dropped": 222, "split": 146}).collect()} == {"kept": True, "dropped": False, "split": False}
    x = spark.createDataFrame([(i, i / 10, i / 20, 1.0 - i / 10, i > 4) for i in range(10)], "id int, dial double, reached double, strength double, inside boolean")
    got = reports.convergence(x)
    assert got["pearson"].first()["dial_reached"] == pytest.approx(1) and {r["score"]: r["auc"] for r in got["auc"].collect()} == {"dial": 1.0, "strength": 0.0}
    assert sorted((r["bin"], r["n"]) for r in got["bins"].collect()) == [(k, 2) for k in range(5)]
    readings = spark.createDataFrame([("2020-01-01 00:00:01", 2.0), ("2020-01-01 00:00:09", 4.0), ("2020-01-01 00:00:11", 9.0)], "t string, value double").withColumn("t", F.col("t").cast("timestamp"))
    assert [tuple(r)[1:] for r in reports.sampled(readings, "t", 10).orderBy("slot").collect()] == [(2, 3.0, 4.0), (1, 9.0, 9.0)]
    crew = spark.createDataFrame([(True, False, "true"), (True, True, "TRUE"), (None, True, None)], "crew_initiated boolean, diagnosed_in_flight boolean, crew_observed string")
    assert [f(crew).count() for f in (reports.crew_reported, reports.live_loops, reports.crew_observed)] == [2, 1, 1]


def test_functions_without_a_query(spark):
    x = spark.createDataFrame([("valve: stuck",), ("valve: open",), ("fan",), (None,)], "reason string")
    assert rows(analysis.failure_reasons(x, "reason")) == [("fan", 1), ("valve", 2)]
    b = spark.createDataFrame([(1, -1.0), (-1, -1.0), (-1, 5.0)], "t int, s double")
    assert analysis.usable_baseline(b, "t", "s").count() == 2
    w = spark.createDataFrame([(k, "eps") for k in range(9)], "id int, subsystem string")
    assert {r["control"] for r in analysis.wrong_subsystem(w, ["EPS", "gnc", "ecs"]).collect()} <= {"gnc", "ecs"}
    sc = spark.createDataFrame([("in", False, True), ("in", False, False), ("out", True, False)], "scope string, declined boolean, hit boolean")
    assert rows(analysis.scope_report(sc, "scope", "declined", "hit")) == [("in", 2, 0.0, 0.5), ("out", 1, 1.0, None)]
    y = spark.range(1).select(evals.term_coverage(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), analysis.mentions_any(F.lit("Fan STUCK"), ("stuck",)), T.half_even(F.lit(2.5).cast("decimal(3,1)")))
    assert tuple(map(float, y.first())) == (0.5, 1.0, 2.0)
    z = spark.range(1).select(T.alnum_tokens(F.lit("O-ring, 2x")), T.exact_part_words(F.lit("the valve made found")), T.where_words(F.lit("the valve made found")))
    assert tuple(z.first()) == (["o", "ring", "2x"], ["valve"], ["valve", "made", "found"])


def test_zeros_fill_the_best(spark):
    s = spark.createDataFrame([(1, 5, 2.0), (1, 6, -1.0)], "query_id int, ord int, score double")
    seg, q = spark.createDataFrame([(k,) for k in range(8)], "ord int"), spark.createDataFrame([(1,), (2,)], "query_id int")
    got = index.top_k(index.all_scores(s, seg, q, 3), 3, positive=False)
    assert rows(got.select("query_id", "rank", "ord")) == [(1, 1, 5), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2)]


def test_readers_of_scenarios_and_baselines(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    one = {"mission": "m1", "anomalies": [{"symptom": "a", "human_turns_to_diagnosis": -1, "human_time_s": 2.0}]}
    for k, doc in enumerate(({"missions": [one]}, {"results": [one]}, one, [one, one])):
        got = readers.read_atlas(spark, put(f"a{k}.json", doc)).select("mission", "symptom", "human_turns_to_diagnosis", "human_time_s")
        assert rows(got) == [("m1", "a", None, 2.0)] * (2 if k == 3 else 1)
    sc = readers.read_scenarios(spark, put("s.json", {"scenarios": [{"mission": "m1", "query": f"q{k}", "scope": "out" if k == 1 else "in"} for k in range(4)]}))
    an = readers.read_anchors(spark, put("n.json", {"missions": [{"mission": "m1", "anchors": [{"component_terms": ["x"]}]}, {"mission": "m1", "anchors": [{"component_terms": ["y"]}]}]}))
    assert rows(readers.with_anchors(sc, an).select("place", "component_terms")) == [(0, ["x"]), (1, None), (2, ["y"]), (3, None)]
    ep = put("e.json", {"episode_id": "e", "human_baseline": {"report_end_get": "55:55:39", "default_diagnosis_checkpoint": "d", "checkpoints": [{"name": "d", "get": "56:09:xx", "delta_from_report_end_s": 810}, {"name": "c", "get": "55:55:42"}]}, "resolution_anchor": {"symptom": "s", "component_terms": ["t"]}})
    points = readers.read_checkpoints(spark, ep)
    assert rows(reports.human_time(points, T.elapsed_seconds)) == [("e", 810.0, True)]
    assert rows(reports.human_time(points.withColumn("wanted", F.lit("c")), T.elapsed_seconds)) == [("e", 3.0, True)]
    assert readers.read_anchor(spark, ep).first()["component_terms"] == ["t"]
    assert readers.read_manifest(spark, str(tmp_path / "none")).count() == 0
    sinks.write_manifest(spark.createDataFrame([("d1", "ok")], "doc string, status string"), str(tmp_path / "m"))
    assert rows(readers.read_manifest(spark, str(tmp_path / "m"))) == [("d1", "ok")]
    table = spark.createDataFrame([("long value here", 1), (None, 2)], "a string, b int")
    assert sinks.console(table.orderBy("b"), 6) == "a      b\nlong v 1\n       2"
    sinks.write_json(table, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_priors(spark.createDataFrame([("n", 0.1)], "node string, prior double"), str(tmp_path / "p"))
    assert rows(spark.read.json(str(tmp_path / "p")).select("node", "prior")) == [("n", 0.1)]


def test_generator_contract(spark):
    waits, calls = [], []

    def flaky(prompt, tag):
        calls.append(prompt)
        if len(calls) == 1:
            raise OSError("down")
        return "" if len(calls) == 2 else " fine "

    assert diagnose.with_retries(flaky, sleep=waits.append)("p", "t") == "fine" and waits == [2.0, 4.0]

    def down(prompt, tag):
        raise ValueError("no")

    loads = []
    assert diagnose.with_retries(down, before_retry=lambda: loads.append(1), sleep=waits.append)("p", "t") == "(generation unavailable: ValueError)" and len(loads) == 3
    assert diagnose.with_retries(lambda p, t: "", tries=1)("p", "t") == "(generation unavailable: empty)"


def test_points_tell_an_outage_from_a_gap(spark):
    seg = spark.createDataFrame(
        [(k, f"main bus undervolt procedure number {k} check breaker panel lights again", "", "doc", "", []) for k in range(3)]
        + [(k, f"cabin pressure sensor reading {k} high compare with backup gauge dial today", "", "doc", "", []) for k in range(3, 9)],
        "ord int, raw_text string, signature string, source_doc string, component string, symptoms array<string>",
    )
    asked = spark.createDataFrame([(1, "main bus undervolt"), (2, "xylophone quartz")], "query_id int, symptom string")
    by = {r["query_id"]: r for r in diagnose.diagnose_points(asked, seg).collect()}
    assert not by[1]["declined"] and by[1]["n_points"] == 3 and by[2]["declined"] and not by[2]["unavailable"] and by[2]["diagnosis"] == diagnose.DECLINED
    out = {r["query_id"]: r for r in diagnose.diagnose_points(asked, seg, generate=lambda p, t: "(generation unavailable: OSError)").collect()}
    assert out[1]["declined"] and out[1]["unavailable"] and out[1]["diagnosis"].startswith("(generation unavailable") and not out[2]["unavailable"]
