import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions import lexicons as L
from tidemark.functions import text as T
from tidemark.operators import index, studies


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_texts(spark):
    c = F.lit
    assert one(spark, T.long_tokens(c("Ab abc, x-ray 12 345")), T.turns(c("first clause here. second clause; third one is here too"), 12, 1)) == (["abc", "ray", "345"], ["first clause here."])
    assert one(spark, T.chain_text(c(""), c(" sig  x "), c("raw")), T.chain_text(c(None).cast("string"), c(""), c("raw\n\ntext")), T.chain_text(c("c" * 300), c("s"), c("r"))) == ("sig x", "raw text", "c" * 200)
    assert one(spark, T.response_text(c('{"message": {"content": "say"}}')), T.response_text(c("{}")), T.response_text(c("no json"))) == ("say", None, None)


def test_assignments_gist_and_agreement(spark):
    of = lambda s: studies.subsystem_of(F.lit(s), L.SIGNAL_SUBSYSTEMS)
    assert one(spark, of("the LIGHTNING strike at launch"), of("nothing"), studies.subsystem_of(F.lit(None).cast("string"), L.MISSION_SUBSYSTEMS)) == ("EPS", None, None)
    assert len(L.MISSION_SUBSYSTEMS) == 11 and len(L.SIGNAL_SUBSYSTEMS) == 14
    gist = lambda s: studies.action_gist(F.lit(s))
    got = one(spark, gist("Power down the CM; use the Lunar Module as a lifeboat"), gist("the LM cabin"), gist(None))
    assert [tuple(g) for g in got] == [(True, True), (False, False), (False, False)]
    line = lambda *a: studies.agreement_text(*[F.lit(x) for x in a])
    assert one(spark, line(3, 6, "bus"), line(2, 6, "bus"), line(0, 0, None)) == (
        "agreement: 3 of 6 sources converge on 'bus'", "low agreement — leads scatter; treat as uncertain, verify each (top term 'bus', 2/6)",
        "low agreement — leads scatter; treat as uncertain, verify each",
    )


def test_fused_lists_follow_their_order(spark):
    ranked = [(1, 0, p, i) for p, i in enumerate("abca")] + [(1, 1, p, i) for p, i in enumerate("bd")] + [(1, 2, 0, "e"), (2, 1, 0, "z"), (2, 0, 0, "y")]
    df = spark.createDataFrame(ranked, "query_id long, list int, pos int, id string")

    def want(lists, weights):
        score = {}
        for items, w in zip(lists, weights):
            for p, i in enumerate(items):
                score[i] = score.get(i, 0.0) + w / (60 + p + 1)
        return [(i, pytest.approx(score[i])) for i in sorted(score, key=score.get, reverse=True)]

    for weights in ([1.0, 0.5], [1.0], None):
        got = rows(index.fuse_lists(df.where("query_id = 1"), weights).orderBy("place").select("id", "score"))
        assert got == want(["abca", "bd", "e"], weights or [1.0] * 3)
    assert rows(index.fuse_lists(df.where("query_id = 2")).orderBy("place").select("id")) == [("y",), ("z",)]


def test_rates_and_means(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, True), (False, True, False), (None, False, True)], "inside boolean, hit boolean, declined boolean")
    assert rows(studies.breadth_gap(df, "inside", "hit", "declined")) == [(2, 2, 0.5, 0.5, 0.0, 1, 1)]
    assert rows(studies.breadth_gap(df.limit(0), "inside", "hit", "declined"))[0][:4] == (0, 0, 0.0, 0.0)
    res = [("in", 0.5, False, 0.8, "high", 3, 1), ("in", None, True, None, "low", 0, 0), ("in", 0.2, False, 0.4, None, 2, 2), ("out", 0.9, True, 0.1, "low", 1, 0)]
    got = studies.grounding_summary(spark.createDataFrame(res, "scope string, coverage double, declined boolean, confidence double, confidence_level string, n_points int, n_inferred int"), 0.25)
    assert got.first().asDict() == {
        "n_in": 3, "n_out": 1, "in_scope_mean_coverage": 0.233, "in_scope_reached_rate": 0.333, "in_scope_decline_rate": 0.333, "out_scope_decline_rate": 1.0,
        "in_scope_mean_confidence": 0.4, "out_scope_mean_confidence": 0.1, "in_scope_low_conf_rate": 0.333, "out_scope_low_conf_rate": 1.0, "total_points": 6, "total_inferred": 3,
    }
    forms = spark.createDataFrame([("full", True, 0.5), ("full", False, None), ("speech", None, None)], "form string, ok boolean, cov double")
    assert sorted(rows(studies.condition_means(forms, "form", "ok", "cov"))) == [("full", 2, 1, 0.5, 0.25), ("speech", 1, 0, 0.0, 0.0)]
    sweep = spark.createDataFrame([(0.3, 0.5), (0.4, 0.1)], "rel double, mean_coverage double")
    flat = spark.createDataFrame([(0.2,), (0.4,), (None,)], "coverage double")
    assert [r["lift"] for r in studies.with_lift(sweep, flat).orderBy("rel").collect()] == pytest.approx([0.2, -0.2])


def test_chain_structure(spark):
    segments = spark.createDataFrame(
        [(0, " Relay ", "s", ["x"], "d1"), (1, "relay", "", [], "d1"), (2, None, None, None, "d2"), (3, "pump", "s", ["y"], "d2")],
        "ord long, component string, signature string, symptoms array<string>, source_doc string",
    )
    paths = spark.createDataFrame([(1, 1, [0, 1, 2]), (1, 2, [1]), (2, 1, [3])], "query_id long, chain int, path array<long>")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long")
    got = studies.chain_structure(paths, segments, edges).first().asDict()
    assert got == pytest.approx({
        "queries": 2, "mean_entries": 1.5, "mean_length": 5 / 3, "single_chains": 2 / 3, "single_queries": 0.5, "has_component": 0.8, "has_signature": 0.4,
        "has_symptoms": 0.4, "has_links": 0.6, "entry_has_symptoms": 2 / 3, "mean_components": 1.0, "mean_docs": 1.5, "mean_segments": 2.0, "mean_visits": 2.5, "redundancy": 1.25,
    })


def test_annunciations(spark):
    segments = spark.createDataFrame([(0, ["bus", "volt", "bus"]), (1, ["bus"]), (2, []), (3, ["fan"])], "ord long, symptom_terms array<string>")
    queries = spark.createDataFrame([(1, ["bus", "fan", "other", "bus"]), (2, ["none"]), (3, [])], "query_id long, terms array<string>")
    got = {q: (s, f) for q, s, f in rows(studies.annunciations(queries, segments))}
    assert got == {1: (pytest.approx(math.log(4 / 3) + math.log(4 / 2)), pytest.approx(2 / 3)), 2: (0.0, 0.0), 3: (None, None)}
