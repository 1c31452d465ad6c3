import json

import pytest

from conftest import rows
from tidemark.plans import diagnose
from tidemark.sources import readers, sinks
from tidemark.streaming.sessions import resume_sink, session_stream


def test_corpus_defaults(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "raw_text": "x", "links_to": ["l"]}, {"raw_text": None}]))
    got = readers.read_corpus(spark, str(tmp_path / "c.json")).orderBy("ord").collect()
    assert [(r["ord"], r["id"], r["raw_text"], r["links_to"], r["symptoms"]) for r in got] == [(0, "a", "x", ["l"], []), (1, "None", "", [], [])]


def test_lines_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(rows(readers.read_lines(spark, str(tmp_path / "r.jsonl"), "a int", tolerant=True))) == [(1,), (2,)]
    with pytest.raises(Exception):
        readers.read_lines(spark, str(tmp_path / "r.jsonl"), "a int").collect()


def test_atlas_episode_csv_optional_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"missions": [{"mission": "m", "anomalies": [{"symptom": "s", "human_turns_to_diagnosis": -1}]}, {"mission": "n"}]}))
    assert rows(readers.read_atlas(spark, str(tmp_path / "a.json")).select("mission", "symptom", "human_turns_to_diagnosis")) == [("m", "s", None)]
    (tmp_path / "e.json").write_text(json.dumps({"episode_id": "e", "input_utterances": [{"get": "1:2:3", "text": "hi", "verified": True}]}))
    assert rows(readers.read_episode(spark, str(tmp_path / "e.json")).select("turn", "text")) == [(1, "hi")]
    (tmp_path / "x.csv").write_text("a,b\n1,true\n")
    assert rows(readers.read_csv(spark, str(tmp_path / "x.csv"))) == [("1", "true")]
    assert rows(readers.optional(spark, lambda: readers.read_csv(spark, str(tmp_path / "none.csv")), "a string")) == []
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "big.pdf").write_text("xxxx")
    (tmp_path / "small.pdf").write_text("x")
    assert [r["length"] for r in readers.list_files(spark, str(tmp_path)).collect()] == [1, 4]
    (tmp_path / "p.log").write_text("VDD_IN 7000mW x\nnoise\nVDD_IN 9000mW\n")
    assert rows(readers.read_power_log(spark, str(tmp_path / "p.log"))) == [(8.0, 9.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_doc string, n int")
    sinks.append_lines(df, str(tmp_path / "l"))
    sinks.append_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    sinks.write_csv(df, str(tmp_path / "c"), ["n", "source_doc"])
    assert readers.read_csv(spark, str(tmp_path / "c")).columns == ["n", "source_doc"]
    sinks.checkpoint_documents(df, str(tmp_path / "k"))
    sinks.checkpoint_documents(spark.createDataFrame([("b", 3)], "source_doc string, n int"), str(tmp_path / "k"))
    assert sorted(rows(spark.read.parquet(str(tmp_path / "k")).select("source_doc", "n"))) == [("a", 1), ("b", 3)]
    assert sinks.markdown(df.orderBy("n")).splitlines()[2] == "| a | 1 |"
    with pytest.raises(ValueError):
        sinks.markdown(df, 1)


SEGMENTS = [
    (0, "the main bus voltage dropped because the bus relay stuck open again", "", "relay", "m1", ["bus relay stuck"]),
    (1, "cabin pressure valve leak procedure close the valve and check the seal", "", "valve", "m2", ["pressure leak"]),
    (2, "antenna pointing loss requires manual steering toward earth first", "", "antenna", "m3", []),
    (3, "computer program restarts after an overflow within the executive list", "", "computer", "m3", []),
    (4, "fuel quantity gauge readings drift while tanks settle slowly", "", "gauge", "m3", []),
]
SCHEMA = "ord long, raw_text string, signature string, component string, source_doc string, symptoms array<string>"


def test_diagnosis(spark):
    seg = spark.createDataFrame(SEGMENTS, SCHEMA)
    edges = spark.createDataFrame([(0, 1, 1)], "src long, dst long, seq int")
    ask = spark.createDataFrame([(1, "relay trouble and a short of voltage"), (2, "the rover stopped"), (3, "zzz")], "query_id int, symptom string")
    got = {r["query_id"]: r for r in diagnose.diagnose_chains(ask, seg, edges).collect()}
    assert not got[1]["declined"] and got[1]["n_chains"] == 1 and "[C1.1]" in got[1]["answer"]
    assert got[2]["declined"] and got[2]["gate_term"] == "rover"
    assert got[3]["declined"] and got[3]["gate_term"] is None
    lead = diagnose.diagnose_points(ask, seg).where("query_id = 1").first()
    assert lead["n_grounded"] == 1 and lead["diagnosis"].startswith("1. ")
    skipped = diagnose.diagnose_points(ask, seg, generate=lambda p, t: "SKIP")
    assert [(r["declined"], r["n_points"]) for r in skipped.collect()] == [(True, 0)] * 3  # every symptom has a row
    inferred = diagnose.diagnose_points(ask, seg, generate=lambda p, t: "relay stuck open").where("query_id = 1").first()
    assert inferred["n_inferred"] == 1 and "inferred" in inferred["diagnosis"]


def test_generator_guard():
    assert diagnose.require_local("http://localhost:1")
    with pytest.raises(ValueError):
        diagnose.require_local("http://example.org")
    calls = []

    def flaky(p, t):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert diagnose.with_retries(flaky)("p", "t") == "ok" and len(calls) == 3


def test_stream_equals_batch_and_latches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"session":"s","turn":1,"text":"bus fell"}\n{"session":"s","turn":2,"text":"the rover too"}\n')
    (src / "2.json").write_text('{"session":"s","turn":3,"text":"bus again"}\n')
    stream = spark.readStream.schema("session string, turn long, text string").option("maxFilesPerTrigger", 1).json(str(src))
    q = session_stream(stream).writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(rows(spark.table("said").select("turn", "transcript", "gate_term")))
    assert got[0] == (1, "bus fell", None) and got[1][2] == "rover" and got[2] == (3, "bus fell the rover too bus again", "rover")


def test_resume_sink(spark, tmp_path):
    write = resume_sink(str(tmp_path / "out"), ["k"])
    write(spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int"), 0)
    write(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), 1)
    assert sorted(rows(spark.read.json(str(tmp_path / "out")).select("k"))) == [("a",), ("b",)]
    nested = resume_sink(str(tmp_path / "nested"), ["k"])
    for n in range(2):
        nested(spark.createDataFrame([("a", [("x", n)])], "k string, v array<struct<name: string, n: int>>"), n)
    assert rows(spark.read.json(str(tmp_path / "nested")).selectExpr("k", "v[0].n")) == [("a", 0)]
