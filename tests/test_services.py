"""Model sessions, telemetry beside runs, and figures gathered in passing."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import analysis, filters
from tidemark.plans import model
from tidemark.streaming import telemetry


@pytest.fixture
def server():
    """A model server that counts its requests; prompts say how it answers."""
    seen, lock = Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text, load = body["messages"][-1]["content"], body["options"]["num_predict"] == 1
            kind = ("preload" if body["keep_alive"] else "unload") if load else text
            with lock:
                seen[kind] += 1
                nth = seen[kind]
            code = 429 if text == "busy" and nth < 3 else 503 if text == "down" else 400 if text == "bad" else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"message": {"content": "" if text == "mute" else f"re {text}"}}).encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_waits_double_on_busy_and_failing_servers(server):
    url, seen = server
    waits = []
    with model.Session(model.Model(url), waits.append) as s:
        assert s.loaded and s.chat("hello") == "re hello"
        assert s.chat("busy") == "re busy" and waits == [1.0, 2.0]
        with pytest.raises(OSError, match="503"):
            s.chat("down")
        assert waits[2:] == [1.0, 2.0, 4.0, 8.0]
        with pytest.raises(OSError, match="400"):
            s.chat("bad")
    assert seen["down"] == 5 and seen["bad"] == 1 and seen["preload"] == seen["unload"] == 1
    with pytest.raises(ValueError, match="local"):
        model.Session(model.Model("http://example.org"))


def test_each_task_loads_the_model_once(spark, server):
    url, seen = server
    texts = [f"q{i}" for i in range(40)] + ["bad", "mute", "busy"]
    prompts = spark.createDataFrame([(str(i), t, "T") for i, t in enumerate(texts)], "key string, prompt string, tag string").repartition(3)
    got = {r["prompt"]: (r["answer"], r["failure"]) for r in model.asked(prompts, model.Model(url)).collect()}
    assert seen["preload"] == seen["unload"] == 3
    assert got["q7"] == ("re q7", None) and got["busy"] == ("re busy", None)
    assert got["bad"] == ("(generation unavailable: HTTPError)", "HTTPError: HTTP Error 400: Bad Request") and got["mute"][1] == "empty: no text"
    failed = spark.createDataFrame([(f,) for _, f in got.values()], "failure string")
    assert sorted(rows(analysis.failure_reasons(failed, "failure"))) == [("HTTPError", 1), ("empty", 1)]
    assert model.asked(prompts.limit(0), model.Model(url)).count() == 0 and seen["preload"] == 3


RUNS = [("a", 100, 110), ("b", 110, 130), ("c", 500, 505), ("d", 600, 2000)]
LINES = [(99, 1000), (100, 7000), (109, 9000), (110, 5000), (129, 6000), (130, 1), (503, 8500), (650, 4000), (1900, 100)]


def timed(spark, what, kind):
    df = spark.createDataFrame(what, kind)
    return df.select(*[F.timestamp_seconds(c).alias(c) if c in ("started", "ended", "at") else c for c in df.columns])


def test_power_of_runs_on_tables(spark):
    runs = timed(spark, RUNS + [("e", 3000, 3001)], "run string, started long, ended long")
    lines = timed(spark, LINES, "at long, mw long").withColumn("value", F.format_string("RAM 1/2 VDD_IN  %dmW x", "mw")).unionByName(
        timed(spark, [(101, 0)], "at long, mw long").withColumn("value", F.lit("noise")))
    got = telemetry.power_summary(runs, telemetry.readings_of_runs(runs, telemetry.power_readings(lines)))
    assert sorted(rows(got)) == [("a", True, 2, 8.0, 9.0, 7.0), ("b", True, 2, 5.5, 6.0, 5.0), ("c", True, 1, 8.5, 8.5, 8.5), ("d", True, 1, 4.0, 4.0, 4.0), ("e", False, 0, None, None, None)]


def test_power_of_runs_on_streams_drops_late_readings_only(spark, tmp_path):
    step = [0]

    def arrive(runs, readings):
        step[0] += 1
        timed(spark, runs, "run string, started long, ended long").coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
        timed(spark, readings, "at long, watts double").coalesce(1).write.mode("append").parquet(str(tmp_path / "readings"))

    def read():
        runs = spark.readStream.schema("run string, started timestamp, ended timestamp").parquet(str(tmp_path / "runs"))
        readings = spark.readStream.schema("at timestamp, watts double").parquet(str(tmp_path / "readings"))
        q = telemetry.readings_of_runs(runs, readings, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    arrive([("a", 100, 110)], [(101, 1.0), (150, 2.0)])
    read()
    # A reading of the first run that comes within the watermark's delay, and a run that comes after its reading.
    arrive([("b", 145, 160)], [(105, 3.0), (152, 4.0)])
    read()
    arrive([("c", 1000, 1010)], [(1005, 5.0)])
    read()
    arrive([("d", 1020, 1030)], [(107, 6.0), (1025, 7.0)])  # the first is late by hundreds of seconds
    read()
    got = sorted(rows(spark.read.parquet(str(tmp_path / "out")).select("run", "watts")))
    assert ("a", 6.0) not in got and {("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", 5.0), ("d", 7.0)} <= set(got)
    runs, readings = spark.read.parquet(str(tmp_path / "runs")), spark.read.parquet(str(tmp_path / "readings"))
    batch = sorted(rows(telemetry.readings_of_runs(runs, readings, 60).select("run", "watts")))
    assert set(got) <= set(batch) and set(batch) - set(got) <= {("a", 3.0), ("a", 6.0)}


def test_ingest_figures_come_with_the_filter(spark):
    text = "the main bus voltage dropped because the relay stuck open again and again"
    data = [(text, "EPS", ["x"], 90.0, None), (text, "", [], 60.0, "http: 500"), ("too short", None, None, None, "json: bad"), (text, "ECS", None, 80.0, "odd")]
    df = spark.createDataFrame(data, "raw_text string, subsystem string, symptoms array<string>, ocr_confidence double, failure string")
    kept, figures = filters.counted_corpus(df, reasons=("http", "json"))
    assert len(kept.collect()) == 3
    got = figures()
    assert got.pop("mean_confidence") == pytest.approx(230 / 3)
    assert got == {
        "n_segments": 4, "n_kept": 3, "n_dropped": 1, "n_subsystem": 2, "n_symptoms": 1, "n_low": 1, "n_failures": 3,
        "failures_http": 1, "failures_json": 1, "failures_other": 1,
    }
    bare, figures = filters.counted_corpus(df.select("raw_text").limit(0))
    assert bare.collect() == [] and figures()["n_dropped"] == 0
