"""Ordered sessions, the utterance source and exactly-once commits."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import sessions
from tidemark.sources.utterances import UtteranceReader, UtteranceSource
from tidemark.streaming import commits
from tidemark.streaming.ordered import STORE, ordered_sessions

UTTERANCE = "session string, turn long, text string, at timestamp"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drained(spark, tmp_path, files, delay, idle_ms=None):
    """Output rows of a stream that takes one file a micro-batch."""
    for k, part in enumerate(files):
        df = spark.createDataFrame(part, "session string, turn long, text string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if not f.name.startswith("k"):
                os.rename(f, tmp_path / "in" / f"k{k:03}.parquet")
                os.utime(tmp_path / "in" / f"k{k:03}.parquet", (k, k))
    stream = spark.readStream.schema(UTTERANCE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ordered_sessions(stream, delay, idle_ms).writeStream.format("memory").queryName("drained").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("drained").collect()


def test_shuffled_arrival_gives_the_ordered_result(spark, tmp_path, rocks):
    rng = random.Random(5)
    spoken = [(f"s{s}", t, rng.choice(["valve stuck", "pressure low", None, "the rover stopped", "fan noise", ""]), 100 + 10 * t + s) for s in range(4) for t in range(6)]
    mixed = spoken[:]
    rng.shuffle(mixed)
    files = [mixed[i : i + 8] for i in range(0, 24, 8)] + [[("end", 0, "x", 100_000)], [("end", 1, "y", 100_001)]]
    got = [tuple(r) for r in drained(spark, tmp_path, files, "1000 seconds") if r["session"] != "end"]
    batch = spark.createDataFrame(spoken, "session string, turn long, text string, s long")
    want = {(r["session"], r["turn"]): r["transcript"] for r in sessions.cumulative(batch.withColumn("text", F.coalesce("text", F.lit(""))), "session", "turn", "text").collect()}
    assert len(got) == 24 and {(s, t): x for s, t, x, _ in got}.keys() == want.keys()
    for s, t, transcript, gate in got:
        assert transcript.split() == want[s, t].split()
        assert (gate is not None) == ("rover" in want[s, t])
    for s in {g[0] for g in got}:
        assert [t for x, t, _, _ in got if x == s] == list(range(6))


def test_late_rows_are_dropped_and_idle_sessions_begin_anew(spark, tmp_path, rocks):
    files = [[("a", 1, "one", 10)], [("b", 1, "x", 500)], [("b", 2, "x", 501), ("a", 2, "too late", 11)], [("a", 3, "anew", 900)], [("b", 3, "y", 2000)], [("b", 4, "y", 2001)]]
    got = drained(spark, tmp_path, files, "5 seconds", idle_ms=100_000)
    assert [(r["turn"], r["transcript"]) for r in got if r["session"] == "a"] == [(1, "one"), (3, "anew")]


def test_store_is_asked_for(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        ordered_sessions(spark.createDataFrame([], UTTERANCE))


def test_utterances_survive_restarts(spark, tmp_path):
    spark.dataSource.register(UtteranceSource)
    path, out, check = tmp_path / "crew.txt", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.format("utterances").option("path", str(path)).option("most_bytes", 12).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
        return sorted(rows(spark.read.parquet(out).select("session", "turn", "text")))

    path.write_bytes("\n  first one \nsecond é\n\n\nother".encode())
    assert run() == [(1, 1, "first one"), (1, 2, "second é")]
    with path.open("ab") as f:
        f.write("\nagain, a line that is longer than a batch\n\nlast\n".encode())
    want = [(1, 1, "first one"), (1, 2, "second é"), (2, 1, "other"), (2, 2, "again, a line that is longer than a batch"), (3, 1, "last")]
    assert run() == want
    assert run() == want


def test_utterance_offsets_repeat_what_was_read(tmp_path):
    path = tmp_path / "u.txt"
    path.write_text("a\nb\n\nc\nd")
    reader = UtteranceReader(str(path), 4)
    at, seen = reader.initialOffset(), []
    while True:
        got, end = reader.read(at)
        got = list(got)
        if not got:
            break
        assert list(reader.readBetweenOffsets(at, end)) == got
        seen, at = seen + got, end
    assert seen == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    assert list(UtteranceReader(str(tmp_path / "none"), 4).read({"byte": 0, "session": 1, "turn": 1})[0]) == []


def test_commits_are_published_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    sink = commits.exactly_once_sink(path, ["id"])
    df = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    sink(df(1, 2, 2), 0)
    sink(df(1, 2), 0)
    sink(df(2, 3), 1)
    # A writer that dies between its parts and its entry.
    log = commits.CommitLog(spark, path)

    def dies(folder):
        df(4, 5).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(folder)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        log.publish(2, dies)
    read = lambda: sorted(rows(commits.published_rows(spark, path, "id long, text string")))
    assert read() == [(1, "t1"), (2, "t2"), (3, "t3")] and len(log.orphans()) == 1
    sink(df(4, 5, 1), 2)
    assert read() == [(1, "t1"), (2, "t2"), (3, "t3"), (4, "t4"), (5, "t5")]
    assert log.orphans(delete=True) and not log.orphans() and len(read()) == 5
    # Two writers of one commit: the second finds the entry when it comes to place its own.
    assert log.publish(3, lambda folder: sink(df(6), 3) or df(7).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(folder)) is False
    assert read()[-1] == (6, "t6")


def test_commits_follow_a_stream(spark, tmp_path):
    path, source = str(tmp_path / "log"), str(tmp_path / "in")
    write = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id long, text string").write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("id long, text string").parquet(source)
        stream.writeStream.foreachBatch(commits.exactly_once_sink(path, ["id"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in commits.published_rows(spark, path, "id long, text string").collect())

    write(1, 2)
    assert run() == [1, 2]
    write(2, 3)
    assert run() == [1, 2, 3] and run() == [1, 2, 3]


def test_documents_and_manifest_go_together(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "source_doc string, n long"
    put = lambda *r, **k: commits.publish_documents(spark.createDataFrame(r, schema), path, **k)
    assert put(("a", 1), ("a", 2), ("b", 3)) and put(("b", 4), status="failed") and put((None, 5))
    kept, manifest = commits.published_documents(spark, path, schema)
    assert {(r["source_doc"], r["n"]) for r in kept.collect()} >= {("a", 1), ("a", 2), ("b", 4)} and kept.where("n = 3").isEmpty()
    assert defaultdict(str, {r["doc"]: r["status"] for r in manifest.collect()}) == {"a": "done", "b": "failed", None: "done"}
    assert commits.published_documents(spark, str(tmp_path / "none"), schema)[0].count() == 0
