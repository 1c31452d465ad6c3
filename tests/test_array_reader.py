"""A JSON array read by many tasks."""

import json
import random

import pytest

from tidemark.sources import readers

TEXTS = ["plain", "", 'quote " and \\ back', "}, {not an end}, [", "line\nend\t}", "é 日本 \\\\", '"},"', "]", None]


def segments(n):
    rng = random.Random(n)
    out = []
    for i in range(n):
        links = [rng.choice(TEXTS) or "x" for _ in range(rng.randint(0, 3))]
        s = {"id": f"s{i}", "raw_text": rng.choice(TEXTS), "links_to": links, "extra": [{"a": {"b": "}, "}}, {"c": [1, 2]}], "component": "c" * rng.randint(0, 300)}
        out.append({k: v for k, v in s.items() if rng.random() < 0.9})
    return out


@pytest.fixture
def split_bytes(spark):
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("n, indent", [(0, None), (1, None), (60, None), (60, 2)])
def test_any_split_gives_the_same_places(spark, tmp_path, split_bytes, n, indent):
    path = str(tmp_path / "c.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(segments(n), indent=indent, ensure_ascii=n % 2 == 0) + ("\n" if indent else ""))
    want = sorted(map(tuple, readers.read_corpus(spark, path).collect()), key=lambda r: r[0])
    assert len(want) == n
    for size in (1 << 27, 700, 101):
        split_bytes(size)
        got = readers.read_corpus_split(spark, path)
        if n and size == 101:
            assert spark.read.text(path, lineSep="},").rdd.getNumPartitions() > (20 if n > 1 else 1)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
