import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables to a folder that queries take as sf_dir."""

    def write(folder="t", **named):
        base = tmp_path / folder
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{base}/{name}.parquet")
        return str(base)

    return write


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


_r = random.Random(1)
WORDS = ["".join(_r.choice("abcdefghilmnorstu") for _ in range(_r.randint(3, 8))) for _ in range(400)]


def documents(n=60, seed=2):
    """Plain, empty, null, repeated, very long and copied texts; null and repeated ids."""
    rng = random.Random(seed)
    out = [(i, sentence(rng, rng.randint(1, 60)), "en", f"src{i % 5}", 0) for i in range(n)]
    out[3] = (3, "", "en", "src1", 0)
    out[4] = (4, None, None, None, None)
    out[5] = (None, "no id at all here", "en", None, 1)
    out[6] = (None, None, None, "src2", 1)
    out[7] = out[8]
    out[9] = (9, sentence(rng, 3000), "fr", "src0", 5)
    out[10] = (10, "É ä 日本語 𝄞 token=abcdefgh", "de", "src0", 5)
    for i in range(20, 30):
        out[i] = (i, out[20][1], "en", "src0", 0)
    return out
