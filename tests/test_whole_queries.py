"""Queries over whole tables that have no SQL, against brute force."""

from collections import defaultdict

from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import text as T
from tidemark.operators import evals

from conftest import rows

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_coverage_walks_from_every_document(spark, tmp_path):
    docs = [(i, " ".join(f"pump{LETTERS[i * k % 17]} valve{LETTERS[(i + k) % 23]}" for k in range(1, 6)), "en", "s", 0) for i in range(70)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    listed = df.select(F.col("doc_id").alias("ord"), T.content_terms(F.col("text")).alias("terms"))
    terms = {o: set(t) for o, t in rows(listed)}
    idf = dict(rows(evals.idf_table(listed, F.col("terms")).select("tok", "idf")))
    edges = defaultdict(list)
    for e in queries._doc_edges(spark, d).collect():
        edges[e["src"]].append((e["seq"], e["dst"]))
    want = {}
    for entry in terms:
        path, covered = [entry], set(terms[entry])
        for _ in range(2):
            found = [(-round(sum(idf[t] for t in terms[n] - covered), 9), seq, n) for seq, n in edges[path[-1]] if n in terms and n not in path]
            found = sorted(x for x in found if x[0] < 0)
            if not found:
                break
            path.append(found[0][2])
            covered |= terms[path[-1]]
        want[entry] = ">".join(map(str, path))
    assert dict(rows(queries.QUERIES["chase_coverage"](spark, d))) == want and len(want) == 70
    assert any(">" in p for e, p in want.items() if e >= 40)


def test_positions_take_every_supplier(spark, tmp_path):
    nations = [(f"n{i:02}", i % 2) for i in range(12)]
    suppliers = [(i, f"s{i}") for i in range(45)]
    spark.createDataFrame(nations, "n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    want = [(g, n, f"s{g + 7 * k}" if g + 7 * k < 45 else None) for g in (0, 1) for k, n in enumerate(x for x, r in nations if r == g)]
    assert sorted(rows(queries.QUERIES["positional_join"](spark, str(tmp_path)))) == sorted(want)
    assert sum(w[2] is not None for w in want) > 6
