"""Top-k, classifiers, decontamination, near duplicates, urls and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from llm.conftest import SCHEMA, documents, sentence
from tidemark.llm import _mixed, components, decontamination, mixing, neardup, quality, sharding, similar, topk, toxicity, urls
from tidemark.operators import ranks

VECTORS = "vec_id long, embedding array<float>, label int"


def test_topk_against_brute_force(spark, tables):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) if rng.random() < 0.8 else 0.0 for _ in range(8)], 0) for i in range(900)]
    for i in range(100, 400):
        rows[i] = (i, rows[100][1], 0)  # ties
    rows += [(7, rows[7][1], 0), (2000, None, 0), (2100, [1.0, None], 0), (2200, [float("nan")] * 8, 0), (2300, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (2500, [], 0), (2600, [0.5], 0)]
    d = tables(embeddings=(rows, VECTORS))
    got = defaultdict(list)
    for r in topk.op3_topk(spark, d).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:10]
            assert got.pop(q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    assert topk.op3_topk(spark, tables("none", embeddings=([], VECTORS))).count() == 0


def test_topk_in_many_blocks_is_the_same(spark, tables):
    rng = random.Random(4)
    d = tables(embeddings=([(i, [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(700)], VECTORS))
    v = topk.scaled(spark.read.parquet(f"{d}/embeddings.parquet"))
    q = v.where("vec_id % 100 = 0")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(topk.top_k(v, q, block=50, query_block=2)) == key(topk.top_k(v, q))


LABELS = "doc_id long, quality int, toxic int"


def labelled(n=500):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        text = sentence(rng, 40)
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text = " | ".join(w + "$$$" for w in text.split())
        if rude:
            words = text.split(" ")
            words[rng.randrange(len(words))] = rng.choice(["vilexo", "vilexa", "vilexi", "Gromp"])
            text = " ".join(words)
        docs.append((i, text, "en", "s", 0))
        labels.append((i, int(not bad), int(rude)))
    docs += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "some words", "en", "s", 0), (0, docs[0][1], "en", "s", 0), (n + 2, sentence(rng, 4000), "en", "s", 0)]
    labels += [(None, 1, 1), (1, None, None), (n + 50, 1, 0)]
    return docs, labels


@pytest.mark.parametrize(("op", "column", "cut"), [(quality.op9_quality, 1, 0.3), (toxicity.op4_toxicity, 2, 0.5)])
def test_classifiers_learn_and_hold_out(spark, tables, op, column, cut):
    docs, labels = labelled()
    d = tables(documents=(docs, SCHEMA), labels=(labels, LABELS))
    got = op(spark, d).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in docs)
    truth = {x[0]: x[column] for x in labels}
    right = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and truth.get(r["doc_id"]) is not None:
            right.append(r["predicted"] == truth[r["doc_id"]])
    assert len(right) > 60 and sum(right) / len(right) > 0.9
    # Held-out labels change nothing.
    flipped = [(i, *(v if v is None or zlib.crc32(str(i).encode()) % 5 else 1 - v for v in rest)) for i, *rest in labels]
    again = op(spark, tables("flip", documents=(docs, SCHEMA), labels=(flipped, LABELS))).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


@pytest.mark.parametrize("op", [quality.op9_quality, toxicity.op4_toxicity])
def test_classifiers_without_labels_or_rows(spark, tables, op):
    assert op(spark, tables(documents=([], SCHEMA), labels=([], LABELS))).count() == 0
    assert op(spark, tables("unlabelled", documents=(documents(), SCHEMA), labels=([], LABELS))).count() == 60


def test_scores_do_not_depend_on_batches():
    docs, _ = labelled(40)
    texts = [d[1] for d in docs]
    w = np.random.default_rng(0).normal(size=quality.BUCKETS)
    whole = quality.scores(pa.array(texts), w, 0.1)
    assert whole == pytest.approx([quality.scores(pa.array([t], pa.string()), w, 0.1)[0] for t in texts])
    net = toxicity.Net()
    cuts = np.zeros(len(toxicity.FUNCTION_WORDS) + 1)
    whole = toxicity.scores(pa.array(texts), net, cuts)
    assert whole == pytest.approx([toxicity.scores(pa.array([t], pa.string()), net, cuts)[0] for t in texts], abs=1e-5)


BENCH = "item_id long, text string"


def test_leaks_are_found_and_clean_documents_left(spark, tables):
    rng = random.Random(12)
    items = [(i, sentence(rng, rng.randint(15, 60))) for i in range(40)] + [(90, "one two"), (91, ""), (92, None), (5, "again a five"), (93, "École À côté des champs élevés où l'on dort")]
    docs, want = documents(), set()
    for k in range(100, 140):
        item, text = items[k - 100]
        changed = text.split()
        if k % 3 == 1:
            changed[0] = "changedword"  # an edit at the edge loses one shingle
        if k % 3 == 2:
            changed = [w.upper() + "!!" for w in changed]
        docs.append((k, sentence(rng, 30) + " " + " ".join(changed) + ".\n" + sentence(rng, 30), "en", "s", 0))
        want.add((k, item))
    docs += [(300, "see one two three", "en", "s", 0), (301, "ÉCOLE À CÔTÉ DES CHAMPS ÉLEVÉS OÙ L'ON DORT", "fr", "s", 0), (302, items[0][1], "en", "s", 0), (302, items[0][1], "en", "s", 0)]
    want |= {(300, 90), (301, 93), (302, 0)}
    d = tables(documents=(docs, SCHEMA), benchmark=(items, BENCH))
    got = decontamination.op7_decontamination(spark, d).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["similarity"] >= 0.8 for r in got)
    assert sum(r["doc_id"] == 302 for r in got) == 2
    kept = decontamination.drop_contaminated(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(x[0] for x in docs if x[0] not in {k for k, _ in want})
    assert decontamination.op7_decontamination(spark, tables("none", documents=(docs, SCHEMA), benchmark=([], BENCH))).count() == 0
    assert decontamination.op7_decontamination(spark, tables("empty", documents=([], SCHEMA), benchmark=(items, BENCH))).count() == 0


def test_windows_against_brute_force():
    """Every window of every text, scored exactly: the search finds the same items."""
    rng = random.Random(13)
    items = [(i, sentence(rng, rng.randint(6, 20))) for i in range(12)]
    index = decontamination.Index(items)
    for k in range(40):
        words = sentence(rng, 25).split()
        own = items[k % 12][1].split()
        if k % 2:
            own[-1] = "edited"
        text = " ".join(words[:12] + own + words[12:])
        w, _ = decontamination.words_of(*decontamination.folded(pa.array([text])))
        want = {
            i for i in range(12) for s in range(len(w) - len(index.words[i]) + 1)
            if index.similarity(w[s : s + len(index.words[i])], i) >= 0.8
        }
        got = {i for _, found in index.search(pa.array([text])) for i, _, _ in found}
        assert got == want


@pytest.mark.parametrize("length", [15, 60, 100, 200, 400, 800, 1500])
def test_no_passage_alike_in_eight_tenths_is_missed(length):
    """Items of distinct words with a run replaced, about the edge of 0.8, alone and within a text."""
    rng = random.Random(length)
    fresh = iter(range(10**7))
    items = [(i, " ".join(f"w{next(fresh)}" for _ in range(length))) for i in range(12)]
    index = decontamination.Index(items)
    tried = 0
    for i, text in items:
        words = text.split()
        for share in (0.04, 0.1, 0.14, 0.16, 0.18, 0.195, 0.2):
            run = max(1, round(length * share))
            at = rng.randrange(length - run + 1)
            changed = words[:at] + [f"x{next(fresh)}" for _ in range(run)] + words[at + run :]
            around = [f"y{next(fresh)}" for _ in range(80)]
            for whole, first in ((changed, 0), (around + changed + around, 80)):
                got, _ = decontamination.words_of(*decontamination.folded(pa.array([" ".join(whole)])))
                best = max(index.similarity(got[s : s + length], i) for s in range(max(0, first - 5), min(first + 5, len(got) - length) + 1))
                found = {item for _, found in index.search(pa.array([" ".join(whole)])) for item, _, sim in found}
                if best >= 0.8:
                    assert i in found
                    tried += 1
                assert found <= {i}
    assert tried > (15 if length < 60 else 40)


def test_slices_of_the_benchmark_change_nothing(spark):
    rng = random.Random(12)
    common = sentence(rng, 8)
    items = [(i, sentence(rng, 12) + " " + common + " " + sentence(rng, 6)) for i in range(30)] + [(90, None), (91, ""), (92, "one")]
    docs = [(i, sentence(rng, 20) + " " + " ".join(x if rng.random() < 0.97 else "other" for x in (items[i % 30][1] or "").split()), "en", "s", 0) for i in range(60)]
    bench, docs = spark.createDataFrame(items + items[:3], BENCH), spark.createDataFrame(docs, SCHEMA)
    found = []
    for size in (700, 1500, decontamination.SLICE_BYTES):
        parts = decontamination.indexes(bench, size)
        found.append(sorted(tuple(r) for index in parts for r in decontamination.find_leaks(docs, index).collect()))
    assert found[0] == found[1] == found[2] and 20 < len(found[0])


def brute_components(docs):
    fps = []
    for d in docs:
        w = (d[1] or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = defaultdict(list)
    for d, g in zip(docs, group):
        if d[0] is not None:
            least[g].append(d[0])
    return [(d[0], f"{f:016x}", min(least[g], default=None)) for d, f, g in zip(docs, fps, group)], group


def brute_similar(docs, least=0.8):
    """Group of each document by 5-word shingle similarity; texts without a word are alike."""
    sets = []
    for d in docs:
        w = (d[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {None})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def kept_of(docs, group):
    best = {}
    for x, g in zip(docs, group):
        if x[0] is not None:
            best[g] = min(best.get(g, x[0]), x[0])
    return sorted(best.values())


def near_copies():
    rng = random.Random(21)
    docs = documents()
    base = sentence(rng, 500).split()
    for k in range(40):
        copy = list(base)
        copy[rng.randrange(500)] = "changed"
        docs.append((400 - k, " ".join(copy), "en", "s", 0))
    return docs


def test_near_duplicates_against_brute_force(spark, tables):
    docs = near_copies()
    d = tables(documents=(docs, SCHEMA))
    got = neardup.op8_simhash(spark, d).collect()
    want, _ = brute_components(docs)
    assert Counter(map(tuple, got)) == Counter(want)
    docs += [(500 + k, docs[9][1] + f" tail{k} words of its own {k}", "en", "s", 0) for k in range(30)]
    docs += [(600, " ".join(docs[9][1].split()[:1200]), "en", "s", 0)]  # alike in 0.4: stays
    d, group = tables("near", documents=(docs, SCHEMA)), brute_similar(docs)
    kept = similar.drop_near_duplicates(spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert len(kept) == len(set(group))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == kept_of(docs, group)
    assert similar.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neardup.op8_simhash(spark, tables("none", documents=([], SCHEMA))).count() == 0


def kept_ids(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    return sorted(r["doc_id"] for r in similar.drop_near_duplicates(docs).collect())


def test_copies_farther_from_each_other_than_from_their_base(spark):
    """A base and 1,000 copies, each 0.811 alike to it and mostly 0.65 to the others: one stays."""
    rng = random.Random(31)
    base = [f"word{k}" for k in range(100)]
    texts = [" ".join(base)]
    for k in range(1000):
        copy, at = list(base), rng.randrange(5, 85)
        copy[at], copy[rng.randrange(at + 5, 95)] = f"one{k}", f"two{k}"
        texts.append(" ".join(copy))
    assert kept_ids(spark, texts) == [0]


def test_blocks_lose_no_link(spark):
    """Groups cut into many blocks, with large parts of their own, against all pairs."""
    rng = random.Random(32)
    bases = [rng.sample(range(10000), 40) for _ in range(6)]
    sets = [sorted(set(bases[k % 6]) - set(rng.sample(bases[k % 6], rng.randrange(8))) | set(rng.sample(range(10000), rng.randrange(4)))) for k in range(90)]
    part = [k if k % 6 or k > 60 else 0 for k in range(90)]  # one large part, the rest by themselves
    links = spark.createDataFrame([(k, k + 2) for k in range(88)], "a long, b long")
    roots = spark.createDataFrame([(k, 0) for k in range(90) if part[k] == 0], "node long, root long")
    sizes = spark.createDataFrame([(k, len(x)) for k, x in enumerate(sets)], "node long, size int")
    held = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    more = similar.missed_links(links, roots, sizes, held, 0.8, 4)
    got = dict(map(tuple, components.connected_components(more).collect()))
    pairs = [(part[i], part[j]) for i in range(90) for j in range(i) if (i - j) % 2 == 0 and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
    want = components.least_roots(90, *np.array(pairs).T)
    assert [got.get(p, p) for p in part] == [want[p] for p in part] and len(set(want)) > 12


def test_pages_of_one_template_do_not_meet(spark):
    """2,000 half-alike sets, one group of candidates: no two share a rare shingle, so none is copied; alike ones still meet."""
    rng = random.Random(33)
    template = list(range(10**7, 10**7 + 100))
    sets = [(k, sorted(template + [2 * 10**7 + 60 * k + j for j in range(50)])) for k in range(2000)]
    twins = [(5000 + k, sorted(sets[k][1][:-8] + [3 * 10**7 + 10 * k + j for j in range(8)])) for k in range(30)]
    held = spark.createDataFrame(sets + twins, "node long, shingles array<long>")
    groups = defaultdict(list)
    for r in similar.rare_groups(held).collect():
        groups[r["group"]].append(r["node"])
    assert sorted(sorted(g) for g in groups.values()) == [[k, 5000 + k] for k in range(30)]
    links = spark.createDataFrame([(0, k) for k, _ in (sets + twins)[1:]], "a long, b long")
    none = spark.createDataFrame([], "node long, root long")
    more = similar.missed_links(links, none, held.selectExpr("node", "size(shingles) AS size"), held)
    assert sorted(tuple(sorted(r)) for r in more.collect()) == [(k, 5000 + k) for k in range(30)]


def test_rare_shingles_part_no_alike_sets(spark):
    rng = random.Random(34)
    bases = [rng.sample(range(300), 30) for _ in range(8)]
    sets = [sorted({1000 + x for x in bases[k % 8] if rng.random() < 0.93} | {1000 + x for x in rng.sample(range(300), rng.randrange(4))}) for k in range(200)]
    held = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    group = dict(map(tuple, similar.rare_groups(held).collect()))
    alike = [(i, j) for i in range(200) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
    assert all(group[i] == group[j] for i, j in alike) and len(alike) > 50


def test_whole_parts_are_not_compared(spark):
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, root long")
    sizes = spark.createDataFrame([(k, 5) for k in (1, 2, 3)], "node long, size int")
    assert similar.missed_links(links, roots, sizes, spark.createDataFrame([], "node long, shingles array<long>")) is None


def test_tiles_of_any_size_find_the_same(spark):
    """Candidates by tiles of 3 nodes and of all, against every pair of fingerprints."""
    rng = np.random.default_rng(6)
    sets = []
    for k in range(40):
        base = rng.integers(0, 2**64, int(rng.integers(4, 60)), dtype=np.uint64)
        sets += [base, base[: max(4, len(base) * 9 // 10)], np.append(base, rng.integers(0, 2**64, 1, dtype=np.uint64))]
    fps, sizes = np.stack([similar.fingerprint(h) for h in sets]), np.array([len(h) for h in sets])
    rows = [(k, int(sizes[k]), *map(int, fps[k].view(np.int64))) for k in range(len(sets))]
    nodes = spark.createDataFrame(rows, "node long, size int, w0 long, w1 long, w2 long, w3 long")
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(-1).astype(int)
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    near = (far <= np.where(small < 6, 77, 68)) & (5 * small >= 4 * large)
    want = components.least_roots(len(sets), *np.nonzero(near)).tolist()
    for tile in (3, 8192):
        roots = dict(map(tuple, components.connected_components(similar.candidate_links(nodes, len(sets), tile)).collect()))
        assert [roots.get(k, k) for k in range(len(sets))] == want


def test_pairs_at_the_edge_are_candidates():
    """Pairs of unequal and equal size alike in 0.8 lie within the radius."""
    rng = np.random.default_rng(7)
    for shared, a, b in ((4, 0, 1), (8, 1, 1), (12, 0, 3), (12, 2, 1), (20, 2, 3), (20, 5, 0), (80, 10, 10), (80, 0, 20), (400, 60, 40)):
        for _ in range(300):
            h = rng.integers(0, 2**64, shared + a + b, dtype=np.uint64)
            x, y = similar.fingerprint(h[: shared + a]), similar.fingerprint(np.append(h[:shared], h[shared + a :]))
            assert int(np.bitwise_count(x ^ y).sum()) <= (77 if shared < 6 else 68)


def test_shingle_sets():
    got = list(similar.shingle_sets(pa.array(["a b c d e f", "A  b\tc d e F", None, "", " ", "a b", "A b", "b a", "a b c d e f a b c d e f"])))
    assert [len(x) for x in got] == [2, 2, 0, 0, 0, 1, 1, 1, 6]
    assert (got[0] == got[1]).all() and (got[5] == got[6]).all() and got[5][0] != got[7][0] and set(got[0]) < set(got[8])


def test_equal_fingerprints_are_verified(spark):
    """A line repeated 40 times outvotes 100 shingles of each text's own; texts with equal sets are one."""
    line = " " + " ".join(f"line{k}" for k in range(11))
    texts = [" ".join(f"t{i}w{k}" for k in range(104)) + line * 40 for i in range(12)]
    assert kept_ids(spark, texts + [texts[3] + line * 3]) == list(range(12))


def test_repeats_of_a_line_do_not_part_copies(spark):
    """Sets alike in 0.96, one line once or 10 times: the fingerprints follow the sets."""
    line = " " + " ".join(f"line{k}" for k in range(12))
    texts = [" ".join(f"t{i}w{k}" for k in range(100)) + line * n for i in range(12) for n in (1, 10)]
    assert kept_ids(spark, texts) == list(range(0, 24, 2))


def test_short_copies(spark):
    """8 words and a ninth (exactly 0.8), 9 and 10, 16 and 19: every pair, however its bits fall."""
    words = [([f"n{n}t{i}w{k}" for k in range(m)], n) for n, m in ((8, 9), (9, 10), (16, 19)) for i in range(100)]
    texts = [" ".join(w[:k]) for w, n in words for k in (n, len(w))]
    texts += [" ".join(f"s{i}w{k}" for k in range(n)) for i in range(20) for n in (7, 8)]  # alike in 0.75: stay
    assert kept_ids(spark, texts) == [*range(0, 600, 2), *range(600, 640)]


def test_small_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 40 | 1), base ^ np.uint64(0b1111), base ^ np.uint64(0b11111 << 7)])).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    roots = dict(map(tuple, components.connected_components(neardup.near_links(nodes, 4, 3)).collect()))
    whole = components.least_roots(len(fps), *np.nonzero(np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 4))
    assert [roots.get(int(x), int(x)) for x in fps] == [int(fps[i]) for i in whole]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 75: 50, 100: 50}


def test_one_chunk_is_the_same_as_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (-3, 75)] + [(200, 201 + i) for i in range(40)], "a long, b long")
    one = sorted(map(tuple, components.connected_components(edges).collect()))
    monkeypatch.setattr(components, "CHUNK", 20)
    for hub in (5, components.HUB):
        monkeypatch.setattr(components, "HUB", hub)
        assert sorted(map(tuple, components.connected_components(edges).collect())) == one


URLS = [
    ("http://EXAMPLE.org/es/x", "example.org", "/es/x", "example.org/es/", "block"), ("https://a.example.org/en/12?q", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/en/2#z", "a.example.org", "/en/2", "org/", "allow"), ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"), ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://x.com/es/1", "x.com", "/es/1", None, "allow"),
    ("http://example.org", "example.org", "", None, "allow"), ("example.org/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"),
    ("http://h.net?a=/b", "h.net", "", None, "allow"), ("", "", "", None, "allow"),
]


def test_urls(spark, tables):
    rows = [(i, u, "h") for i, (u, *_) in enumerate(URLS)] + [(None, "http://x.com/de/", None)]
    got = {r["page_id"]: tuple(r)[1:] for r in urls.op10_urls(spark, tables(pages=(rows, "page_id long, url string, html string"))).collect()}
    assert got.pop(None) == ("x.com", "/de/", "com/de/", "block")
    assert got == {i: tuple(w) for i, (_, *w) in enumerate(URLS)}
    assert urls.op10_urls(spark, tables("none", pages=([], "page_id long, url string, html string"))).count() == 0


def test_trie_against_a_scan_of_the_rules():
    rng = random.Random(2)
    hosts, paths = ["a", "b.a", "c.b.a", "b"], ["/", "/x", "/x/", "/x/y", "/xy/", ""]
    for _ in range(300):
        rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(6)]
        host, path = rng.choice(hosts + ["d.c.b.a", "z"]), rng.choice(paths + ["/x/y/z", "/xyz"])
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: (r[1].count("."), len(r[2]), r[0] == "block"), default=None)
        assert urls.Trie(rules).match(host, path) == ((best[1] + best[2], best[0]) if best else (None, "allow"))


def test_pipeline_stage_by_stage(spark, tables):
    import corpus_pipeline

    docs, labels = labelled(300)
    docs = [x for x in docs if x[0] is not None]
    docs += [(900 + k, docs[k][1], "fr", f"s{k % 4}", 1) for k in range(40)]
    bench = [(1, " ".join(docs[50][1].split()[5:30])), (2, "never seen words at all in any text")]
    d = tables(documents=(docs, SCHEMA), labels=(labels, LABELS), benchmark=(bench, BENCH))
    read = lambda p: spark.read.parquet(p)
    cur = read(f"{d}/documents.parquet")
    model = quality.fit(cur, read(f"{d}/labels.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(steps) <= 5

    one = steps["quality classifier"](spark, cur, d).collect()
    texts = [x[1] for x in docs]
    good = quality.scores(pa.array(texts, pa.string()), quality._dense(quality._sparse(model[0])), model[1]) >= 0.3
    assert Counter(map(tuple, one)) == Counter(x for x, g in zip(docs, good) if g)

    two = steps["near duplicates"](spark, spark.createDataFrame(one, SCHEMA), d).collect()
    assert sorted(r["doc_id"] for r in two) == kept_of(one, brute_similar([tuple(x) for x in one]))

    three = steps["decontamination"](spark, spark.createDataFrame(two, SCHEMA), d).collect()
    assert {r["doc_id"] for r in two} - {r["doc_id"] for r in three} <= {50, 950}
    assert len(three) < len(two) or not {50, 950} & {r["doc_id"] for r in two}

    frame = spark.createDataFrame(three, SCHEMA)
    four = steps["mixing"](spark, frame, d).collect()
    per = Counter(r["doc_id"] for r in four)
    assert set(map(tuple, four)) <= set(map(tuple, three)) and max(per.values()) <= 3

    steps["mixing"](spark, frame, d).write.parquet(f"{d}/mixed")
    for mixed in (spark.createDataFrame(four, SCHEMA), read(f"{d}/mixed")):
        five = steps["sharding"](spark, mixed, d).collect()
        assert Counter(tuple(r)[:5] for r in five) == Counter(map(tuple, four))
        counts = Counter(r["shard"] for r in five)
        assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    assert corpus_pipeline.run(spark, d).count() == len(four)


def test_shards_keep_the_order_of_the_mix(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, sentence(rng, 20), "en", f"s{i % 3}", 0) for i in range(300)], SCHEMA)
    mixing.mix_documents(docs, 5).write.parquet(f"{tmp_path}/m")
    mixed = spark.read.parquet(f"{tmp_path}/m")
    at = {}  # the splitting tree's order: output shards, then the shuffle within
    for r in mixed.select("*", "_metadata.file_name", "_metadata.row_index").collect():
        at.setdefault(r["doc_id"], []).append((r["file_name"], r["row_index"]))
    assert len({f for v in at.values() for f, _ in v}) == 5
    got = sharding.shard_documents(mixed, 4).collect()
    twins = 0
    for s in range(4):
        own = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == s)
        assert [k for k, _ in own] == list(range(len(own)))
        twins += sum(a == b for (_, a), (_, b) in zip(own, own[1:]))
        files = []
        for _, doc in own:  # some non-decreasing choice of places exists
            files.append(min((p for p in at[doc] if not files or p > files[-1]), default=None))
            assert files[-1] is not None
    assert twins <= 3 and len(got) == sum(map(len, at.values())) > len(at)


def test_stages_take_clashing_columns_and_empty_tables(spark, tables, tmp_path):
    import corpus_pipeline

    extra = SCHEMA + ", shard string, slot string, row string, node string, h string, size string, words string, label string, `order` string"
    rows = [x + ("x",) * 9 for x in documents() + [(200 + i, f"t{i} " * 40, "en", "s", 0) for i in range(20)]]
    d = tables(labels=([], LABELS), benchmark=([], BENCH))
    for n, name in ((rows, "full"), ([], "none")):
        cur = spark.createDataFrame(n, extra)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, cur, d).write.parquet(f"{tmp_path}/{name}{k}")
            out = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert out.columns == cur.columns
            cur = out
        assert {"shard", "slot", "shard_input", "slot_input", "row", "order"} <= set(cur.columns)
        assert (cur.count() == 0) == (name == "none")
    d = tables("nothing", documents=([], SCHEMA), labels=([], LABELS), benchmark=([], BENCH))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_net_against_a_plain_forward_pass():
    net = toxicity.Net(5)
    net.bias += np.linspace(-0.2, 0.2, len(net.bias), dtype=np.float32)
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, toxicity.BUCKETS, (n, 1 + len(toxicity.PREFIXES))) for n in (1, 0, 2, 7, 40)]
    want = []
    for ids in docs:
        x = [sum(net.emb[i].astype(float) for i in word) for word in ids]
        logit = float(net.shift)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = k * toxicity.FILTERS + f
                # A filter may run over the end, where words are zero.
                sums = [sum(float(x[i + j] @ net.filters[k][j][:, f]) for j in range(width) if i + j < len(x)) for i in range(len(x))]
                logit += max(0.0, max(sums, default=0.0) + float(net.bias[at])) * float(net.out[at])
        want.append(logit)
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    assert net.logits(np.concatenate(docs), rows, len(docs)) == pytest.approx(want, abs=1e-4)


def test_leader_updates_one_by_one():
    """Every weight by the closed form of follow-the-regularised-leader, from plain sums over all updates."""
    rng = np.random.default_rng(9)
    texts = [(sorted(rng.choice(30, 6, replace=False).tolist()), rng.uniform(0.5, 3, 6).astype(np.float32).tolist()) for _ in range(25)]
    labels = [int(3 in k) for k, _ in texts]
    alpha, beta, l1, l2, passes, seed = 0.3, 1.0, 0.02, 0.5, 3, 5
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(texts)):
            x = dict(zip(*texts[i])) | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - labels[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    got, bias = quality.train(
        np.concatenate([k for k, _ in texts]), np.concatenate([np.float32(v) for _, v in texts]), np.arange(0, 6 * len(texts) + 1, 6), labels
    )
    assert got[:30] == pytest.approx([weight(k) for k in range(30)], abs=1e-9) and not got[30:].any()
    assert bias == pytest.approx(weight("bias"), abs=1e-9) and got[3] == max(got)


def test_scores_against_features_one_by_one():
    """A score is the bias and each feature's weight times its share, whatever else is in the batch."""
    texts = ["Plain words, plain words!", "x", "", None, "ÉTÉ && 42 -- a"]
    weights = np.random.default_rng(2).normal(size=quality.BUCKETS)
    want = []
    for t in texts:
        k, _ = quality.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
        shares = {b: 20.0 * c / len(k) for b, c in Counter(k.tolist()).items()}
        want.append(1 / (1 + math.exp(-(sum(weights[b] * s for b, s in shares.items()) + 0.3))))
    assert quality.scores(pa.array(texts), weights, 0.3) == pytest.approx(want)
    assert want[2] == want[3] == pytest.approx(1 / (1 + math.exp(-0.3)))


CLASHING = ("row", "size", "h", "words", "skey", "fp", "node", "at", "label", "shard", "slot", "copy", "order", "hash", "pos", "template", "row_", "n")


@pytest.mark.parametrize("op", ["op1_sharding", "op2_secrets", "op4_toxicity", "op5_mixing", "op6_licenses", "op7_decontamination", "op8_simhash", "op9_quality"])
def test_columns_with_clashing_names_change_no_result(spark, tables, op):
    from tidemark.llm.queries import QUERIES

    docs = documents() + [(70, "released under the mit license token=abcdefgh", "en", "s", 1)]
    rng = random.Random(3)
    named = dict(labels=([(i, i % 2, i % 3 // 2) for i in range(40)], LABELS), benchmark=([(1, sentence(rng, 9)), (2, docs[11][1] or "none")], BENCH))
    extra = [d + tuple(range(len(CLASHING))) for d in docs]
    wide = SCHEMA + "".join(f", {c} int" for c in CLASHING)
    plain = QUERIES[op](spark, tables("plain", documents=(docs, SCHEMA), **named))
    more = QUERIES[op](spark, tables("wide", documents=(extra, wide), **named))
    assert plain.columns == more.columns
    # Which of two alike rows gets which slot is open.
    shown = [c for c in plain.columns if op != "op1_sharding" or c not in ("shard", "slot")]
    assert Counter(map(str, plain.select(shown).collect())) == Counter(map(str, more.select(shown).collect()))


def test_classifiers_learn_from_every_labelled_row(spark):
    """No bound on rows of a label or on a text's bytes, and shards don't hang on how rows lie in files."""
    rng = np.random.default_rng(6)
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, 4)) for _ in range(8000)] + [" ".join(rng.choice(words, 9000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 40 != 0), 0) for i in range(len(texts))], LABELS)
    kept = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5}
    got = quality.training_rows(docs, labels, "quality", shard_rows=1000).collect()
    assert len(kept) > 6000 and len(texts[-1]) > 1 << 15 and len(texts) - 1 in kept
    assert Counter(r["text"] for r in got) == Counter(texts[i] for i in kept)
    assert {r["shard"] for r in got} == set(range(-(-len(kept) // 1000)))
    weights, bias = quality.fit(docs, labels, shard_rows=1000, passes=1)
    again, same = quality.fit(docs.repartition(7), labels, shard_rows=1000, passes=1)
    assert (weights == again).all() and bias == same


def test_one_rare_word_among_many_rows_is_learned(spark):
    """What only a few rows teach, in shards of their own, is not lost in the mean over shards nor beyond a bound of rows."""
    rng = random.Random(5)
    docs = [(i, sentence(rng, 12) + (" vilexo" if i % 9 == 0 else "")) for i in range(3000)]
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i, _ in docs], LABELS)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    net, cuts = toxicity.fit(frame, labels, shard_rows=500, passes=3)
    got = toxicity.scores(pa.array([t for _, t in docs]), net, cuts) >= 0.5
    assert (got == [i % 9 == 0 for i, _ in docs]).mean() > 0.99


def test_packed_net_and_its_step():
    """A state holds all of a net; a step's change is the one that differences of the loss ask for."""
    net = toxicity.Net(7)
    grad2 = toxicity.squares_of(net)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, (n, 4)).astype(np.int32) for n in (5, 0, 1, 9)]
    y = np.array([1, 0, 1, 0])
    state = toxicity.packed(net, grad2)
    back, squares = toxicity.unpacked(state)
    assert (toxicity.packed(back, squares) == state).all()
    whole = toxicity._pooled(net, docs)[0]
    assert whole == pytest.approx(np.concatenate([toxicity._pooled(net, [d])[0] for d in docs]), abs=1e-6)

    def loss(at, by):
        moved = state.copy()
        moved[at] += by
        n, _ = toxicity.unpacked(moved)
        z = n.logits(np.concatenate(docs), np.repeat(np.arange(4), [len(d) for d in docs]), 4).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    toxicity._step(net, grad2, docs, y, 0.08)
    change = toxicity.packed(net, grad2) - state
    at = np.unravel_index(np.argsort(-np.abs(change[:, : toxicity.DIM]), axis=None)[:40:4], change[:, : toxicity.DIM].shape)
    for place in zip(*at):
        if place[0] < toxicity.BUCKETS:
            slope = (loss(place, 1e-2) - loss(place, -1e-2)) / 2e-2
            assert abs(slope) < 1e-4 or np.sign(slope) == -np.sign(change[place])


def test_a_line_is_the_mean_over_the_shards_that_changed_it(spark):
    rows = spark.createDataFrame([(i % 3, i, i % 2, f"t{i}") for i in range(30)], "shard int, at long, label int, text string").repartitionById(3, "shard")
    net = toxicity.Net()
    start = toxicity.packed(net, toxicity.squares_of(net))

    def learn(state, batches):
        for batch in batches:
            net, grad2 = toxicity.unpacked(state)
            net.emb[batch.column("shard")[0].as_py()] += np.float32(0.1)
            net.emb[9] += np.float32(0.1)
            net.shift = net.shift + np.float32(batch.column("shard")[0].as_py())
            state[:] = toxicity.packed(net, grad2)

    got, _ = toxicity.unpacked(_mixed.learned(rows, start, learn, 3))
    assert got.emb[[0, 1, 2, 9]] == pytest.approx(net.emb[[0, 1, 2, 9]] + 0.3, abs=1e-6)
    # Shard 0 leaves the shift as it is, so the mean is over the other two.
    assert got.shift == pytest.approx(float(net.shift) + 3 * 1.5) and (got.emb[20:] == net.emb[20:]).all()


def test_least_cost_cuts_against_all_cuts(spark):
    rng = random.Random(11)
    rows = [(g, round(rng.gauss(g, 1), 2 if g else 6), rng.random() < 0.3) for g in (0, 1, 2) for _ in range(400)] + [(3, 1.0, True), (4, 2.0, False)]
    rows = [(g, s + t, t) for g, s, t in rows]
    got = {r["g"]: r for r in ranks.least_cost_cuts(spark.createDataFrame(rows, "g int, s double, t boolean"), "s", "t", "g", 3.0, ranges=5).collect()}
    for g in range(5):
        s, t = np.array([x[1] for x in rows if x[0] == g]), np.array([x[2] for x in rows if x[0] == g])
        v = np.unique(s)
        cuts = [v[0] - 1, *((v[1:] + v[:-1]) / 2), v[-1] + 1]
        cost = lambda c: (t & (s < c)).sum() / max(1, t.sum()) + 3.0 * (~t & (s >= c)).sum() / max(1, (~t).sum())  # noqa: B023, E731
        assert (got[g]["p"], got[g]["q"]) == (t.sum(), (~t).sum())
        assert np.isclose(cuts, got[g]["cut"]).any() and cost(got[g]["cut"]) == pytest.approx(min(map(cost, cuts)))
