"""Alignment, rules and collocations against brute force."""

import base64
import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm.conftest import SCHEMA, documents, sentence
from tidemark.llm import alignment, collocations, rules

# --- alignment ---


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair.read()


def token_bytes(pair):
    cut = lambda v: [v.data[s : s + w].tobytes() for s, w in zip(v.starts, v.width)]
    return cut(pair.words[0]), cut(pair.words[1])


def encoders(pair):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(pair.definition)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=pair.model)


def aligned_plainly(texts, pair):
    """Columns of op11 by loops over whole texts."""
    a, b = encoders(pair)
    words_a, words_b = token_bytes(pair)
    base, linked = [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(words_a[i] for i in ids_a) != want or b"".join(words_b[i] for i in ids_b) != want:
            ids_a, ids_b = [], []
        ends_a, ends_b = (np.cumsum([len(w[i]) for i in ids]).tolist() for ids, w in ((ids_a, words_a), (ids_b, words_b)))
        links = Counter()
        for i, (end, k) in enumerate(zip(ends_a, ids_a)):
            start = ends_a[i - 1] if i else 0
            for j in range(bisect_right(ends_b, start), bisect_left(ends_b, end) + 1):
                links[k, ids_b[j]] += 1
        groups, i, j = [], 0, 0
        place_a, place_b = ({end: k for k, end in enumerate(ends, 1)} for ends in (ends_a, ends_b))
        for cut in sorted(place_a.keys() & place_b.keys()):
            x, y = place_a[cut], place_b[cut]
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        base.append((len(ids_a), len(ids_b), len(groups), sum(links.values()), digest))
        linked.append(links)
    counts = Counter(k for links in linked for k in links)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (*row[:4], sum(n for k, n in links.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in links.items()), row[4])
        for row, links in zip(base, linked)
    ]


ODD_TEXTS = [
    "", " ", "a", "  two  spaces ", "\n\n line\n  after\ttab \r\n", "<|endoftext|> <s> </s> <unk> it's we'll 123 4567",
    "naïve café — “quoted” déjà vu x y　z", "日本語のテキスト と English", "emoji 👩‍👩‍👧 👍🏽 end", "é combining ́start",
    "nul\x00byte \x7f \x1b[0m", "▁ literal ▁▁under", "a" * 300 + " " + "ab " * 100, "العربية עברית हिन्दी ไทย", "x   y \x85 z", "?? !!  ## \\ '' \"quoted\" 's",
]


def test_alignment_agrees_with_loops(spark, tables, pair):
    rng = random.Random(3)
    bits = ["a", " ", "  ", "\n", "é", " ", "'s", "1", "word", ",", "ß", "中", "<s>", "\t", "Ã", " ", "👍"]
    noise = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    docs = documents(40) + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(ODD_TEXTS + noise)]
    docs += [(5000, "many words " * 60_000, "en", "s", 0)] + docs[:3]
    got = alignment.op11_alignment(spark, tables(documents=(docs, SCHEMA))).collect()
    want = aligned_plainly([d[1] for d in docs], pair)
    assert Counter(tuple(r) for r in got) == Counter((d[0], *w) for d, w in zip(docs, want))
    assert sum(w[0] > 0 for w in want) > 150


def test_alignment_in_slices_and_whole_texts(spark, pair, monkeypatch):
    df = spark.createDataFrame(documents(30), SCHEMA)
    tokens = alignment.encoded(df, pair)
    once = Counter(tuple(r) for r in alignment.digests(tokens, pair).collect())
    assert Counter(tuple(r) for r in alignment.digests(tokens, pair, slice_pairs=300).collect()) == once
    monkeypatch.setattr(alignment, "_cuttable", lambda *_: False)
    monkeypatch.setattr(alignment, "ranks", lambda _: None)
    assert Counter(tuple(r) for r in alignment.digests(alignment.encoded(df, pair), pair).collect()) == once


def test_alignment_gives_groups(spark, pair):
    texts = ["plain words here", None, "", "déjà vu 中文"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = {r["doc_id"]: r for r in alignment.groups(alignment.encoded(df, pair), pair).collect()}
    words_a, words_b = token_bytes(pair)
    for i, text in enumerate(texts):
        r = got[i]
        assert b"".join(words_a[k] for k in r["a"]) == (" " + text if text else "").encode()
        at = [0, 0]
        for n, m in zip(r["group_a"], r["group_b"]):
            parts = r["a"][at[0] : at[0] + n], r["b"][at[1] : at[1] + m]
            assert n and m and b"".join(words_a[k] for k in parts[0]) == b"".join(words_b[k] for k in parts[1])
            at = [at[0] + n, at[1] + m]
        assert at == [len(r["a"]), len(r["b"])]


def test_alignment_of_nothing(spark, tables):
    assert alignment.op11_alignment(spark, tables(documents=([], SCHEMA))).count() == 0
    got = alignment.op11_alignment(spark, tables("null", documents=([(1, None, None, None, None), (None, "", None, None, None)], SCHEMA))).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_engines_agree_on_every_character(pair):
    a, _ = encoders(pair)
    texts = [f"x{chr(c)}x {chr(c)}1 {chr(c)} ,{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert alignment.encoder_a(pair.definition)(texts) == [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]


def test_vocabulary_holds_every_byte_and_the_other_file_agrees(pair):
    a, _ = encoders(pair)
    words, _ = token_bytes(pair)
    assert {bytes([b]) for b in range(256)} <= set(words)
    with open(f"{alignment.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        for line in f:
            token, k = line.split()
            assert words[int(k)] == base64.b64decode(token)
    assert len(words) == a.get_vocab_size()


# --- rules ---


def counted_plainly(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


LINES = "one line\nanother line\none line\n \n\n \none line\r\none line\r\n#*$%&|<> é x 日本\n"


def labelled(n=400, seed=4):
    """Plain texts, and as many hundreds with signs in every word; labels of the first half."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = sentence(rng, rng.randint(60, 150)).capitalize() + "."
        bad = i % 5 == 0
        docs.append((i, " ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in text.split()) if bad else text, "en", "s", 0))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_rules_count_as_loops_do(spark, tables):
    docs = documents() + [(100, LINES * 3, "en", "s", 0), (101, "a b c a b c x a b", "en", "s", 0), (102, "a a a a", "en", "s", 0), (103, "w " * 200_000, "en", "s", 0)]
    got = rules.op12_rules(spark, tables(documents=(docs, SCHEMA), labels=([], "doc_id long, quality int, toxic int"))).collect()
    want = Counter()
    for d in docs:
        n = counted_plainly(d[1])
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        want[d[0], *n, failed, not failed] += 1
    assert Counter(tuple(r)[:8] for r in got) == want


def test_rules_drop_odd_texts_and_keep_plain_ones(spark, tables):
    docs, labels = labelled()
    sf = tables(documents=(docs, SCHEMA), labels=(labels, "doc_id long, quality int, toxic int"))
    for r in rules.op12_rules(spark, sf).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["kept"] == (r["doc_id"] % 5 != 0)


def test_path_lengths_follow_plain_walks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    forest = rules.grow(x, rules.reach(x), trees=7, sample=64, depth=6)
    for row, s in zip(x[:40], rules.oddness(forest, x[:40])):
        lengths = []
        for t in range(7):
            node = 0
            while forest.feature[t, node] >= 0:
                node = forest.left[t, node] + int(row[forest.feature[t, node]] >= forest.at[t, node])
            lengths.append(forest.length[t, node])
        assert s == pytest.approx(2 ** (-np.mean(lengths) / forest.usual))
    far = np.array([[9, 9, 9]], np.float32)
    wide = rules.grow(x, (x.min(0), np.full(3, 10.0)), trees=50, sample=64)
    assert rules.oddness(wide, far)[0] > rules.oddness(wide, x).max()


def test_threshold_gives_up_no_more_than_stated():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1000, 3)), rng.normal(6, 1, size=(100, 3))])
    odd = np.arange(1100) >= 1000
    forest = rules.calibrated(rules.grow(x[~odd], rules.reach(x)), x, odd, 0.01)
    s = rules.oddness(forest, x)
    assert (s[~odd] >= forest.threshold).sum() <= 10 and (s[odd] < forest.threshold).sum() < 20


def test_rules_of_nothing(spark, tables):
    none = tables("none", documents=([], SCHEMA), labels=([], "doc_id long, quality int, toxic int"))
    assert rules.op12_rules(spark, none).count() == 0
    assert rules.counts(pa.array([], pa.string())).shape == (0, len(rules.COUNTS))


# --- collocations ---


def mined_plainly(docs, least, max_words, share, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = lang if lang is not None else "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    hidden = set()
    for (lang, p), a in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * a >= share * f[lang, p[i : i + size]]:
                    hidden.add((lang, p[i : i + size]))
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if (lang, p) in hidden:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    ]


def phrase_documents():
    rng = random.Random(9)
    words = ["new", "york", "city", "é", "Ärger", "日本", "x y", "the", "of", "THE", "a"]
    docs = documents()
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "! "]) for _ in range(rng.randint(0, 60)))
        docs.append((200 + i, text, rng.choice(["en", "en", "de", None, "und"]), "s", 0))
    return docs + [(900, "new york city " * 3000, "en", "s", 0), (901, "a " * 5000, "fr", "s", 0)] + docs[60:70]


@pytest.mark.parametrize("max_words, bits", [(3, 1 << 27), (3, 64), (5, 1 << 12), (1, 1 << 10)])
def test_collocations_agree_with_loops(spark, max_words, bits):
    docs = phrase_documents()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = collocations.collocations(df, least=4, max_words=max_words, top=40, bits=bits)
    assert sorted(map(tuple, got.collect())) == sorted(mined_plainly(docs, 4, max_words, 50, 40))


def test_collocations_over_small_buffers(spark, monkeypatch):
    monkeypatch.setattr(collocations, "OUT_ROWS", 7)
    docs = phrase_documents()[:120]
    counts = collocations.phrase_counts(spark.createDataFrame(docs, SCHEMA), least=2, buffer_words=50)
    got = {(r["lang"], r["phrase"]): r["f"] for r in counts.collect()}
    again = collocations.phrase_counts(spark.createDataFrame(docs, SCHEMA), least=2)
    assert got == {(r["lang"], r["phrase"]): r["f"] for r in again.collect()} and len(got) > 100


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    rows = [("en", "a", 1, big + 7), ("en", "b", 1, big + 9), ("en", "a b", 2, big)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    assert [r["score"] for r in collocations.scored(counts).collect()] == [10**6 * big * big // ((big + 7) * (big + 9))]


def test_collocations_of_nothing(spark, tables):
    assert collocations.op13_collocations(spark, tables(documents=([], SCHEMA))).count() == 0
    extra = spark.createDataFrame([(None, None, 1, "p")] * 3 + [("x y " * 20, None, 2, "q")], "text string, lang string, f long, phrase string")
    # "y x" lies within both longer candidates.
    got = collocations.collocations(extra).collect()
    assert [r["phrase"] for r in got] == ["x y x", "y x y"] and {r["lang"] for r in got} == {"und"} and got[0]["n"] == 40


def test_rules_learn_from_every_labelled_row(spark):
    """Box, threshold and rows are those of all labels: none is left out by a bound, nor for a long text."""
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(5000)] + [" ".join(rng.choice(words, 9000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 != 0)) for i in range(len(texts))], "doc_id long, quality int")
    rows_ = rules.labelled_shares(docs, labels)
    kept = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    assert rows_.count() == len(kept) > 4000 and len(texts[-1]) > 1 << 15
    got = rows_.toArrow()
    x, odd = np.stack([got.column(c).to_numpy() for c in rules._SHARES], 1), got.column("odd").to_numpy(zero_copy_only=False)
    forest = rules.grow(x[~odd], rules.reach(x), trees=9, sample=64)
    assert rules.threshold(rows_, forest, 0.01) == pytest.approx(rules.calibrated(forest, x, odd, 0.01).threshold)
