import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallywood.llm import phrases as P

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, longest=5, least=3, share=100, top=None):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    big = {g: c for g, c in f.items() if len(g[1]) > 1 and c >= least}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = []
    for (lang, w), a in big.items():
        if any(x[0] == lang and len(x[1]) > len(w) and 100 * c >= share * a and inside(w, x[1]) for x, c in big.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], s))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, done = Counter(), []
    for r in out:
        ranks[r[0]] += 1
        if top is None or ranks[r[0]] <= top:
            done.append((r[0], ranks[r[0]], *r[1:]))
    return done


def made(r):
    words = ["the", "The", "a", "of", "sea", "wind", "é", "漢", "#x", "a\x1cb"]
    return "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r"]) for _ in range(r.randint(0, 60)))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BYTES", 2000)
    r = random.Random(12)
    texts = [made(r) for _ in range(60)]
    rows = [(r.choice(["en", "en", "fr", None, "und"]), t, "x") for t in texts + texts[:20]] + [(None, None, "x"), ("en", "", "x"), ("en", "of the sea " * 300, "x"), ("en", " \t.,", "x")]
    df = spark.createDataFrame(rows, "lang string, text string, PHRASE string")
    got = P.collocations(df, least=3, top=None)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute([(a, b) for a, b, _ in rows])
    assert len(want) > 200 and sorted(map(tuple, got.collect())) == sorted(want)
    want = brute([(a, b) for a, b, _ in rows], longest=3, least=5, share=60, top=7)
    assert sorted(map(tuple, P.collocations(df, longest=3, least=5, share=60, top=7).collect())) == sorted(want)


def test_empty_table_and_nothing_frequent(spark):
    schema = "lang string, text string"
    assert P.collocations(spark.createDataFrame([], schema)).count() == 0
    assert P.collocations(spark.createDataFrame([("en", "a b c")], schema)).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    r = random.Random(2)
    rows = []
    for _ in range(200):
        left, right = r.randint(10**12, 10**15), r.randint(10**12, 10**15)
        a = r.randint(10**9, min(left, right))
        rows.append((a, r.randint(10**15, 10**16), left, right))
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", P.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got)


def test_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(P, "_mixed", lambda a, b: np.zeros(len(b), np.uint64))
    part = pa.table({"lang": ["x", "x", "y"], "piece": ["a b a b", "b a", "a b"], "m": pa.array([2, 5, 1], pa.int64())})
    got = Counter()
    for r in P.grams(part, 2, None).to_pylist():
        got[r["lang"], r["phrase"]] += r["f"]
    assert got == {("x", "a b"): 4, ("x", "b a"): 7, ("y", "a b"): 1}


def test_the_bit_map_holds_all_of_its_phrases(spark):
    rows = [("en" if i % 3 else "fr", f"w{i} v{i % 7}", 100) for i in range(3000)]
    bits = P.bit_map(spark.createDataFrame(rows, "lang string, phrase string, f long"), len(rows))
    part = pa.table({"lang": [r[0] for r in rows], "piece": [f"{r[1]} end" for r in rows], "m": pa.array([1] * len(rows), pa.int64())})
    kept = P.grams(part, 3, np.full(len(bits), 255, np.uint8)).num_rows
    assert kept == len(rows) and np.unpackbits(bits).sum() <= len(rows) and len(bits) == 8192


def test_pieces_of_a_part_of_a_batch():
    r = random.Random(7)
    texts, langs = [made(r) if i % 9 else None for i in range(300)], [r.choice(["en", None, "fr"]) for _ in range(300)]
    want = Counter()
    for lang, t in zip(langs[90:210], texts[90:210], strict=True):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            if w := re.findall(r"[^\x20\x09]+", piece):
                want[lang or "und", " ".join(w)] += 1
    got = P._pieces_of(pa.array(langs).slice(90, 120), pa.array(texts, pa.string()).slice(90, 120)).to_pylist()
    assert {(x["lang"], x["piece"]): x["m"] for x in got} == want and len(got) == len(want)
