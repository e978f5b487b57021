import hashlib
import random
import re
import zlib

from tallywood.llm import periods as P
from tallywood.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute(w, least=12):
    """Every stretch at every lag, extended both ways; of equal stretches that with the smallest lag."""
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and (i, j) not in seen and not any(s == i and s + n == j + q for s, n, _ in out):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_equal_brute_force(monkeypatch):
    r = random.Random(11)
    for k in range(1500):
        n = r.randint(0, 90)
        w = [r.randrange(r.randint(1, 5)) for _ in range(n)]
        if n and r.random() < 0.6:
            a, p = r.randrange(n), r.randint(1, 20)
            w = w[:a] + [w[min(n - 1, a + (i - a) % p)] for i in range(a, n)]
        monkeypatch.setattr(P, "LONG_TEXT", 1 if k % 4 == 0 else 2048)
        least = r.choice([2, 5, 12, 12])
        assert P.runs(P.numbered([b"%d" % x for x in w]), least) == brute(w, least), w


def test_bits():
    assert P.starts_of(0b1110111, 3) == 0b0010001
    assert P.stretches(0b0110111) == [(0, 3), (4, 2)] and P.stretches(0) == []


def test_edges_and_clashing_names(spark):
    same, blank = "x " * 30, " \t\n"
    texts = [None, "", blank, "a", "a b", same, same, "tic tac " * 20_000, "u" * 100_000 + " v", "a b " * 12, "p q r " * 5 + "p s"]
    df = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, RUNS string, part long")
    got = P.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "part", "n_words", "runs", "collapsed"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i in range(5):
        assert rows[i].runs == [] and rows[i].collapsed == " ".join((texts[i] or "").split())
    assert [tuple(x) for x in rows[5].runs] == [(0, 30, 1)] and rows[5].collapsed == "x" and rows[6].runs == rows[5].runs
    assert [tuple(x) for x in rows[7].runs] == [(0, 40_000, 2)] and rows[7].collapsed == "tic tac"
    assert [tuple(x) for x in rows[9].runs] == [(0, 12, 1)]
    assert [tuple(x) for x in rows[10].runs] == [(0, 16, 3)] and rows[10].collapsed == "p q r s"
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_query_equals_brute_force_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in Q.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert set(got) == {r.doc_id for r in docs}
    repeated = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, repeated = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], repeated + 1
        runs, x = brute(w), got[d.doc_id]
        keep = [v for i, v in enumerate(w) if not any(s + q <= i < s + k for s, k, q in runs)]
        assert x.n_runs == len(runs)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(keep).encode()).hexdigest()
        best = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=None)
        assert (x.start, x.length, x.period, x.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert repeated > 5 and any(r.n_runs for r in got.values())


def test_a_null_id_is_left_as_it_is(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in Q._with_repeats(df).collect()} == {(None, "a b c"), (3, None)}
