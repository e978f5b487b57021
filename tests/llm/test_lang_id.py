import zlib

import numpy as np
from pyspark.sql import functions as F

from tallywood.llm import lang_id as L


def test_gradient_equals_differences():
    net = L.Network.fresh(3, 2, 0)
    for n in ("byte", "gates", "cand", "out"):
        setattr(net, n, getattr(net, n).astype(np.float64))
    r = np.random.default_rng(0)
    x, y, on = r.integers(0, 256, (6, 4)).astype(np.uint8), np.array([[0, 1, 1, 0]]), np.ones((6, 4), bool)
    on[4:, 1] = False
    _, grads = net.gradient(x, y, on)
    for a, g in zip(net.arrays(), grads, strict=True):
        for k in [*r.integers(0, a.size, 12), *np.argsort(-abs(g).ravel())[:6]]:
            old, e = a.flat[k], 1e-3
            a.flat[k] = old + e
            up, _ = net.gradient(x, y, on)
            a.flat[k] = old - e
            down, _ = net.gradient(x, y, on)
            a.flat[k] = old
            assert abs((up - down) / (2 * e) - g.flat[k]) < 1e-4


def test_every_byte_counts():
    net = L.Network.fresh(4, 3, 5)
    texts = [b"a" * 300, b"", b"xyz" * 50 + b"q", b"b" * 128]
    p = L.pooled(net, texts, chunk=128, rows=2)
    for t, got in zip(texts, p, strict=True):
        parts = [net.probabilities(net.states(np.frombuffer(t[i : i + 128], np.uint8)[:, None]))[:, 0] for i in range(0, len(t), 128)]
        want = np.concatenate(parts).mean(axis=0) if parts else np.zeros(3)
        assert np.allclose(got, want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, steps=120)
    out = L.identify(docs, model).select("doc_id", "lang", "lang_pred", "score", L.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.h]
    assert len(test) > 100 and np.mean([r.lang == r.lang_pred for r in test]) > 0.96


def test_odd_rows_and_nothing_to_learn_from(spark):
    rows = [(11, "½ ² Ⅷ ①", "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (3, "12 .. !!", "fr", "s"), (4, "the the", None, "s"), (None, "le la", "fr", None), (5, "the and of " * 30_000, "en", "s"), (5, "the and", "en", "s"), (6, "le la du", "fr", "s"), (7, "le un et", "fr", "s"), (8, "of it", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE string")
    got = L.identify(df, L.fit(df, steps=20))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "other"]
    out = got.collect()
    assert len(out) == len(rows)
    assert all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in out)
    none = df.limit(0)
    model = L.fit(none)
    assert model == ([], None) and L.identify(none, model).count() == 0
    assert {r.lang_pred for r in L.identify(df, model).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(i, f"word {'abcdefghij'[i % 10] * 3} of {i % 90}", f"l{i % 90:02d}", "s") for i in range(900)]
    names, net = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), steps=2)
    assert names == [f"l{i:02d}" for i in range(90)] and net.out.shape[1] == 91


def test_other_tells_what_is_none_of_the_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    three = docs.filter("lang <> 'de'")
    model = L.fit(docs)
    odd = ["deadbeef0123456789abcdef0011223344556677" * 3, "Minden emberi lény szabadon születik és egyenlő méltósága és joga van", "QmFzZTY0IGVuY29kZWQgc3RyaW5nIG9mIHNvbWUga2luZA=="]
    got = L.identify(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string"), model).collect()
    assert all(r.other > 0.7 for r in got), [r.other for r in got]
    clean = [r.other for r in L.identify(three, model).collect() if r.text and len(r.text) > 200]
    assert np.mean([x < 0.5 for x in clean]) > 0.995
