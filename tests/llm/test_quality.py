import random
import re
from collections import Counter

from tallywood.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)


def test_counts_equal_plain_ones(spark):
    r = random.Random(8)
    texts = [None, "", "  \n\x0b", "a", "a b", "a a a a", "x y z x y z", "é🙂 漢#"]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "the ", "\t", "#", "d!"]) for _ in range(r.randint(1, 90))) for _ in range(60)]
    texts += ["w x y z " * 20_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(3, "a", "k")], "doc_id long, text string, KEPT string")
    got = Q.judged(df)
    assert got.columns == ["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for x in rows:
        want = plain(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (x.base_failed and x.kept)
    assert Q.judged(df.limit(0)).count() == 0


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"the wind{i} of v{i} and a sea{i} is s{i} in r{i}." for i in range(20))
    junk = [" ".join(f"w{i}$$$ the" for i in range(60)), " ".join(f"THE!! W{i}!!" for i in range(60)), " ".join(f"xx{i}" for i in range(99)), "\n".join([prose] * 9), "few words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([prose, *junk])], "doc_id long, text string")
    assert {x.doc_id: x.kept for x in Q.judged(df).collect()} == {0: True} | dict.fromkeys(range(1, 6), False)


def test_no_python_in_the_plan(spark):
    plan = Q.judged(spark.range(1).selectExpr("id", "'a' text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
