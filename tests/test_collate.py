import random

from pyspark.sql import functions as F

from tallywood.operators import matching as M
from tallywood.operators import notes as N


def plain(a, b):
    """The kind of two items by their definition, or None."""
    ta, tb = set(a[2]), set(b[2])
    n, st = len(ta & tb), set(a[3]) & set(b[3])
    j, o = (n / len(ta | tb) if ta | tb else 0.0), (n / min(len(ta), len(tb)) if ta and tb else 0.0)
    x, y = a[1], b[1]
    parts = (set(x.split("-")) & set(y.split("-"))) - set(N.NEVER_SHARED)
    hit = x == y or len(x) > 5 and x in y or len(y) > 5 and y in x or len(parts) >= 2 and (j >= 0.05 or bool(st))
    if x == y or st and j >= 0.2 or j >= 0.35 or o >= 0.6 and n >= 8:
        return "duplicate"
    return "sibling" if hit or st or j >= 0.15 or o >= 0.4 and n >= 5 else None


def items(r, n, words):
    out = []
    for i in range(n):
        tokens = sorted({r.choice(words) if r.random() < 0.8 else "common" for _ in range(r.choice([0, 1, 3, 8, 25, 60]))})
        name = "-".join(r.choice(["load", "data", "the", "skill", "my", "w1", "w2", f"x{i}"]) for _ in range(r.randint(1, 4)))
        out.append((i, name, tokens, sorted({f"say {r.randint(0, 40)}" for _ in range(r.choice([0, 0, 1, 2]))})))
    return out


def test_pairs_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"t{i}" for i in range(150)]
    a, b = items(r, 70, words), items(r, 60, words)
    schema = "id long, name string, tokens array<string>, triggers array<string>"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = {(x[0], y[0]): k for x in a for y in b if (k := plain(x, y))}
    got = {(p.l, p.r): p for p in M.related(left, right).collect()}
    assert {k: v.kind for k, v in got.items()} == want and set(want.values()) == {"duplicate", "sibling"}
    for (i, j), p in got.items():
        assert p.shared_tokens == sorted(set(a[i][2]) & set(b[j][2]))[:12] and p.same_name == (a[i][1] == b[j][1])
    near = {(x[0], y[0]) for x in a for y in b if (n := len(set(x[2]) & set(y[2]))) and (n / len(set(x[2]) | set(y[2])) >= 0.15 or n >= 5)}
    met = {(p.l, p.r) for p in M.token_candidates(left, right).collect()}
    assert near <= met
    placed = M.collated(M.related(left, right)).orderBy("place").collect()
    assert [p.place for p in placed] == list(range(1, len(want) + 1))
    keys = [(p.kind != "duplicate", -p.jaccard, p.l, p.r) for p in placed]
    assert keys == sorted(keys)


def test_the_commonest_words_make_no_pairs(spark):
    rows = [(i, [f"own{i}_{k}" for k in range(30)] + ["all", "every"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert M.token_candidates(df, df).count() == 40
    assert M.similar(df.limit(0), df).count() == 0


def test_phrases_by_our_own_rule(spark):
    cases = [
        ('Say "Check it" or \'run all\' now.', ["check it", "run all"]),
        ("When one asks for a  new plan, or types /plan-it; not a/b", ["/plan-it", "a new plan"]),
        ("wants 'x' and says no", []), (None, []), ("“Wide open” and ‘inner one’", ["inner one", "wide open"]), ("says " + "w" * 80, []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", N.phrases(F.col("t")).alias("p"))
    assert {r.i: r.p for r in df.collect()} == {i: p for i, (_, p) in enumerate(cases)}


def test_tokens_of_one_side_make_no_candidates(spark):
    from tallywood.operators import matching as M

    left = spark.createDataFrame([(1, list("abcdefghij")), (2, list("bcdefghij")), (3, list("bcdefghij"))], "id long, tokens array<string>")
    right = spark.createDataFrame([(7, list("aklmnopqrs")), (8, list("klmnopqrs")), (9, list("klmnopqrs"))], "id long, tokens array<string>")
    assert M.token_candidates(left, right).collect() == []
