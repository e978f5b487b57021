import random
from collections import defaultdict
from fractions import Fraction

from tallywood.llm import mixing as M
from tallywood.llm.common import running


def filled(sizes, weights, share=Fraction(3, 2), most=2):
    """Shares by weight; what is above most times a size is shared again among the others, until none is above."""
    budget, out, left = share * sum(sizes), {}, dict(enumerate(sizes))
    while left:
        total = sum(weights[i] for i in left)
        over = [i for i in left if Fraction(weights[i]) * budget / total > most * sizes[i]]
        if not over:
            return [float(out.get(i, Fraction(weights[i]) * budget / total)) for i in range(len(sizes))]
        for i in over:
            out[i] = Fraction(most * sizes[i])
            budget -= out[i]
            del left[i]
    return [float(out[i]) for i in range(len(sizes))]


def docs_of(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["b", "a", "a", "a", "a", "é", "Z", None]), "w " * r.choice([0, 1, 3, 10, 40]), "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, SIZE string")


def test_targets_and_takings(spark):
    rows, df = docs_of(spark, 700)
    got = M.amounts(df).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, s, t, _ in rows:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, filled([size[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in {0, r.size, 2 * r.size}
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in order)
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    again = M.amounts(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_the_mix_is_one_running_stream(spark):
    _, df = docs_of(spark, 200)
    rows = M.mix(df, weights=(1, 5), share=Fraction(1, 2), most=3).orderBy("upto").collect()
    at = 0
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        assert a.finish <= b.finish or b.upto - a.upto == b.size == 0
    for r in sorted(rows, key=lambda r: (r.upto, r.finish)):
        at += r.size
    assert at == max(r.upto for r in rows)


def test_first_copies_come_before_second_ones(spark):
    df = spark.createDataFrame([(i, "s", "w w w") for i in range(9)], "doc_id long, source string, text string")
    assert {r.taken for r in M.amounts(df, share=Fraction(1)).collect()} == {3}
    assert {r.taken for r in M.amounts(df, share=Fraction(2)).collect()} == {6}
    assert {r.taken for r in M.amounts(df, share=Fraction(9)).collect()} == {6}  # all sources are full


def test_empty_repeated_and_null_rows(spark):
    schema = "doc_id long, source string, text string"
    assert M.amounts(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in M.amounts(spark.createDataFrame([(1, None, None), (1, "", "")], schema)).collect()] == [0, 0]
    df = spark.createDataFrame([(None, "s", "a b"), (None, "s", "a b"), (7, "s", "a b"), (7, "s", "a b"), (8, None, "c " * 50_000)], schema)
    got = M.amounts(df).collect()
    assert len(got) == 5 and sum(r.taken for r in got if r.source == "s") in {14, 16} and all(r.taken <= 2 * r.size for r in got)


def test_running_sums_over_all_rows(spark):
    r = random.Random(3)
    rows = [(r.randrange(50), i, r.randrange(9)) for i in range(900)]
    got = running(spark.createDataFrame(rows, "part int, i long, n long").repartition(7), ["part", "i"], {"n": "upto"}).collect()
    at = 0
    for x, want in zip(sorted(got, key=lambda x: (x.part, x.i)), sorted(rows), strict=True):
        at += want[2]
        assert (x.part, x.i, x.n, x.upto) == (*want, at)
