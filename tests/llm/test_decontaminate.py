import random

import numpy as np
import pytest

from tallywood.llm import decontaminate as D


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    pool = [f"w{int(r.paretovariate(0.6)) % 900}" for _ in range(900)]
    say = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, f"{say(r.randint(8, 30))}? {say(r.randint(1, 9))}." if i % 2 else f"{say(r.randint(9, 30))}. {say(r.randint(4, 12))}.") for i in range(60)]
    docs = []
    for d in range(120):
        t = say(r.randint(0, 300)).split()
        if d % 3 == 0:
            i, x = r.choice(items)
            w = x.split()
            if d % 2:
                w[r.randrange(len(w))] = "other"
            at = r.randint(0, len(t))
            t[at:at] = w
        docs.append((d, " ".join(t)))
    return items, docs


def made(items, block=4):
    w = [D.words(t) for _, t in items]
    df = {}
    for x in w:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    return D.Index.of(items, len(items), df, float(np.mean([len(x) for x in w])), max(map(len, w)), block)


def plain_scores(index, passage):
    out = np.zeros(len(index.ids))
    for t in {index.terms[x] for x in passage if x in index.terms}:
        a, b = (index.ends[t - 1] if t else 0), index.ends[t]
        out[index.items[a:b]] += index.weights[a:b]
    return out


@pytest.mark.parametrize("cells", [D.TABLE_CELLS, 0])
def test_wand_finds_what_scoring_all_finds(corpus, monkeypatch, cells):
    monkeypatch.setattr(D, "TABLE_CELLS", cells)
    monkeypatch.setattr(D, "AT_ONCE", 500)
    items, docs = corpus
    for block in (1, 4, 64):
        index = made(items, block)
        for _, t in docs:
            w = D.words(t)
            for a in range(0, len(w), index.stride):
                passage = w[a : a + 2 * index.stride]
                for threshold in (0.2, 0.6):
                    want = {i: s for i, s in enumerate(plain_scores(index, passage)) if s >= threshold - D.MARGIN}
                    got = dict(index.wand(sorted({index.terms[x] for x in passage if x in index.terms}), threshold))
                    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)
                    if want:
                        assert (a, min(len(w), a + 2 * index.stride)) in list(index.candidates(w, threshold))


def test_own_text_reaches_the_whole_score(corpus):
    items, _ = corpus
    for block in (1, 4):
        index = made(items, block)
        for _, t in items:
            w = D.words(t)
            assert 1.0 <= max(s for _, s in index.wand(sorted({index.terms[x] for x in w}), 1.0)) + 1e-8
            assert index.matches(t, 1.0, 1.0)


def test_index_of_a_whole_shard_is_small():
    r = np.random.default_rng(2)
    items = [(i, " ".join(f"t{x}" for x in r.integers(0, 26_000, 20))) for i in range(35_000)]
    index = made(items, 2)
    arrays = [index.ends, index.items, index.weights, index.block_ends, index.blocks, index.maxima, index.most]
    assert sum(a.nbytes for a in arrays) < 40 << 20
    w = D.words(items[77][1])
    assert 77 in {index.ids[i] for i, _ in index.wand(sorted({index.terms[x] for x in w}), 1.0)}


def test_leaks_equal_brute_force_whatever_the_shards(spark, corpus):
    items, docs = corpus
    index = made(items)
    want = set()
    for d, t in docs:
        w = D.words(t)
        for a in range(0, len(w), index.stride):
            passage = w[a : a + 2 * index.stride]
            joined = " " + " ".join(passage) + " "
            for i, s in enumerate(plain_scores(index, passage)):
                shares = [sum(f" {' '.join(r)} " in joined for r in part) / len(part) if part else 1 for part in index.runs_of(i)]
                if s >= 0.6 and min(shares) >= 0.6:
                    want.add((d, index.ids[i]))
    assert len(want) >= 20
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 22, 900):
        got = D.leaks(a, b, shard_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert {r.doc_id for r in D.decontaminated(a, b, shard_chars=chars).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert {r.doc_id for r in D.decontaminated(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_odd_rows(spark):
    item = "Which one of these words is the first of all words ever said? It was the word none."
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x " * 50_000 + item.upper() + " y" * 50_000, 5), (3, item, 5), (None, item, 5), (None, "clean text", 5), (4, "Which one of these words", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, " .. "), (None, "Some other item that nobody has seen before. Never ever.")], "item_id long, text string")
    got = D.leaks(docs, items)
    assert sorted((str(r.doc_id), r.item_id) for r in got.collect()) == [("3", 1)] * 4 + [("None", 1)] * 2
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("4", "Which one of these words"), ("None", "clean text")]
    assert kept.count() == 4
    assert D.leaks(docs, items.limit(0)).count() == 0 and D.decontaminated(docs.limit(0), items).count() == 0
