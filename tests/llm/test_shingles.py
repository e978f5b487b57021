import random

import corpus_pipeline as C
import numpy as np
import pytest
from tallywood.llm import simhash as S

SF = "/root/testdata/sf0.001"


def plain(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(sets):
    top = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if top[i] != top[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                lo, hi = sorted((top[i], top[j]))
                top = [lo if t == hi else t for t in top]
    return top


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return words


def texts():
    """Near copies from far to close, chains of them, a passage many share, short and empty texts."""
    r = random.Random(3)
    out = [None, "", "one two", "ONE  two", "a b c d e", "a b c d f"]
    passage = [f"p{i}" for i in range(40)]
    for g in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(20, 120))]
        for k in range(6):
            out.append(" ".join(edited(r, base, k)))
            base = edited(r, base, 1) if g % 2 else base
    out += [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(r.randint(0, 40))]) for _ in range(40)]
    r.shuffle(out)
    return out


def found_and_missed(got, sets):
    """Links by brute force, those the components hold, and classes of got that no link holds together."""
    want = classes(sets)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    wrong = sum(len({want[i] for i in range(len(sets)) if got[i] == c}) > 1 for c in set(got))
    return pairs, [p for p in pairs if got[p[0]] != got[p[1]]], wrong


@pytest.mark.parametrize("frequent", [100, 12])
def test_components_equal_brute_force(spark, frequent):
    all_texts = texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    got = dict(S.similar_components(df, frequent=frequent).select("doc_id", "component_id").collect())
    sets = [plain(t) for t in all_texts]
    pairs, missed, wrong = found_and_missed([got[i] for i in range(len(all_texts))], sets)
    assert wrong == 0 and len(pairs) > 30 and len(missed) <= 0.1 * len(pairs), (len(pairs), missed)


def test_a_large_group_of_near_copies_stays_whole(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(r, base, 2))) for i in range(400)] + [(1000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(100))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(S.similar_components(df, frequent=20).select("doc_id", "component_id").collect())
    assert {got[i] for i in range(400)} == {0} and len(set(got.values())) == 51


def test_a_text_that_links_with_one_of_a_large_group_alone(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    all_texts = [base] + [edited(r, base, 2) for _ in range(60)] + [base[18:], base[40:]]  # the last shares enough with the one before only
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(all_texts)], "doc_id long, text string")
    sets = [plain(" ".join(w)) for w in all_texts]
    links = [i for i in range(len(sets) - 1) if 5 * len(sets[i] & sets[-1]) >= 4 * len(sets[i] | sets[-1])]
    got = dict(S.similar_components(df, frequent=20, chunk=16).select("doc_id", "component_id").collect())
    assert links == [61] and classes(sets)[-1] == 0 and set(got.values()) == {0}


def test_stage_drops_a_near_copy_beyond_four_bits(spark):
    docs = C.dedup_lines(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[k][0] for k in classes([plain(t) for _, t in rows])}
    assert {r.doc_id for r in C.near_dedup(spark, docs, SF).collect()} == want and 177 not in want


def test_pairs_of_a_common_passage_stay_in_their_task(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(60))
    texts = [passage + " " + " ".join(word() for _ in range(40)) for _ in range(120)]
    texts += [f"{texts[7]} {word()}", f"{word()} {texts[90]}"]
    seen, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, *where: seen.append(cut(df, *where)) or seen[-1])
    monkeypatch.setattr(S, "removed", lambda spark, path: None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in S.similar_components(df, frequent=20, anchors=1, depth=1).collect()}
    assert {i: c for i, c in got.items() if i != c} == {120: 7, 121: 90}
    assert max(x.count() for x in seen if x.columns == ["a", "b"]) < 2 * len(texts)


def test_counts_lose_no_pair_that_shares_enough():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[: r.integers(2, 400)], r.integers(0, 2**63, r.integers(0, 60), dtype=np.uint64)])) for _ in range(120)]
    sets += [x[: len(x) - len(x) // 6] for x in sets]
    n = np.array([len(x) for x in sets])
    counts = np.frombuffer(b"".join(map(S.bucket_counts, sets)), np.uint8).reshape(-1, S.BUCKETS)
    every = np.arange(len(sets))
    told = {(i, int(j)) for i, js in S.may_share(n, counts, every, every, every, (4, 5)) for j in js}
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in every for j in every if i != j}
    want = {p for p, k in both.items() if 5 * k >= 4 * (n[p[0]] + n[p[1]] - k)}
    assert len(want) > 100 and want <= told and len(told) < len(both) // 2
