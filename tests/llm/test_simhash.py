import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallywood.llm import simhash as S


def plain(text, width=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, most=4):
    names = list(range(len(fps)))

    def top(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = top(i), top(j)
                names[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def clustered(r, n):
    out = []
    for _ in range(n):
        x = r.getrandbits(64) if not out or r.random() < 0.4 else r.choice(out)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


def test_hash_is_that_of_the_built_in(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab é"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("ab é".encode(), 42)).astype(np.int64)


def test_fingerprints_equal_plain_ones():
    r = random.Random(5)
    for t in ["", " ", "One", "one TWO  three", "a b c d", *[" ".join(r.choice("ab cD\x0b é ñ É".split(" ")) for _ in range(r.randint(1, 40))) for _ in range(80)], "x y z " * 30_000]:
        assert S.fingerprint(t.encode()) == plain(t), t[:50]


def test_tree_search_loses_no_link():
    r = random.Random(1)
    for n in (2, 17, 300, 900):
        codes = np.array(sorted(set(clustered(r, n))), np.uint64)
        group = np.array([r.randrange(3) for _ in codes])
        order = np.lexsort((S.gray_rank(codes), group))
        codes, group = codes[order], group[order]
        got = S.linked(codes, group, 4, block=64)
        want = np.arange(len(codes))
        for g in range(3):
            at = np.flatnonzero(group == g)
            for i, c in zip(at, classes([int(x) for x in codes[at]]), strict=True):
                want[i] = at[c]
        assert np.array_equal(got, want)


def test_components_equal_brute_force_with_split_groups(spark):
    r = random.Random(2)
    fps = list(dict.fromkeys(clustered(r, 700)))
    nodes = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(fps)], "node long, fp long")
    want = classes(fps)
    for segments, rows in ((5, 50_000), (5, 3), (6, 50_000)):
        found = dict(S.components(S.near_links(nodes, segments=segments, group_rows=rows)).collect())
        assert [found.get(i, i) for i in range(len(fps))] == want


def test_documents_with_nulls_repeats_and_no_rows(spark):
    a = " ".join(f"word{i}" for i in range(300))
    rows = [(5, a, "s"), (3, a + " more", "s"), (9, a, "s"), (9, a, "s"), (1, None, "s"), (2, "", "s"), (7, "Quite another text, of some words.", None), (None, a, "s"), (None, "alone here", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(x.doc_id), x.fp, x.component_id) for x in S.simhash_components(df).collect())
    fps = [plain(x[1]) for x in rows]
    cls = classes(fps)
    ids = {c: min((rows[i][0] for i in range(9) if cls[i] == c and rows[i][0] is not None), default=None) for c in cls}
    assert got == sorted((str(x[0]), int(np.uint64(f).astype(np.int64)), ids[c]) for x, f, c in zip(rows, fps, cls, strict=True))
    kept = S.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted([*{str(i) for i in ids.values() if i is not None}, "None", "None"])
    assert S.simhash_components(df.limit(0)).count() == 0
