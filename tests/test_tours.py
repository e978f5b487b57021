"""Tours against the rules followed one node after the other."""

import random
from collections import deque

from tallywood.operators import tours as T


def plain(edges, nodes):
    of = {n[0]: n for n in nodes}
    code = {n for n, x in of.items() if not x[4]}
    out = {n: sorted({b for a, b in edges if a == n and b in code}) for n in code}
    used = {b for a, b in edges if a in code and b in code}
    users = {n: len({a for a, b in edges if b == n}) for n in of}

    def reach(s):
        depth, q = {s: 0}, deque([s])
        while q:
            v = q.popleft()
            for w in out[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    q.append(w)
        return depth

    cand = [n for n in sorted(code) if not of[n][1] and (of[n][2] or of[n][3] or n not in used and out[n])]
    seen = {n: reach(n) for n in cand}
    tier = {n: 0 if of[n][2] else 1 if of[n][3] else 2 for n in cand}
    entries = sorted(cand, key=lambda n: (1 - len(seen[n]), tier[n], n))
    order = [(n, "front page") for n in sorted(of) if of[n][1] and not of[n][4]]
    done = {n for n, _ in order}

    def emit(e, busy):
        if e in done or e in busy:
            return
        for p in entries:
            if p != e and seen[e].get(p, 0) > 0 and tier[p] == 0 and (len(seen[p]) - 1) * 2 >= len(seen[e]) - 1:
                emit(p, busy | {e})
        if e in done:
            return
        for n in sorted((x for x in seen[e] if x not in done), key=lambda x: (seen[e][x], -users[x], x)):
            order.append((n, "entry" if n == e else "reached"))
            done.add(n)

    for e in entries:
        emit(e, set())
    order += [(n, "not reached") for n in sorted(code - done, key=lambda n: (-users[n], n))]
    return order + [(n, "test") for n in sorted(set(of) - code)]


def test_tours_follow_the_rules(spark):
    for seed in range(3):
        r = random.Random(seed)
        names = [f"n{i:02d}" for i in range(40)]
        edges = sorted({(a, b) for _ in range(55) for a, b in [(r.choice(names), r.choice(names))] if a != b})
        nodes = [(n, n == "n05", r.random() < 0.15, r.random() < 0.1, r.random() < 0.2 and n != "n05") for n in names]
        e = spark.createDataFrame([(a, b, "import") for a, b in edges], "src string, dst string, kind string")
        got = T.tour(e, spark.createDataFrame(nodes, "node string, first boolean, program boolean, page boolean, test boolean"), 0).orderBy("nth").collect()
        want = plain(edges, nodes)
        assert [(x.node, x.why) for x in got] == want, seed


def test_tests_that_depend_on_hubs(spark):
    e = spark.createDataFrame([("t1", "a"), ("a", "b"), ("b", "a"), ("t2", "b"), ("c", "b"), ("t3", "c"), ("b", "t4")], "src string, dst string")
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    assert {(r.node, r.n_tests) for r in T.test_dependents(e, frame("b", "c", "z"), frame("t1", "t2", "t3", "t4")).collect()} == {("b", 3), ("c", 1), ("z", 0)}
    walked = {(r.entry, r.node): (r.depth, r.via) for r in T.reaches(e, frame("t3", "a")).collect()}
    assert walked["t3", "a"] == (3, "b") and walked["a", "a"] == (0, None) and ("a", "c") not in walked


def test_tour_has_no_row_for_each_entry_and_node(spark, monkeypatch):
    most, cut = [0], T.cut

    def counted(df):
        out = cut(df)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(T, "cut", counted)
    ring = [f"n{i:02d}" for i in range(40)]
    edges = sorted(set(zip(ring, ring[1:] + ring[:1], strict=True)) | {(ring[i], ring[-i]) for i in range(1, 20)})
    nodes = [(n, False, i % 3 > 0, i % 3 == 0, False) for i, n in enumerate(ring)]
    e = spark.createDataFrame([(a, b, "import") for a, b in edges], "src string, dst string, kind string")
    got = T.tour(e, spark.createDataFrame(nodes, "node string, first boolean, program boolean, page boolean, test boolean"), 0).orderBy("nth").collect()
    assert [(x.node, x.why) for x in got] == plain(edges, nodes)
    assert most[0] < 4 * len(edges), most
