import random
from collections import Counter, deque

import pytest

from tallywood.operators import graph as G
from tallywood.plans import graphs, registry


def made(spark, edges):
    return spark.createDataFrame([(a, b, "import") for a, b in edges], "src string, dst string, kind string")


def fifo(edges, sources):
    out, queue = {s: (0, None) for s in sorted(sources)}, deque(sorted(sources))
    while queue:
        at = queue.popleft()
        for a, b in sorted(set(edges)):
            if a == at and b not in out:
                out[b] = (out[at][0] + 1, at)
                queue.append(b)
    return out


def test_walk_has_the_parents_of_a_queue(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {x.node: (x.depth, x.via) for x in G.walk(made(spark, edges), ["n3", "n1"]).collect()}
    assert got == fifo(edges, ["n1", "n3"])
    near = {x.node for x in G.walk(made(spark, edges), ["n1"], reverse=True, max_depth=1).collect()}
    assert near == {"n1"} | {a for a, b in edges if b == "n1"}


def test_path_forward_backward_none_and_unknown(spark):
    e = made(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    nodes = e.selectExpr("src node").union(e.selectExpr("dst node"))
    assert [(r.node, r.way) for r in G.path(e, nodes, "a", "c").orderBy("step").collect()] == [("a", "forward"), ("b", "forward"), ("c", "forward")]
    assert {r.way for r in G.path(e, nodes, "c", "a").collect()} == {"backward"}
    assert G.path(e, nodes, "a", "y").count() == 0
    with pytest.raises(G.UnknownNode):
        G.path(e, nodes, "a", "nowhere")


def test_cycles_are_strong_components(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("g", "a"), ("h", "h")]
    got = {r.node: r.component for r in G.cycles(made(spark, edges)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}
    assert G.cycles(made(spark, [("a", "b")])).count() == 0


def modularity(edges, of):
    """In units of 1 / (2 m) ** 2."""
    degree, total = Counter(), 2 * len(edges)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    mass = Counter()
    for n, k in degree.items():
        mass[of[n]] += k
    return sum(2 for a, b in edges if of[a] == of[b]) * total - sum(m * m for m in mass.values())


@pytest.mark.parametrize("small_pairs", [0, 10**6])
def test_clusters_on_all_machines_and_in_one_task(spark, small_pairs):
    r = random.Random(9)
    edges = sorted({(f"g{g}n{r.randrange(12):02d}", f"g{g}n{r.randrange(12):02d}") for g in range(5) for _ in range(40)} | {(f"g{r.randrange(5)}n{r.randrange(12):02d}", f"g{r.randrange(5)}n{r.randrange(12):02d}") for _ in range(15)})
    edges = sorted({tuple(sorted(e)) for e in edges if e[0] != e[1]})
    got = {x.node: x.community for x in G.clusters(made(spark, edges), small_pairs).collect()}
    names = sorted({n for e in edges for n in e})
    place, around = {n: i for i, n in enumerate(names)}, [{} for _ in names]
    for a, b in edges:
        around[place[a]][place[b]] = around[place[b]][place[a]] = 1
    one = G.moved_alone(around, [0] * len(names))
    assert set(got) == set(names) and all(min(n for n in got if got[n] == c) == c for c in set(got.values()))
    assert modularity(edges, got) >= 0.9 * modularity(edges, {n: one[place[n]] for n in names})
    planted = modularity(edges, {n: n[:2] for n in names})
    assert modularity(edges, got) >= 0.9 * planted


def test_clusters_in_parts_take_few_rounds(spark, monkeypatch):
    r = random.Random(4)
    edges = sorted({tuple(sorted((f"g{g:02d}n{r.randrange(15):02d}", f"g{g:02d}n{r.randrange(15):02d}"))) for g in range(12) for _ in range(50)} | {tuple(sorted((f"g{r.randrange(12):02d}n{r.randrange(15):02d}", f"g{r.randrange(12):02d}n{r.randrange(15):02d}"))) for _ in range(40)})
    edges = [e for e in edges if e[0] != e[1]]
    sweeps, passes = [], []
    sweep, part = G.settled, G.dealt
    monkeypatch.setattr(G, "settled", lambda w: sweeps.append(w.count()) or sweep(w))
    monkeypatch.setattr(G, "dealt", lambda w, n: passes.append(w.count()) or part(w, n))
    got = {x.node: x.community for x in G.clusters(made(spark, edges), 400, 150).collect()}
    names = sorted({n for e in edges for n in e})
    place, around = {n: i for i, n in enumerate(names)}, [{} for _ in names]
    for a, b in edges:
        around[place[a]][place[b]] = around[place[b]][place[a]] = 1
    one = G.moved_alone(around, [0] * len(names))
    assert passes and all(n < passes[0] for n in sweeps)  # the whole graph isn't swept
    assert set(got) == set(names) and all(min(n for n in got if got[n] == c) == c for c in set(got.values()))
    assert modularity(edges, got) >= 0.9 * modularity(edges, {n: one[place[n]] for n in names})


def test_estimates_stay_small_over_many_rounds(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(240)] + [("n240", "n000")]
    labels = G.closure_labels(made(spark, edges))
    assert {x.label for x in labels.collect()} == {"n000"}
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 30


def test_clusters_part_two_cliques(spark):
    edges = [(f"{s}{i}", f"{s}{j}") for s in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    got = {r.node: r.community for r in G.clusters(made(spark, edges)).collect()}
    assert got == {f"{s}{i}": f"{s}0" for s in "ab" for i in range(5)}


def test_ranked_numbers_all_rows(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "v long")
    assert [r.rank for r in G.ranked(df, ["v"]).orderBy("v").collect()] == list(range(1, 301))


def test_clusters_query_sees_all_error_events(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'error'").orderBy("ts", "event_id").collect()
    users = [r.user_id for r in rows]
    want = sorted((a, b) for a, b in zip(users[:-1], users[1:], strict=True) if a != b)
    assert sorted((r.src, r.dst) for r in graphs.user_edges(spark, sf).collect()) == want
    assert {r.node for r in registry.QUERIES["graph_clusters"](spark, sf).collect()} == {x for e in want for x in e}


def test_clusters_join_communities_until_none_gains(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(15)]
    got = {r.node: r.community for r in G.clusters(made(spark, edges)).collect()}
    assert len(got) == 16 and all(min(n for n in got if got[n] == c) == c for c in set(got.values()))
    mass = {c: sum((n in e) for e in edges for n in got if got[n] == c) for c in set(got.values())}
    for a in mass:
        for b in mass:
            between = sum({got[x], got[y]} == {a, b} for x, y in edges)
            assert a == b or between * 2 * len(edges) <= mass[a] * mass[b]
