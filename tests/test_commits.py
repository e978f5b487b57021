import random

from tallywood.operators import commits as C


def dag(r, n):
    return [(i, p) for i in range(1, n) for p in {r.randrange(max(0, i - 6), i) for _ in range(r.choice([1, 1, 1, 2, 3]))}]


def up(edges, c):
    seen, todo = {c}, [c]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_ancestors_bases_and_trees(spark):
    r = random.Random(6)
    edges = dag(r, 60) + [(101, 100)]
    parents = spark.createDataFrame(edges, "commit long, parent long")
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(25)] + [(5, 101), (7, 7)]
    want = set()
    for a, b in pairs:
        both = up(edges, a) & up(edges, b)
        want |= {(a, b, x) for x in both if not any(x != y and x in up(edges, y) for y in both)}
    got = {(x.left, x.right, x.base) for x in C.merge_bases(parents, spark.createDataFrame(pairs, "left long, right long")).collect()}
    assert got == want and (7, 7, 7) in got and not any(x[0] == 5 and x[1] == 101 for x in got)
    changes = [(i, i, r.choice("abc"), None if r.random() < 0.2 else f"t{i}") for i in range(60)]
    tree = {}
    for root in (3, 40, 59):
        for c, _, path, text in sorted(changes):
            if c in up(edges, root):
                tree[root, path] = (text, c)
    df = spark.createDataFrame(changes, "commit long, seq long, path string, text string")
    roots = spark.createDataFrame([(3,), (40,), (59,)], "root long")
    assert {(x.root, x.path): (x.text, x.commit) for x in C.tree_at(parents, df, roots).collect()} == {k: v for k, v in tree.items() if v[0] is not None}
    first = {(x.root, x.path): x.commit for x in C.path_versions(parents, df, roots).filter("nth = 1").collect()}
    assert all(first[k] == v[1] for k, v in tree.items() if v[0] is not None)


def test_long_histories_and_none(spark):
    chain = spark.range(1, 700).selectExpr("id AS commit", "id - 1 AS parent")
    assert C.ancestors(chain, spark.createDataFrame([(699,), (3,)], "root long")).count() == 704
    assert C.ancestors(chain.limit(0), spark.createDataFrame([(9,)], "root long")).count() == 1


def test_the_base_is_the_first_ref_that_exists(spark):
    refs = spark.createDataFrame([("main", 5), ("master", 4), ("v1", 2)], "name string, commit long")
    asked = spark.createDataFrame([(1, None), (2, "v1"), (3, "gone")], "id int, given string")
    assert {(x.id, x.name, x.commit) for x in C.resolved_base(asked, refs).collect()} == {(1, "main", 5), (2, "v1", 2), (3, "gone", None)}


def test_branches_give_what_the_plain_history_gives(spark):
    """Commits on branches of their own lengths: by places and crossings the same ancestors and bases as by single commits."""
    r = random.Random(11)
    branch, last, edges, crossings = {}, {}, [], []
    for c in range(1, 90):
        b = branch[c] = r.randrange(8)
        others = [x for k, x in last.items() if k != b]
        for p in {*([last[b]] if b in last else []), *r.sample(others, min(len(others), r.choice([0, 0, 1, 2])))}:
            edges.append((c, p))
            if branch[p] != b:
                crossings.append((b, c, branch[p], p))
        last[b] = c
    roots = r.sample(range(1, 90), 20) + list(last.values())
    parents, links = spark.createDataFrame(edges, "commit long, parent long"), spark.createDataFrame(crossings, "branch long, at long, to long, to_at long")
    heads = spark.createDataFrame([(x, branch[x], x) for x in roots], "root long, branch long, at long")
    pairs = spark.createDataFrame(list(zip(roots, roots[1:], strict=False)), "left long, right long")
    changes = spark.createDataFrame([(branch[c], c, c) for c in branch], "branch long, at long, commit long")
    assert {(x.root, x.commit) for x in C.seen_from(links, heads, changes).collect()} == {(x, y) for x in roots for y in up(edges, x)}
    assert sorted((x.left, x.right, x.at) for x in C.branch_bases(links, heads, pairs).collect()) == sorted(map(tuple, C.merge_bases(parents, pairs).collect()))


def odd_history(spark, tmp_path):
    """Two nations and one that isn't told, customers and orders that aren't there, long branches."""
    r = random.Random(4)
    customers = [(c, r.choice([0, 1, None])) for c in range(1, 14) if c != 6]
    orders = [(k, r.randrange(0, 15) or None, r.choice(["F", "F", "O", None]), r.choice("ab"), r.choice([10000.0, 30000.0, None])) for k in range(400)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")


def compared(spark, tmp_path, monkeypatch, name):
    """Rows of the query by Spark and by its SQL, and how many rows its rounds wrote for each order."""
    import duckdb

    from tallywood.operators import graph
    from tallywood.plans import registry

    odd_history(spark, tmp_path)
    wrote, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    monkeypatch.setattr(C, "cut", counted)
    got = registry.QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    for t in ("customer", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr), sum(wrote) / 400


def test_merge_bases_write_few_rows_an_order(spark, tmp_path, monkeypatch):
    got, want, rows = compared(spark, tmp_path, monkeypatch, "merge_bases")
    assert got == want and want and rows < 6


def test_path_versions_write_few_rows_an_order(spark, tmp_path, monkeypatch):
    got, want, rows = compared(spark, tmp_path, monkeypatch, "path_versions")
    assert got == want and want and rows < 6
