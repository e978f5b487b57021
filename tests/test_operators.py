from pyspark.sql import functions as F

from tallywood.functions import text as T
from tallywood.operators import extract, ledger, matching, sequence, snapshot
from tallywood.sources import files
from tallywood.streaming import history


def test_snapshot_changes_by_precedence_and_nulls(spark):
    a = spark.createDataFrame([(1, "u", "A"), (2, "u", None), (3, "d", "B"), (4, "d", "C")], "k int, face string, grade string")
    b = spark.createDataFrame([(1, "d", "B"), (2, "u", None), (3, "d", "C"), (5, "u", "A")], "k int, face string, grade string")
    got = {r.k: r.change for r in snapshot.compare(a, b, "k", [("face", "face"), ("grade", "regraded")]).collect()}
    assert got == {1: "face", 2: "same", 3: "regraded", 4: "removed", 5: "added"}


def test_ratchet_never_raises(spark):
    n = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0), ("d", 3)], "k string, n long")
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("e", 4)], "k string, ceiling long")
    got = {r.k: (r.verdict, r.next_ceiling) for r in ledger.ratcheted(n, c, "k").collect()}
    assert got == {"a": ("over", 1), "b": ("ok", 1), "c": ("can tighten", 0), "d": ("no ceiling", 3), "e": ("can tighten", 0)}
    texts = spark.createDataFrame([("3",), (" 4 ",), ("x",), (None,), ("1.5",)], "t string")
    assert [r.c for r in texts.select(ledger.ceiling_number(F.col("t")).alias("c")).collect()] == [3, 4, 0, 0, 0]


def test_history_with_a_zero_base(spark):
    rows = [("f", 1, "pass", 100.0, "long bound here"), ("f", 2, "fail", 400.0, "short"), ("f", 3, "fail", 0.0, "short"), ("f", 4, "pass", 5.0, "short"), ("g", 1, None, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, at int, result string, metric double, bound string")
    got = {(r.k, r.at): (r.moved, r.delta, r.worth_a_look, r.bound_shrunk) for r in sequence.with_previous(df, ["k"], ["at"]).collect()}
    assert got == {("f", 1): ("nothing to compare", None, False, False), ("f", 2): ("REGRESSION", 300.0, True, True), ("f", 3): ("same", -400.0, True, False), ("f", 4): ("improved", 5.0, False, False), ("g", 1): ("nothing to compare", None, False, False)}


def test_unmatched_cancels_the_first_copies(spark):
    now = spark.createDataFrame([("f", "x", i) for i in (3, 5, 9)] + [("f", "y", 1), ("g", "x", 2)], "file string, what string, line int")
    base = spark.createDataFrame([("f", "x", 1), ("f", "x", 2), ("f", "z", 7)], "file string, what string, line int")
    assert sorted(tuple(r) for r in matching.unmatched(now, base, ["file", "what"], "line").collect()) == [("f", "x", 9), ("f", "y", 1), ("g", "x", 2)]


def test_as_of_and_stale_and_smallest(spark):
    probes = spark.createDataFrame([("a", 5, "p"), ("a", 1, "q"), ("b", 9, "r")], "k string, at int, name string")
    versions = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 7, 70)], "k string, at int, v int")
    assert {r.name: r.v for r in sequence.as_of(probes, versions, ["k"], "at", "v").collect()} == {"p": 50, "q": None, "r": None}
    regions = spark.createDataFrame([("f", 4, 1, 34), ("f", 48, 18, 78), ("f", 9, 200, 400)], "path string, id int, lo int, hi int")
    hunks = spark.createDataFrame([("f", 6, 1), ("f", 150, 300), ("g", 20, 1)], "path string, start int, len int")
    for bucket in (1, 64):
        assert {r.id: r.hits for r in sequence.stale(regions, hunks, bucket).collect()} == {4: 1, 9: 1}
    many = spark.range(500).select(F.lit("k").alias("k"), (F.col("id") * 37 % 500).alias("v"))
    assert [tuple(r) for r in sequence.smallest(many, ["k"], "v", 3).collect()] == [("k", [0, 1, 2], 500)]


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    s = F.lit
    assert one(T.slug(s("  Añ b! C "))) == "a-b-c" and one(T.slug(s("--"))) == "unnamed" and one(T.route_slug(s("/"))) == "root"
    assert one(T.longest_fixed(s("/a/{id}/long/:x/b"))) == "/long/"
    assert one(T.normal_path(s("a/./b//c"))) == "a/b/c" and one(T.normal_path(s("a/../b"))) is None
    assert one(T.numbers(s("a 1.5 b 20"))) == [1.5, 20.0] and one(T.skeleton(s("x1 = 1.5, y2 = -2e3"))) == "x1 = #, y2 = #" and one(T.numbers(s("a -5 b-3 1e2"))) == [-5.0, 3.0, 100.0]
    assert one(T.segments(s("cfg.maxRetryCount_ms"))) == ["max", "retry", "count", "ms"]
    assert one(T.direction(s("maxDelay"), s("x = "), s(";"))) == "up" and one(T.direction(s("a"), s("a >= "), s(""))) == "down" and one(T.direction(s("a"), s(""), s(" > a"))) == "up"
    assert one(T.direction(s("max"), s("a == "), s(""))) is None and one(T.direction(s("minOfMax"), s(""), s(""))) is None
    assert one(T.blob_id(F.encode(s("abc"), "UTF-8"))) == "f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f"
    assert one(T.face(s("User - all"))) == "user" and one(T.face(s("whoever"))) is None
    assert one(T.in_scope(s("src/a/b.py"), "*.py, docs/*")) and not one(T.in_scope(s("src/a.js"), "*.py"))
    assert one(T.is_binary(F.unhex(s("610062")))) and not one(T.is_binary(F.unhex(s("6001"))))
    assert one(T.line_of(s("a\nb\nc"), F.lit(2))) == 2 and one(T.kind(s("x.txt"), s("#!/bin/sh"))) == "code"
    assert one(T.generated(s("a.js"), s("x" * 3000))) == "long line" and one(T.later_day(s("2024-02-01T"), s("2024-01-31"))) is True


def test_extractors(spark):
    df = spark.createDataFrame([("a.md", "[x](one.md)\n```\n[no](two.md)\n```\n![i](img.png) [y](three.md)"), ("package.json", '{"scripts":{"t":"run"}}'), ("deep/er/package.json", '{"scripts":{"u":"x"}}'), ("s.js", "app.get('/a', f); router.post(\"/b/:id\", g); process.env.MY_KEY"), ("m.py", "import os\nfrom a.b import c\nos.environ['TOKEN']\ndef test_one(): pass"), ("app/(x)/shop/page.tsx", ""), ("pages/api/h.ts", ""), ("d.diff", "@@ -3 +4,2 @@\n@@ -10,5 +12,0 @@")], "path string, text string")
    assert [(r.line, r.target) for r in extract.markdown_links(df).orderBy("line").collect()] == [(1, "one.md"), (5, "three.md")]
    assert [tuple(r) for r in extract.package_scripts(df).collect()] == [("package.json", "t", "run")]
    assert [(r.method, r.route) for r in extract.express_routes(df).collect()] == [("GET", "/a"), ("POST", "/b/:id")]
    assert {r.name for r in extract.environment_names(df).collect()} == {"MY_KEY", "TOKEN"}
    assert [(r.name, r.line) for r in extract.python_imports(df).collect()] == [("os", 1), ("a.b", 2)]
    assert [r.route for r in extract.page_routes(df).collect()] == ["/shop"]
    assert [tuple(r)[1:] for r in extract.diff_hunks(df).collect()] == [(0, 3, 1, 4, 2), (1, 10, 5, 12, 0)]
    assert [r.name for r in extract.declared_tests(df).collect()] == ["test_one"]


def test_trees(spark, tmp_path):
    for p, b in (("a.txt", b"one\r\ntwo"), ("b/c.txt", b"x"), (".git/x", b"no"), ("node_modules/y.js", b"no"), ("z.bin", b"a\0b")):
        f = tmp_path / "t" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    got = {r.path: (r.text, r.skip_reason) for r in files.read_tree(spark, f"file://{tmp_path}/t").collect()}
    assert got == {"a.txt": ("one\ntwo", None), "b/c.txt": ("x", None), "z.bin": (None, "binary")}
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "l\r\n")], "path string, text string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "l\n"), ("f", "new")], "path string, text string")
    assert sorted((r.path, r.status, r.old_path) for r in files.changes(a, b).collect()) == [("b", "modified", None), ("d", "renamed", "c"), ("f", "added", None)]


def test_streaming_keeps_the_last_capture(spark, tmp_path):
    schema = "key string, seq long, result string, metric double"
    rows = [("a", 1, "pass", 1.0), ("a", 2, "fail", 3.0), ("b", 1, "fail", 1.0), ("a", 3, "pass", 2.0), ("b", 2, "pass", None), ("b", 3, "pass", 4.0)]
    for i, part in enumerate((rows[:1], rows[1:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = history.analysed(stream).writeStream.format("memory").queryName("captures").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.seq, r.moved, r.metric, r.delta) for r in spark.table("captures").collect())
    assert [g[:2] for g in got] == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)] and got[3][2] == "nothing to compare"
    assert [g[3:] for g in got if g[0] == "b"] == [(1.0, None), (None, None), (4.0, None)]  # as in with_previous
    want = sequence.with_previous(spark.createDataFrame(rows, schema).withColumn("bound", F.lit(None).cast("string")), ["key"], ["seq"])
    assert {(r.key, r.seq): (r.moved, r.delta) for r in want.collect()} == {g[:2]: (g[2], g[4]) for g in got}


def test_prose_with_nulls_and_empty_texts(spark):
    from tallywood.operators import notes

    t = spark.createDataFrame([(1, None), (2, ""), (3, "see a/b.py:3 and web.dev:443, a/b.py:3-4"), (4, "9:5 x:1")], "id long, text string")
    got = notes.pointers(t, t.select(F.lit("x").alias("path")))
    assert sorted((r.id, r.path, r.first, r.last, r.stamp, r.there) for r in got.collect()) == [(3, "a/b.py", 3, 3, None, False), (3, "a/b.py", 3, 4, None, False), (4, "x", 1, 1, None, True)]
    assert [r.p for r in t.select(notes.phrases(F.col("text")).alias("p")).collect()] == [[], [], [], []]
    lines = spark.createDataFrame([("f", 1, None), ("f", 2, "# mark-begin"), ("f", 3, "# mark-begin"), ("f", 4, ""), ("g", 12, "# mark"), ("g", 13, "# mark-begin"), ("g", 14, "# mark-end"), ("h", 2, "# mark"), ("h", 3, "# mark-end")], "file string, line int, text string")
    spans = notes.fixture_spans(lines, "file", "line", "text", "^# mark(-begin|-end)?$")
    assert sorted(tuple(r) for r in spans.collect()) == [("f", 2, 4), ("g", 13, 14), ("h", 1, 3)]
    assert notes.opens_block(lines, "file", "line", "text").filter("opens").count() == 0
    assert notes.deployments(spark.createDataFrame([("a/Dockerfile", None), ("Procfile", None)], "path string, text string")).count() == 1


def test_smallest_reads_its_rows_once(spark):
    from tallywood.operators import sequence as S

    rows = S.smallest(spark.range(100).selectExpr("id % 3 AS g", "id AS v"), ["g"], "v", 4)
    assert sorted((r.g, r.first, r.n) for r in rows.collect()) == [(g, [g, g + 3, g + 6, g + 9], 34 - (g > 0)) for g in range(3)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {r.g: (r["first"], r.n) for r in S.smallest(spark.range(2).selectExpr("id AS g", "id AS v"), ["g"], "v", 0).collect()} == {0: ([], 1), 1: ([], 1)}
