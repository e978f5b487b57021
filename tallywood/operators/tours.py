"""The order in which to read a graph of files, and the tests that depend on its hubs.

What entries reach is found for strongly connected components, whose nodes all reach the same, and the depth of a node
for its first entry alone: no table has a row for each entry and node. Only the entries themselves, with the
components whose programs drive theirs, meet in one task, to be put in order.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut, cycles, degrees, ranked, shared_dir


def reaches(edges: DataFrame, entries: DataFrame, reverse: bool = False) -> DataFrame:
    """(entry, node, depth, via): what each of entries (node) reaches, itself included, breadth first; via is the neighbour that reached a
    node first, as in graph.walk."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = cut(edges.select(F.col(a).alias("at"), F.col(b).alias("node")).distinct())
    start = entries.select(F.col("node").alias("entry"), "node").distinct()
    seen = cut(start.select("entry", "node", F.lit(0).alias("depth"), F.col("node").alias("via"), F.lit(1).alias("rank")))
    front, depth = seen, 0
    while True:
        depth += 1
        met = step.join(front.select("entry", F.col("node").alias("at"), "rank"), "at").groupBy("entry", "node").agg(F.min(F.struct("rank", "at")).alias("m"))
        order = F.row_number().over(Window.partitionBy("entry").orderBy("m.rank", "node"))
        new = cut(met.join(seen, ["entry", "node"], "left_anti").select("entry", "node", F.lit(depth).alias("depth"), F.col("m.at").alias("via"), order.alias("rank")))
        if not new.limit(1).count():
            return seen.select("entry", "node", "depth", F.when(F.col("depth") > 0, F.col("via")).alias("via"))
        seen, front = cut(seen.unionByName(new)), new


def test_dependents(edges: DataFrame, hubs: DataFrame, tests: DataFrame) -> DataFrame:
    """(node, n_tests): for each of hubs (node), the tests (node) that depend on it, over any number of edges."""
    found = reaches(edges, hubs, reverse=True).filter("depth > 0").join(tests.select("node").distinct(), "node", "left_semi")
    return hubs.select("node").distinct().join(found.groupBy(F.col("entry").alias("node")).agg(F.count(F.lit(1)).alias("n_tests")), "node", "left").select("node", F.coalesce("n_tests", F.lit(0)).alias("n_tests"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, part): the strongly connected component of each node of edges and of nodes (node), by its smallest node; one alone is its own."""
    found = cycles(edges)
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(nodes.select("node")).distinct()
    return cut(ends.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("part")))


def descendants(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """(top, part): what each of tops (top) reaches over edges (src, dst), itself included. A round's rows are written once, beside those before."""
    spark, step = edges.sparkSession, cut(edges.select("src", "dst").distinct())
    path = f"{shared_dir(spark)}/reach-{uuid.uuid4().hex}"
    new = cut(tops.select("top", F.col("top").alias("part")).distinct())
    while new.limit(1).count():
        new.write.mode("append").parquet(path)
        seen = spark.read.schema(new.schema).parquet(path)
        met = new.join(step.withColumnRenamed("src", "part"), "part").select("top", F.col("dst").alias("part")).distinct()
        new = cut(met.join(seen, ["top", "part"], "left_anti"))
    return spark.read.schema(new.schema).parquet(path) if tops.limit(1).count() else new


def depths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth): the fewest edges from any of starts (node). A round's rows are written once, beside those before."""
    spark, step = edges.sparkSession, cut(edges.select("src", "dst"))
    path, depth = f"{shared_dir(spark)}/depth-{uuid.uuid4().hex}", 0
    new = cut(starts.select("node", F.lit(0).alias("depth")).distinct())
    schema = new.schema
    while new.limit(1).count():
        new.write.mode("append").parquet(path)
        depth += 1
        met = step.join(new.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = cut(met.join(spark.read.schema(schema).parquet(path), "node", "left_anti").select("node", F.lit(depth).alias("depth")))
    return spark.read.schema(schema).parquet(path) if depth else new


def _emitted(entries: DataFrame) -> DataFrame:
    """(node, turn) of entries (node, nth, part, program, drivers): by nth, but the programs that drive an entry are read before it.

    Those are the programs of drivers, parts that are told once for each part, at its first entry. Once an entry has been begun
    it is never begun again, so each part's programs are passed through once, however many entries they drive.
    """
    kind = entries.schema["node"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("nth", "part", "program", "drivers")), strict=True), key=lambda r: r[0])
        part = {n: p for n, p, _, _ in rows}
        programs: dict = {}
        for n, p, is_program, _ in rows:
            if is_program:
                programs.setdefault(p, []).append(n)
        drivers = {p: sorted(d, key=lambda x: programs[x][0]) for _, p, _, d in rows if d}
        at, begun, turn = dict.fromkeys(programs, 0), set(), {}

        def following(p) -> int | None:
            """The first program not yet begun that drives the entries of p."""
            best, left = None, []
            parts = drivers.get(p, [])
            for i, d in enumerate(parts):
                own = programs[d]
                while at[d] < len(own) and own[at[d]] in begun:
                    at[d] += 1
                if at[d] == len(own):
                    continue
                if best is not None and own[0] > best:
                    left += parts[i:]
                    break
                left.append(d)
                best = own[at[d]] if best is None else min(best, own[at[d]])
            drivers[p] = left
            return best

        for first, _, _, _ in rows:
            if first in begun:
                continue
            stack = [first]
            begun.add(first)
            while stack:
                if (n := following(part[stack[-1]])) is not None:
                    begun.add(n)
                    stack.append(n)
                else:
                    turn[stack.pop()] = len(turn) + 1
        return pa.table({"node": t["node"], "turn": pa.array([turn[n] for n in t["nth"].to_pylist()], pa.int64())})

    return entries.groupBy(F.lit(1).alias("all")).applyInArrow(run, f"node {kind}, turn long")  # entries only, not what they reach


def tour(edges: DataFrame, nodes: DataFrame, steps: int = 20) -> DataFrame:
    """(nth, node, why, entry, depth): the order in which to read nodes (node, first, program, page, test), booleans.

    First come the front pages (first), then each entry by the size of what it reaches, programs before pages before others, then by
    name, followed by what it reaches that hasn't come yet, the nearest and most used first; then what no entry reaches; tests
    come last. An entry is a node that is a program or a page, or that no node but tests depends on and that has edges of its own.
    It comes after a program that it reaches and that carries half or more of its reach. steps 0 is all.
    """
    n = cut(nodes)
    code = n.filter("NOT test").select("node")
    inner = cut(edges.select("src", "dst").distinct().join(code.withColumnRenamed("node", "src"), "src", "left_semi").join(code.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    used, uses = inner.select(F.col("dst").alias("node")).distinct(), inner.select(F.col("src").alias("node")).distinct()
    roots = uses.join(used, "node", "left_anti").withColumn("root", F.lit(True))
    entry = cut(n.filter("NOT test AND NOT first").join(roots, "node", "left").filter("program OR page OR root").select("node", "program", "page"))
    # all that lie on cycles with each other reach the same: what reaches what is told for components, not for entries and nodes
    of = components(inner, entry)
    between = inner.join(of.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    placed_in = cut(entry.join(of, "node"))
    below = descendants(between, placed_in.select(F.col("part").alias("top")))
    size = cut(below.join(of.groupBy("part").agg(F.count(F.lit(1)).alias("c")), "part").groupBy(F.col("top").alias("part")).agg((F.sum("c") - 1).alias("size")))
    tier = F.when(F.col("program"), 0).when(F.col("page"), 1).otherwise(2)
    sized = cut(ranked(placed_in.join(size, "part").withColumns({"tier": tier, "less": -F.col("size")}), ["less", "tier", "node"], "nth"))
    programs = sized.filter("tier = 0").select("part", F.col("size").alias("own")).distinct()
    drivers = below.join(programs, "part").join(size.withColumnRenamed("part", "top"), "top").filter("own * 2 >= size").groupBy(F.col("top").alias("part")).agg(F.collect_list("part").alias("drivers"))
    told = sized.groupBy("part").agg(F.min("nth").alias("nth")).join(drivers, "part").select("nth", "drivers")
    turns = cut(_emitted(sized.join(told, "nth", "left").select("node", "nth", "part", (F.col("tier") == 0).alias("program"), "drivers")))
    earliest = turns.join(of, "node").groupBy(F.col("part").alias("top")).agg(F.min(F.struct("turn", F.col("node").alias("entry"))).alias("m"))
    owner = below.join(earliest, "top").groupBy("part").agg(F.min("m").alias("m"))
    owned = cut(of.join(owner, "part").select("node", "m.turn", "m.entry"))
    # what lies on the way from the first entry to a node has the same first entry, so depths need only the edges within
    inside = inner.join(owned.select(F.col("node").alias("src"), F.col("turn").alias("a")), "src").join(owned.select(F.col("node").alias("dst"), F.col("turn").alias("b")), "dst").filter("a = b")
    first = owned.join(depths(inside, owned.filter("node = entry")), "node").select("node", F.struct("turn", "entry", "depth").alias("m"))
    rows = n.join(first, "node", "left").join(degrees(edges), "node", "left")
    group = F.when(F.col("first"), 0).when(F.col("test"), 3).when(F.col("m").isNotNull(), 1).otherwise(2)
    why = F.when(group == 0, "front page").when(group == 3, "test").when(group == 2, "not reached").when(F.col("m.depth") == 0, "entry").otherwise("reached")
    users = F.when(group.isin(1, 2), -F.coalesce("in_degree", F.lit(0).cast("long"))).otherwise(0)
    placed = rows.select("node", group.alias("g"), F.when(group == 1, F.col("m.turn")).alias("turn"), F.when(group == 1, F.col("m.entry")).alias("entry"), F.when(group == 1, F.col("m.depth")).alias("depth"), users.alias("u"), why.alias("why"))
    out = ranked(placed, ["g", "turn", "depth", "u", "node"], "nth")
    return (out.filter(F.col("nth") <= steps) if steps else out).select("nth", "node", "why", "entry", "depth")
