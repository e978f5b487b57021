"""Operators on typed edges: degrees, reachability, paths, components, communities, tours.

Loops run on the driver and each round is one set of joins; rounds are cut by a table written in the
folder of spark.checkpoint.dir, so a lost executor costs one round. Only counts reach the driver.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The folder of a local session where spark.checkpoint.dir is unset, as in tests.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: that of spark.checkpoint.dir, or a temporary one where it is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all its machines share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-"))
        found = _OWN[0]
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its plan and its estimated size begin anew.

    A checkpoint would keep the estimate of its plan, which each join of a round multiplies.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exported(edges: DataFrame, path: str) -> None:
    """The edges as JSON lines under path, in order over all its files: the same edges give the same lines."""
    names = sorted(edges.columns)
    edges.select(*names).distinct().orderBy(*names).write.mode("overwrite").json(path)


def imported(spark: SparkSession, path: str) -> DataFrame:
    """The edges of an export (src, dst long, kind): answers on them equal those on the graph itself."""
    return spark.read.schema("src long, dst long, kind string").json(path)


class UnknownNode(ValueError):
    """A node that isn't in the graph: refused, never answered with an empty result."""


def merged_edges(refs: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) with their symbols, first line and whether all of their references are inferred.

    refs: src, dst, kind, symbol, line (0: unknown), inferred. Self-edges don't exist.
    """
    return refs.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"), F.min(F.nullif("line", F.lit(0))).alias("line"), F.bool_and("inferred").alias("inferred"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree): distinct neighbours, whatever the kinds of edges."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(pairs.select("src", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def hubs(edges: DataFrame, top: int = 15) -> DataFrame:
    """The nodes with most distinct users: by in, out and name."""
    return degrees(edges).filter("in_degree > 0").orderBy(F.desc("in_degree"), F.desc("out_degree"), "node").limit(top)


def explained(edges: DataFrame, nodes: DataFrame, node) -> DataFrame:
    """The edges out of and into a node."""
    known(nodes, [node])
    out = edges.filter(F.col("src") == F.lit(node)).select(F.lit("out").alias("way"), F.col("dst").alias("other"), "kind")
    return out.unionAll(edges.filter(F.col("dst") == F.lit(node)).select(F.lit("in"), "src", "kind"))


def known(nodes: DataFrame, wanted: list) -> None:
    found = {r.node for r in nodes.filter(F.col("node").isin(wanted)).select("node").distinct().collect()}
    if missing := [w for w in wanted if w not in found]:
        raise UnknownNode(f"not in the graph: {missing}")


def walk(edges: DataFrame, sources: list, reverse: bool = False, max_depth: int = 0) -> DataFrame:
    """(node, depth, via): breadth first from sources; via is the neighbour that reached the node first.

    Nodes of a depth are ranked by the rank of what reached them, then by name, and a node reached by
    several takes the lowest ranked: the parents are those of a first-in first-out queue. max_depth 0 is
    without limit.
    """
    spark: SparkSession = edges.sparkSession
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = cut(edges.select(F.col(a).alias("at"), F.col(b).alias("node")).distinct())
    kind = step.schema["node"].dataType
    seen = spark.createDataFrame([(s, 0, None, i) for i, s in enumerate(sorted(sources), 1)], "node string, depth int, via string, rank long").withColumns({"node": F.col("node").cast(kind), "via": F.col("via").cast(kind)})
    front, depth = seen, 0
    while not max_depth or depth < max_depth:
        depth += 1
        met = step.join(front.select(F.col("node").alias("at"), "rank"), "at").groupBy("node").agg(F.min(F.struct("rank", "at")).alias("m"))
        new = met.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"), F.col("m.at").alias("via"), F.col("m.rank").alias("by"))
        new = cut(ranked(new, ["by", "node"]).drop("by"))
        if not new.limit(1).count():
            break
        seen, front = cut(seen.unionByName(new)), new
    return seen.select("node", "depth", "via")


def ranked(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """df with the place of each row in order, from 1: range partitions are numbered apart, then shifted.

    No window over all rows, so no task has to hold them all.
    """
    w = Window.partitionBy("__part").orderBy(*order)
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy("a.__part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("__before"))  # one row for each partition
    return parts.withColumn(out, F.row_number().over(w)).join(F.broadcast(before), "__part").withColumn(out, (F.col(out) + F.col("__before")).cast("long")).drop("__part", "__before")


def path(edges: DataFrame, nodes: DataFrame, start, goal) -> DataFrame:
    """(step, node, way) of a shortest path from start to goal, else of the one back, else no rows."""
    known(nodes, [start, goal])
    for way, a, b in (("forward", start, goal), ("backward", goal, start)):
        found = {r.node: (r.depth, r.via) for r in _chain(walk(edges, [a]), b)}
        if b in found:
            rows, at = [], b
            while at is not None:
                depth, via = found[at]
                rows.append((depth, at, way))
                at = via
            return edges.sparkSession.createDataFrame(sorted(rows), "step int, node string, way string").withColumn("node", F.col("node").cast(edges.schema["src"].dataType))
    return edges.select(F.lit(0).alias("step"), F.col("src").alias("node"), F.lit("").alias("way")).limit(0)


def _chain(seen: DataFrame, goal) -> list:
    """The rows of seen on the way back from goal: one lookup for each step of the path."""
    seen = cut(seen)
    out, at = [], goal
    while at is not None and (r := seen.filter(F.col("node") == F.lit(at)).first()):
        out.append(r)
        at = r.via
    return out


def closure_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which each can be reached, itself included.

    Labels only fall, so the rounds end by themselves. After each, a node also takes the label of the node that its own
    label names, which reaches it as well; so long ways take few rounds.
    """
    step = cut(edges.select("src", "dst").distinct())
    nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
    labels = cut(nodes.withColumn("label", F.col("node")))
    while True:
        near = step.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        onward = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = cut(nearer.join(onward, F.col("label") == F.col("via")).select("node", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if not new.filter("moved").limit(1).count():
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more; named by the smallest node.

    Forward and backward labels by the smallest node that reaches a node, or that it reaches: where both
    name the same node, it is in that node's component. What is found is taken out, with all nodes that
    can lie on no cycle, and the rest goes round again.
    """
    rest = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    found = None
    while rest.limit(1).count():
        while True:  # nodes without a way in or a way out lie on no cycle
            kept = cut(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if kept.count() == rest.count():
                break
            rest = kept
        if not rest.limit(1).count():
            break
        ahead = closure_labels(rest).withColumnRenamed("label", "a")
        behind = closure_labels(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("label", "b")
        both = ahead.join(behind, "node")
        # edges between nodes of other labels lie on no cycle: both labels are those of a whole component
        members = cut(both.filter("a = b").select("node", F.col("a").alias("component")))
        big = members.join(members.groupBy("component").count().filter("count > 1").select("component"), "component", "left_semi").select("node", "component")
        found = cut(big if found is None else found.unionAll(big))
        tagged = rest.join(both.select(F.col("node").alias("src"), F.struct("a", "b").alias("s")), "src").join(both.select(F.col("node").alias("dst"), F.struct("a", "b").alias("d")), "dst")
        done = members.select(F.col("node").alias("src"))
        rest = cut(tagged.filter("s = d").select("src", "dst").join(done, "src", "left_anti"))
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)


def weights(edges: DataFrame) -> DataFrame:
    """(a, b, w): undirected weights, the number of (src, dst, kind) edges both ways, a row for each direction."""
    e = edges.filter("src <> dst").select("src", "dst", "kind").distinct()
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(e.select("dst", "src"))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


#: A graph with at most so many weighted pairs (a, b, w) is worked in one task; a larger one by sweeps of joins.
SMALL_PAIRS = 400_000


def clusters(edges: DataFrame, small_pairs: int = SMALL_PAIRS, part_pairs: int = SMALL_PAIRS) -> DataFrame:
    """(node, community, size): communities by modularity, each named by its smallest node.

    Nodes move, then communities become the nodes of the next level, until a level moves nothing. While the graph has more
    than small_pairs pairs, no task holds it: a level's nodes move in parts of about part_pairs pairs (dealt), and where
    nothing moves within parts any more, by sweeps over the whole graph until no move gains (settled). Once it has been
    contracted below that, which is counted before, one task finishes it node by node (sequential). All of them only make
    moves that raise the modularity, and lose no edge.
    """
    w = cut(weights(edges))
    of = cut(w.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct())
    while True:
        alone = w.limit(small_pairs + 1).count() <= small_pairs
        labels = cut(sequential(w)) if alone else dealt(w, part_pairs)
        if not alone and not labels.filter("node <> c").limit(1).count():
            labels = settled(w)
        if not labels.filter("node <> c").limit(1).count():
            break
        names = labels.groupBy("c").agg(F.min("node").alias("name"))
        named = cut(labels.join(names, "c").select("node", "name"))
        of = cut(of.join(named.select(F.col("node").alias("community"), "name"), "community").select("node", F.col("name").alias("community")))
        if alone or named.select("name").distinct().count() == named.count():
            break
        ends = w.join(named.select(F.col("node").alias("a"), F.col("name").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("name").alias("y")), "b")
        w = cut(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
    return of.join(of.groupBy("community").agg(F.count(F.lit(1)).alias("size")), "community").select("node", "community", "size")


def moved_alone(around: list[dict[int, int]], inner: list[int]) -> list[int]:
    """The community of each node once no move gains, from nodes apart. around: each node's neighbours and weights; inner: each
    node's weight with itself, both ways."""
    k = [sum(x.values()) + own for x, own in zip(around, inner, strict=True)]
    return moved_from(around, k, sum(k), list(range(len(k))))


def moved_from(around: list[dict[int, int]], k: list[int], total: int, of: list[int]) -> list[int]:
    """The communities of once no move gains: node after node, in their order, to the neighbours' community that gains most
    (ties: the smallest). k: the weight of each node in the graph, total: that of all its nodes."""
    mass: dict[int, int] = {}
    for i, c in enumerate(of):
        mass[c] = mass.get(c, 0) + k[i]
    moving = True
    while moving:
        moving = False
        for i, near in enumerate(around):
            links: dict[int, int] = {of[i]: 0}
            for j, x in near.items():
                links[of[j]] = links.get(of[j], 0) + x
            mass[of[i]] -= k[i]
            gain = {c: x * total - k[i] * mass[c] for c, x in links.items()}
            best = min(links, key=lambda c: (-gain[c], c != of[i], c))  # noqa: B023
            moving |= best != of[i]
            of[i] = best
            mass[best] += k[i]
    return of


def sequential(w: DataFrame) -> DataFrame:
    """(node, c) of a graph that one task can hold, w (a, b, w) both ways: all levels, from nodes apart."""
    node = w.schema["a"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        names = pc.unique(t["a"]).sort()
        place = lambda c: pc.index_in(t[c], names).to_pylist()
        around: list[dict[int, int]] = [{} for _ in names]
        inner = [0] * len(around)
        for i, j, x in zip(place("a"), place("b"), t["w"].to_pylist(), strict=True):
            if i == j:
                inner[i] += x
            else:
                around[i][j] = around[i].get(j, 0) + x
        label = list(range(len(around)))
        while True:
            of = moved_alone(around, inner)
            number = {c: n for n, c in enumerate(dict.fromkeys(of))}
            if len(number) == len(of):
                break
            level = [number[c] for c in of]
            label = [level[x] for x in label]
            larger: list[dict[int, int]] = [{} for _ in number]
            inside = [0] * len(number)
            for i, near in enumerate(around):
                inside[level[i]] += inner[i]
                for j, x in near.items():
                    if level[j] == level[i]:
                        inside[level[i]] += x
                    else:
                        larger[level[i]][level[j]] = larger[level[i]].get(level[j], 0) + x
            around, inner = larger, inside
        first: dict[int, int] = {}
        for i, c in enumerate(label):
            first.setdefault(c, i)
        return pa.table({"node": names, "c": names.take(pa.array([first[c] for c in label]))})

    return w.groupBy(F.lit(1).alias("all")).applyInArrow(run, f"node {node}, c {node}")  # the caller has counted the pairs


def dealt(w: DataFrame, part_pairs: int) -> DataFrame:
    """(node, c) of one level, w (a, b, w) both ways: from nodes apart, by passes until one moves a hundredth of the nodes or fewer.

    A pass deals whole communities over parts and each part moves its nodes, one after the other, among its own communities. All
    members of these are there, so links and masses are exact and every move raises the modularity, whatever other parts
    do. The first pass deals nodes by ranges; later ones send half of the communities, by hash, to that of the
    other half which they are tied to most, unless too many would meet there. A community of more than part_pairs pairs
    rests until it is a node of the next level.
    """
    big = "decimal(38,0)"
    degree = w.groupBy(F.col("a").alias("node")).agg(F.sum("w").cast("long").alias("k"), F.count(F.lit(1)).alias("d"))
    apart = cut(w.filter("a <> b"))
    parts = -(-2 * apart.count() // part_pairs) or 1
    labels = cut(degree.repartitionByRange(parts, "node").select("node", F.col("node").alias("c"), "k", "d", F.spark_partition_id().alias("part")))
    seen = labels.agg(F.sum(F.col("k").cast(big)).alias("total"), F.count(F.lit(1)).alias("nodes")).first()
    total, nodes, name = int(seen.total or 0), seen.nodes, w.schema["a"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        own, pair = t.filter(pc.is_null(t["b"])), t.filter(pc.is_valid(t["b"]))
        own = own.sort_by("a")
        groups = pc.unique(own["c"]).sort()
        of, around = pc.index_in(own["c"], groups).to_pylist(), [{} for _ in range(own.num_rows)]
        place = lambda c: pc.index_in(pair[c], own["a"].combine_chunks()).to_pylist()
        for i, j, x in zip(place("a"), place("b"), pair["w"].to_pylist(), strict=True):
            around[i][j] = x
        new = moved_from(around, own["w"].to_pylist(), total, list(of))
        at = [i for i, c in enumerate(new) if c != of[i]]
        return pa.table({"node": own["a"].combine_chunks().take(pa.array(at, pa.int64())), "to": groups.take(pa.array([new[i] for i in at], pa.int64()))})

    nth = 0
    while True:
        large = labels.groupBy("c").agg(F.sum("d").alias("d")).filter(F.col("d") > part_pairs).select("c")
        at = labels.join(large, "c", "left_anti")
        ends = apart.join(at.select(F.col("node").alias("a"), "part"), "a").join(at.select(F.col("node").alias("b"), "part"), ["b", "part"]).select("part", "a", "b", F.col("w").cast("long").alias("w"), F.lit(None).cast(name).alias("c"))
        alone = at.select("part", F.col("node").alias("a"), F.lit(None).cast(name).alias("b"), F.col("k").alias("w"), "c")
        moves = cut(ends.unionAll(alone).groupBy("part").applyInArrow(run, f"node {name}, to {name}"))
        moved, nth = moves.count(), nth + 1
        labels = cut(labels.join(moves, "node", "left").select("node", F.coalesce("to", "c").alias("c"), "k", "d"))
        if parts == 1 or moved * 100 <= nodes and nth > 1:
            return labels.select("node", "c")
        sizes = cut(labels.groupBy("c").agg(F.sum(F.col("k").cast("double")).alias("mass"), F.sum("d").alias("d")))
        head = lambda c: F.pmod(F.xxhash64(c, F.lit(nth)), F.lit(2)) == 0  # noqa: B023, E731
        ties = apart.join(labels.select(F.col("node").alias("a"), F.col("c").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("c").alias("y")), "b").filter(~head("x") & head("y")).groupBy("x", "y").agg(F.sum("w").alias("w"))
        to = ties.join(sizes.select(F.col("c").alias("y"), "mass"), "y").groupBy(F.col("x").alias("c")).agg(F.max_by("y", F.struct(F.col("w") / F.col("mass"), "y")).alias("key"))
        keyed = cut(sizes.join(to, "c", "left").select("c", "d", F.coalesce("key", "c").alias("key")))
        full = keyed.groupBy("key").agg(F.sum("d").alias("d")).filter(F.col("d") > part_pairs).select("key", F.lit(True).alias("full"))
        part = F.pmod(F.xxhash64(F.when(F.col("full"), F.col("c")).otherwise(F.col("key"))), F.lit(parts)).cast("int")
        labels = cut(labels.join(keyed.join(full, "key", "left").select("c", part.alias("part")), "c"))


def settled(w: DataFrame) -> DataFrame:
    """(node, c) of one level, w (a, b, w) both ways: from nodes apart, until no node gains by a move.

    A sweep lets half of the nodes, by hash, make their best move (ties: the smallest name). Where that
    doesn't raise the modularity, moves are made of which no two touch one community: their gains add up.
    So modularity, in whole numbers, rises with every sweep and the loop ends by itself.
    """
    big = "decimal(18,0)"
    degree = w.groupBy(F.col("a").alias("node")).agg(F.sum("w").cast(big).alias("k"))
    labels = cut(degree.select("node", F.col("node").alias("c"), "k"))
    total = F.lit(int(labels.agg(F.sum("k")).first()[0] or 0)).cast(big)
    apart = cut(w.filter("a <> b"))

    def quality(of: DataFrame) -> int:
        inner = w.join(of.select(F.col("node").alias("a"), F.col("c").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("c").alias("y")), "b").filter("x = y").agg(F.sum("w").cast(big).alias("w"))
        mass = of.groupBy("c").agg(F.sum("k").cast(big).alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("m"))
        got = inner.crossJoin(mass).select((F.coalesce("w", F.lit(0).cast(big)) * total).alias("i"), "m").first()
        return int(got.i or 0) - int(got.m or 0)

    at, sweep = quality(labels), 0
    while True:
        sweep += 1
        mass = labels.groupBy("c").agg(F.sum("k").cast(big).alias("mass"))
        to = apart.join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").cast(big).alias("links"))
        stay = labels.select("node", "c", F.lit(0).cast(big).alias("links"))
        options = to.unionAll(stay).groupBy("node", "c").agg(F.sum("links").cast(big).alias("links")).join(mass, "c").join(labels.select("node", F.col("c").alias("own"), "k"), "node")
        others = (F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(F.lit(0).cast(big))).cast(big)
        gain = F.col("links") * total - F.col("k") * others
        best = options.withColumn("gain", gain).groupBy("node", "own").agg(F.min(F.struct((-F.col("gain")).alias("g"), (F.col("c") != F.col("own")).alias("moves"), "c")).alias("m"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("now"))
        moves = cut(best.filter("m.moves").select("node", "own", F.col("m.c").alias("to"), (F.col("m.g") + F.col("now")).alias("rank")))
        if not moves.limit(1).count():
            return labels.select("node", "c")
        half = moves.filter(F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(2)) == 0)
        new = _moved(labels, half)
        rises = quality(new)
        if rises <= at:
            ends = moves.select("node", "rank", F.explode(F.array("own", "to")).alias("c"))
            first = ends.groupBy("c").agg(F.min(F.struct("rank", "node")).alias("m")).groupBy(F.col("m.node").alias("node")).count().filter("count = 2")
            new = _moved(labels, moves.join(first, "node", "left_semi"))
            rises = quality(new)
        if rises <= at:
            raise RuntimeError("a sweep of gaining moves didn't raise the modularity")
        labels, at = new, rises


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return cut(labels.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "c").alias("c"), "k"))


def tour(edges: DataFrame, entries: list, steps: int = 20) -> DataFrame:
    """(node, entry, depth, in_degree, nth): nodes in the order to read them.

    Entries come by the size of what they reach, then by name; a node belongs to the first entry that
    reaches it; within one entry nodes come by depth, users and name. steps 0 is without limit.
    """
    reach = None
    for e in entries:
        r = walk(edges, [e]).withColumn("entry", F.lit(e))
        reach = r if reach is None else reach.unionByName(r)
    reach = cut(reach)
    order = reach.groupBy("entry").agg(F.count(F.lit(1)).alias("reach"))
    first = reach.join(F.broadcast(order), "entry").groupBy("node").agg(F.min(F.struct((-F.col("reach")).alias("r"), "entry", "depth")).alias("m"))
    rows = first.select("node", F.col("m.r").alias("r"), F.col("m.entry").alias("entry"), F.col("m.depth").alias("depth")).join(degrees(edges), "node", "left").withColumn("d", -F.coalesce("in_degree", F.lit(0)))
    rows = ranked(rows, ["r", "entry", "depth", "d", "node"], "nth")
    return (rows.filter(F.col("nth") <= steps) if steps else rows).select("node", "entry", "depth", F.coalesce("in_degree", F.lit(0).cast("long")).alias("in_degree"), "nth")
