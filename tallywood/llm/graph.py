"""Connected components of a link table: its tasks thin it to forests, and joins or, where little is left, one task do the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, removed

#: So many links of forests, 16 bytes each, are joined up by one task; more by rounds of joins.
SMALL_LINKS = 500_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of the links between a and b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while len(x):  # the roots of links take the smaller root, and then all take their root's
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = lo != hi
        x, y = x[apart], y[apart]
        np.minimum.at(label, hi[apart], lo[apart])
        while not np.array_equal(up := label[label], label):
            label = up
    return nodes, nodes[label]


def stars(most: int):
    """Links in, links out with the same components: of each most links or so, one link from each node to the smallest it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def thinned() -> np.ndarray:
            node, root = smallest_reached(*np.concatenate(held, axis=1))
            return np.stack([node, root])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns[:2]]))
            if sum(x.shape[1] for x in held) >= most:
                held = [thinned()]
                if held[0].shape[1] >= most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in thinned()], names=["a", "b"])

    return run


def components(links: DataFrame, few: int = SMALL_LINKS) -> DataFrame:
    """(node, component) for the nodes of links (a long, b long): component is the smallest node reachable.

    Each task first replaces its links by stars. If few or fewer are left, which is counted, one task joins them up. Else rounds of joins do.

    In each round a node takes the smallest label of its neighbours, and then that of the node its
    label names, so labels travel twice as far each time. Rounds end when no label changes. Each
    round's labels are written, so a lost executor costs one round at most, and removed once the next are there.
    """
    spark = links.sparkSession
    fixed, held = fresh_path(spark, "links"), fresh_path(spark, "labels")
    links = cut(links.select("a", "b").filter("a <> b").mapInArrow(stars(few), "a long, b long"), fixed)
    if links.limit(few + 1).count() <= few:
        found = cut(links.coalesce(1).mapInArrow(stars(2 * few + 2), "node long, component long"))
        removed(spark, fixed)
        return found
    both = cut(links.union(links.select("b", "a")).filter("a <> b").distinct(), fixed)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), held)
    while True:
        last, held = held, fresh_path(spark, "labels")
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        onward = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = cut(nearer.join(onward, F.col("label") == F.col("via")).select("node", "old", F.least("label", "far").alias("label")), held)
        removed(spark, last)
        moved = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            removed(spark, fixed)
            return labels.select("node", F.col("label").alias("component"))
