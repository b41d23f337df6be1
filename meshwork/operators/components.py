"""Connected components of an edge table, by alternating large-star and small-star steps
(Kiveris and others, "Connected Components in MapReduce and Beyond", 2014).

Every step is a grouped minimum, which Spark combines before the shuffle, and a join of the edges
with one minimum per node; no node's neighbours are ever gathered. A node with over one HOT-th of all
edges, of which there are fewer than 2 * HOT, gets its minimum by broadcast, so that its edges stay where
they are. Each round is written to the shared folder, which cuts the lineage, and the round before is deleted;
counts for the test of convergence are taken while it is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshwork.sources.storage import dropped, saved_at

MOST_ROUNDS = 60
HOT = 256
#: Edges that a task contracts at once.
EDGES_AT_ONCE = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with at most one edge a node: (node, smallest node of its component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        for ends in (i, j, label[i], label[j]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges a, b (long) with the same components: a forest for every so many edges of a partition."""

    def run(batches):
        held, size = [], 0

        def out():
            columns = [np.concatenate(c) for c in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(*columns)], ["a", "b"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size > EDGES_AT_ONCE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return edges.select("a", "b").where("a is not null and b is not null").mapInArrow(run, "a long, b long")


def contracted_groups(edges: DataFrame, group: str) -> DataFrame:
    """Columns group, a, b (long) of a forest as connected's node and root, with no step beyond a task: no component of edges (group, a, b)
    reaches into two groups, and none of these has over EDGES_AT_ONCE edges. Edges dealt out by group stay where they are."""

    def run(rows: pa.Table) -> pa.Table:
        found = forest(*(rows.column(c).to_numpy() for c in ("a", "b")))
        return pa.Table.from_arrays([pa.array([rows.column("group")[0].as_py()] * len(found[0]), pa.int64()), *(pa.array(x, pa.int64()) for x in found)], ["group", "a", "b"])

    rows = edges.select(F.col(group).alias("group"), "a", "b").where("a is not null and b is not null")
    return rows.groupBy("group").applyInArrow(run, "group long, a long, b long")


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: columns a and b. Returns node, root for each node with an edge to another one, the root
    itself left out; root is the smallest node of the component. Null ends and loops are ignored;
    edges may repeat, in either direction."""
    now, path, mark = marked(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(MOST_ROUNDS):
        if mark == before or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, old = mark, path
        now, path, mark = marked(small_star(large_star(now, mark["n"] / HOT)), name)
        dropped(edges.sparkSession, old)
    raise RuntimeError(f"no fixpoint after {MOST_ROUNDS} rounds")


def marked(edges: DataFrame, name: str) -> tuple[DataFrame, str, dict]:
    """edges, saved, where, and their number and a sum of their hashes."""
    seen = Observation()
    watched = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    return *saved_at(watched, name), seen.get


def large_star(edges: DataFrame, hot: float) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of the node and its neighbours. a > b.
    hot: the number of edges above which a node's minimum is broadcast."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "degree")
    up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    hubs = least.where(F.col("degree") > hot).select("u", F.col("m").alias("hub"))
    split = up.join(F.broadcast(hubs), "u", "left")
    far = split.where("hub is null").join(least.where(F.col("degree") <= hot).select("u", "m"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return far.unionAll(split.where("hub is not null").select(F.col("v").alias("a"), F.col("hub").alias("b")))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest neighbour. a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least.select(F.col("a").alias("u"), "m"), F.col("a") == F.col("u")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
