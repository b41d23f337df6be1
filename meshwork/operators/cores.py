"""The two-core: what is left when molecules with one neighbour go, again and again.

Peeling leaf by leaf takes as many rounds as the longest pendant path has molecules, each over the whole
graph. Here a round takes chains: edges that meet in molecules of two neighbours. A chain with a loose end
goes as a whole; one between two branching molecules becomes a single edge of the next round's graph; a
closed one stays for good. So a round's graph has branching molecules only and pendant paths of any length
cost one round; the rounds follow how deeply trees branch, and each is smaller than the last. In the end
the edges that are left are unfolded, round by round, into those that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.components import connected, contracted
from meshwork.operators.graph import pairs, with_nodes
from meshwork.sources.storage import saved

MOST_ROUNDS = 60


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select("edge", F.explode(F.array("a", "b")).alias("node"))


def chained(edges: DataFrame) -> DataFrame | None:
    """edge, chain (its smallest edge), kind (loose, closed or between) and a, b (the branching molecules that a chain
    lies between) of each edge; None if there is no loose end. edges: edge, a, b; they may be parallel, and loops."""
    ends = ends_of(edges)
    low = ends.groupBy("node").agg(F.count("*").alias("degree"), F.min("edge").alias("one"), F.max("edge").alias("other")).where("degree <= 2")
    low = saved(low, "low")
    if low.where("degree = 1").isEmpty():
        return None
    # Neighbours in a chain are often numbered alike, so that a task joins many links on its own.
    links = low.where("degree = 2 and one <> other").select(F.col("other").alias("a"), F.col("one").alias("b"))
    roots = connected(contracted(links.repartition(F.shiftright("b", 16))), "chains").withColumnRenamed("node", "edge")
    of = edges.join(roots, "edge", "left").select("edge", F.coalesce("root", "edge").alias("chain"))
    loose = low.where("degree = 1").select(F.col("one").alias("edge"), F.lit(True).alias("loose"))
    far = ends.join(low.select("node"), "node", "left_anti").groupBy("edge").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
    known = saved(of.join(loose.distinct(), "edge", "left").join(far, "edge", "left"), "chains")
    facts = known.groupBy("chain").agg(F.max("loose").alias("loose"), F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    kind = F.when(F.col("loose"), "loose").when(F.col("n").isNull(), "closed").otherwise("between")
    return saved(known.select("edge", "chain").join(facts.select("chain", kind.alias("kind"), "a", "b"), "chain"), "chains")


def core_edges(edges: DataFrame) -> DataFrame:
    """edge: those of edges (edge: a number of its own, a, b) in the two-core."""
    now, rounds = edges, []
    for _ in range(MOST_ROUNDS):
        found = chained(now)
        if found is None:
            break
        rounds.append(found)
        between = found.where("kind = 'between'")
        # Of a chain's edges, which all know its ends, the one that names it stands for it.
        now = between.where("edge = chain").select("edge", "a", "b")
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    left = now.select("edge")
    for found in reversed(rounds):
        kept = found.where("kind = 'between'").join(left.withColumnRenamed("edge", "chain"), "chain", "left_semi").select("edge")
        left = kept.unionAll(found.where("kind = 'closed'").select("edge"))
    return left


def two_core(bonds: DataFrame) -> DataFrame:
    """case_id, molecule_a, molecule_b, multiplicity of the pairs in the two-core."""
    every = saved(pairs(bonds).repartition("case_id", F.shiftright("molecule_a", 16)).withColumn("edge", F.monotonically_increasing_id()), "pairs")
    kept = core_edges(with_nodes(every).select("edge", "a", "b"))
    return every.join(kept, "edge", "left_semi").drop("edge")
