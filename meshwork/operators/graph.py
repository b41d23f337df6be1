"""Molecular multigraphs: multiplicities, degrees, components and what belongs to the largest one.

Frames carry case_id; all cases are worked out together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalars import ratio, rounded
from meshwork.operators.components import EDGES_AT_ONCE, connected, contracted, contracted_groups
from meshwork.operators.numbering import numbered, with_group
from meshwork.sources.storage import saved

#: A node of all cases is case_id * NODES + molecule, or, of cases that are numbered since they have larger numbers or molecules
#: than that has room for, made of their number times WIDE.
NODES, CASES, WIDE = 1 << 24, 1 << 39, 1 << 40


def node(case: Column, molecule: str, below: int) -> Column:
    """Fails on a molecule whose number would reach into another case."""
    beyond = F.raise_error(F.format_string("molecule %d of a case", F.col(molecule))).cast("long")
    return F.when(F.col(molecule).isNull() | F.col(molecule).between(0, below - 1), case * below + F.col(molecule)).otherwise(beyond)


def ranked(cases: DataFrame) -> DataFrame:
    """cases (case_id), which are few, with rank: a number of their own, from 0."""
    return cases.withColumn("rank", (F.row_number().over(Window.orderBy("case_id")) - 1).cast("long"))


def with_nodes(bonds: DataFrame) -> DataFrame:
    """bonds with a, b (long): the ends as nodes of all cases. Nodes of numbered cases are below zero."""
    odd = (F.greatest("molecule_a", "molecule_b") >= NODES) | ~F.col("case_id").between(0, CASES - 1)
    wide = saved(ranked(bonds.where(odd).select("case_id").distinct()), "wide")
    known = bonds.join(F.broadcast(wide), "case_id", "left")
    ends = {e: F.when(F.col("rank").isNull(), node(F.col("case_id"), m, NODES)).otherwise(-1 - node(F.col("rank"), m, WIDE)) for e, m in (("a", "molecule_a"), ("b", "molecule_b"))}
    return known.withColumns(ends).drop("rank")


def pairs(bonds: DataFrame) -> DataFrame:
    """case_id, molecule_a < molecule_b, multiplicity: parallel bonds of an unordered pair."""
    low, high = F.least("molecule_a", "molecule_b"), F.greatest("molecule_a", "molecule_b")
    return bonds.groupBy("case_id", low.alias("molecule_a"), high.alias("molecule_b")).agg(F.count("*").cast("long").alias("multiplicity"))


def multiplicity_histogram(bonds: DataFrame) -> DataFrame:
    """case_id, h1..h4: pairs with exactly that many bonds, and all bonds."""
    return pairs(bonds).groupBy("case_id").agg(*(F.count_if(F.col("multiplicity") == k).cast("long").alias(f"h{k}") for k in range(1, 5)), F.sum("multiplicity").cast("long").alias("bonds"))


def double_bond_shares(bonds: DataFrame, molecules: DataFrame, volume: int) -> DataFrame:
    """Per case h2 and its shares: of the volume, of bonds, of bonded and of all endpoints, of molecules."""
    size = molecules.groupBy("case_id").agg(F.count("*").cast("long").alias("molecules"))
    rows = size.join(multiplicity_histogram(bonds), "case_id", "left").fillna(0, ["h2", "bonds"])
    share = lambda a, b: rounded(ratio(a, b))
    return rows.select(
        "case_id", "molecules", "bonds", "h2",
        share(F.col("h2"), F.lit(volume)).alias("h2_per_volume"),
        share(F.col("h2"), F.col("bonds")).alias("h2_per_bond"),
        share(2 * F.col("h2"), F.col("bonds")).alias("h2_endpoint_fraction_bonded"),
        share(F.col("h2"), F.col("molecules")).alias("h2_endpoint_fraction_all"),
    )


def degrees(bonds: DataFrame, molecules: DataFrame) -> DataFrame:
    """case_id, molecule, bond_degree: bonded arms, zero where there are none."""
    ends = bonds.select("case_id", F.explode(F.array("molecule_a", "molecule_b")).alias("molecule"))
    return molecules.join(ends.groupBy("case_id", "molecule").agg(F.count("*").cast("long").alias("bond_degree")), ["case_id", "molecule"], "left").fillna(0, ["bond_degree"])


def members(bonds: DataFrame, molecules: DataFrame, parts: int | None = None) -> DataFrame:
    """case_id, molecule, root (the component's smallest molecule). Isolated molecules are their own root. parts: the
    number of parts that molecules are dealt out into by case, as the result then is."""
    edges = bonds.select("case_id", F.col("molecule_a").alias("a"), F.col("molecule_b").alias("b"))
    # A case that a task can hold is one task's work and done with it; only larger ones take rounds.
    large = saved(ranked(bonds.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > EDGES_AT_ONCE).select("case_id")), "large")
    far = None
    if not large.isEmpty():
        # Neighbouring molecules of a case come together, so that a task finds most of its components on its own.
        nodes = edges.join(F.broadcast(large), "case_id").select(*(node(F.col("rank"), c, WIDE).alias(c) for c in "ab"))
        found = connected(contracted(nodes.repartition(F.shiftright("a", 16))), "clusters")
        at = found.withColumn("rank", F.expr(f"node div {WIDE}")).join(F.broadcast(large), "rank")
        far = at.select("case_id", *((F.col(c) % WIDE).alias(name) for c, name in (("node", "molecule"), ("root", "root"))))
        edges = edges.join(F.broadcast(large), "case_id", "left_anti")
    roots = contracted_groups(edges, "case_id").select(F.col("group").alias("case_id"), F.col("a").alias("molecule"), F.col("b").alias("root"))
    roots = roots if far is None else roots.unionByName(far)
    if parts:
        roots = roots.repartition(parts, "case_id")
    at = molecules.join(roots, ["case_id", "molecule"], "left")
    return at.select("case_id", "molecule", F.coalesce("root", "molecule").alias("root"))


def clusters(bonds: DataFrame, parts: DataFrame, small: bool = False) -> DataFrame:
    """case_id, root, cluster_id (dense, by smallest molecule), molecule_count, bond_count. A bond counts for the
    cluster that has both its ends; it fails on one whose ends the parts put into two. small: a task can sort any case."""
    sizes = parts.groupBy("case_id", "root").agg(F.count("*").cast("long").alias("molecule_count"))
    ends = bonds
    for side in "ab":
        ends = ends.join(parts.select("case_id", F.col("molecule").alias(f"molecule_{side}"), F.col("root").alias(f"root_{side}")), ["case_id", f"molecule_{side}"])
    agreed = F.when(F.col("root_a") == F.col("root_b"), F.col("root_a")).otherwise(F.raise_error(F.lit("a bond between two clusters")).cast("long"))
    counts = ends.select("case_id", agreed.alias("root")).groupBy("case_id", "root").agg(F.count("*").cast("long").alias("bond_count"))
    rows = sizes.join(counts, ["case_id", "root"], "left").fillna(0, ["bond_count"])
    if small:
        return rows.withColumn("cluster_id", (F.row_number().over(Window.partitionBy("case_id").orderBy("root")) - 1).cast("long"))
    return numbered(rows, ["case_id"], ["root"], "cluster_id")


def cluster_members(parts: DataFrame, summary: DataFrame, degree: DataFrame) -> DataFrame:
    joined = parts.join(summary, ["case_id", "root"]).join(degree, ["case_id", "molecule"])
    return joined.select("case_id", "molecule", "cluster_id", F.col("molecule_count").alias("cluster_size"), "bond_degree")


def network_summary(summary: DataFrame) -> DataFrame:
    """Per case: molecules, bonds, clusters, largest and second largest size, isolated molecules, largest share."""
    # Sizes are counted first: a case's list has one entry per distinct size.
    counts = summary.groupBy("case_id", "molecule_count").agg(F.count("*").alias("n"), F.sum("bond_count").alias("b"))
    top = counts.groupBy("case_id").agg(
        F.sum(F.col("n") * F.col("molecule_count")).cast("long").alias("molecules"),
        F.sum("b").cast("long").alias("bonds"),
        F.sum("n").cast("long").alias("clusters"),
        F.max("molecule_count").alias("largest"),
        F.max_by("n", "molecule_count").alias("ties"),
        F.sort_array(F.collect_list("molecule_count"), asc=False).alias("sizes"),
        F.coalesce(F.sum(F.when(F.col("molecule_count") == 1, F.col("n"))), F.lit(0)).cast("long").alias("isolated_molecules"),
    )
    second = F.when(F.col("ties") > 1, F.col("largest")).when(F.size("sizes") > 1, F.col("sizes")[1]).otherwise(0).cast("long")
    return top.select("case_id", "molecules", "bonds", "clusters", "largest", second.alias("second_largest"), "isolated_molecules", rounded(ratio(F.col("largest"), F.col("molecules"))).alias("largest_fraction"))


def with_largest(summary: DataFrame, small: bool = False) -> DataFrame:
    """is_largest: one cluster a case, of the largest the one of the smallest id; tied: all of the largest size. small:
    a task can hold any case."""
    first = F.max_by("cluster_id", F.struct(F.col("molecule_count"), -F.col("cluster_id")))
    if small:
        case = Window.partitionBy("case_id")
        return summary.withColumns({"is_largest": F.col("cluster_id") == first.over(case), "tied": F.col("molecule_count") == F.max("molecule_count").over(case)})
    top = summary.groupBy("case_id").agg(F.max("molecule_count").alias("top_size"), first.alias("top_id"), F.count("*").alias("top_clusters"))
    marked = with_group(summary, top, ["case_id"], "top_clusters")
    return marked.select(*summary.columns, (F.col("cluster_id") == F.col("top_id")).alias("is_largest"), (F.col("molecule_count") == F.col("top_size")).alias("tied"))


def cluster_doubles(bonds: DataFrame, parts: DataFrame, summary: DataFrame) -> DataFrame:
    """case_id, root, cluster_id, size, bonds, h2, and h2 per molecule and per two bonds."""
    doubled = pairs(bonds).where("multiplicity = 2").join(parts.withColumnRenamed("molecule", "molecule_a"), ["case_id", "molecule_a"])
    h2 = doubled.groupBy("case_id", "root").agg(F.count("*").cast("long").alias("h2"))
    rows = summary.join(h2, ["case_id", "root"], "left").fillna(0, ["h2"])
    return rows.select("case_id", "root", "cluster_id", F.col("molecule_count").alias("size"), F.col("bond_count").alias("bonds"), "h2", rounded(ratio(F.col("h2"), F.col("molecule_count"))).alias("endpoint_fraction_all"), rounded(ratio(2 * F.col("h2"), F.col("bond_count"))).alias("endpoint_fraction_bonded"))
