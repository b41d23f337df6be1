"""Simple cycles of four and six molecules, from paths of three bonds.

A path starts at the smallest of its molecules. One whose ends are neighbours is a cycle of four; two that
share both ends and nothing else are a cycle of six, so that both lengths come from one table of paths. The
lesser of the first molecule's two neighbours tells the direction, so each cycle is found once. An arm bonds
once, so a molecule has four neighbours at most and starts 36 paths at most: the rows grow with the number
of molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.scalars import ratio, rounded
from meshwork.operators.graph import pairs
from meshwork.sources.storage import saved


def neighbours(bonds: DataFrame) -> DataFrame:
    a, b = F.col("molecule_a"), F.col("molecule_b")
    both = F.array(F.struct(a.alias("molecule_a"), b.alias("molecule_b")), F.struct(b.alias("molecule_a"), a.alias("molecule_b")))
    return pairs(bonds).select("case_id", F.explode(both).alias("p"), "multiplicity").select("case_id", "p.*", "multiplicity")


def halves(bonds: DataFrame) -> DataFrame:
    """case_id, v0..v3, ways: paths of three pairs of neighbours from v0, which is the smallest of the four molecules;
    ways is the product of the multiplicities. Saved, as it serves several searches."""
    steps = neighbours(bonds)
    paths = steps.where("molecule_b > molecule_a").select("case_id", F.col("molecule_a").alias("v0"), F.col("molecule_b").alias("v1"), F.col("multiplicity").alias("ways"))
    for k in (2, 3):
        step = steps.select("case_id", F.col("molecule_a").alias(f"v{k - 1}"), F.col("molecule_b").alias(f"v{k}"), "multiplicity")
        fresh = F.col(f"v{k}") > F.col("v0")
        for j in range(1, k - 1):
            fresh = fresh & (F.col(f"v{k}") != F.col(f"v{j}"))
        paths = paths.join(step, ["case_id", f"v{k - 1}"]).where(fresh).withColumn("ways", F.col("ways") * F.col("multiplicity")).drop("multiplicity")
    return saved(paths.select("case_id", "v0", "v1", "v2", "v3", "ways"), "paths")


def cycles(bonds: DataFrame, length: int, paths: DataFrame | None = None) -> DataFrame:
    """case_id, v0..v(length-1), ways: the molecules around, and the product of their bonds' multiplicities.
    length: 4 or 6. paths: the halves of the bonds, if there already."""
    if length not in (4, 6):
        raise ValueError("length: 4 or 6")
    half = halves(bonds) if paths is None else paths
    if length == 4:
        close = pairs(bonds).select("case_id", F.col("molecule_a").alias("v0"), F.col("molecule_b").alias("v3"), "multiplicity")
        met = half.where("v1 < v3").join(close, ["case_id", "v0", "v3"])
        return met.select("case_id", "v0", "v1", "v2", "v3", (F.col("ways") * F.col("multiplicity")).alias("ways"))
    back = half.select("case_id", "v0", F.col("v1").alias("v5"), F.col("v2").alias("v4"), "v3", F.col("ways").alias("more"))
    met = half.join(back, ["case_id", "v0", "v3"]).where("v1 < v5 and v2 <> v4 and v1 <> v4 and v2 <> v5")
    return met.select("case_id", *(f"v{k}" for k in range(6)), (F.col("ways") * F.col("more")).alias("ways"))


def cycle_counts(bonds: DataFrame, length: int, paths: DataFrame | None = None) -> DataFrame:
    """Per case: cycles of distinct molecules, and of distinct bonds."""
    found = cycles(bonds, length, paths).groupBy("case_id").agg(F.count("*").cast("long").alias("cycles"), F.sum("ways").cast("long").alias("edge_cycles"))
    return bonds.select("case_id").distinct().join(found, "case_id", "left").fillna(0, ["cycles", "edge_cycles"])


def sides(found: DataFrame, length: int) -> DataFrame:
    """The pairs of molecules that are neighbours in some cycle, each once."""
    pair = [F.struct(F.least(f"v{k}", f"v{(k + 1) % length}").alias("molecule_a"), F.greatest(f"v{k}", f"v{(k + 1) % length}").alias("molecule_b")) for k in range(length)]
    return found.select("case_id", F.explode(F.array(*pair)).alias("p")).select("case_id", "p.*").distinct()


def participating(bonds: DataFrame, length: int, paths: DataFrame | None = None) -> DataFrame:
    """Per case: bonds in some cycle of this length, each once, and their share of the endpoints of all molecules."""
    used = sides(cycles(bonds, length, paths), length)
    counts = pairs(bonds).join(used, ["case_id", "molecule_a", "molecule_b"]).groupBy("case_id").agg(F.sum("multiplicity").cast("long").alias("cycle_bonds"))
    every = bonds.groupBy("case_id").agg(F.count("*").cast("long").alias("bonds"))
    rows = every.join(counts, "case_id", "left").fillna(0, ["cycle_bonds"])
    return rows.select("case_id", "bonds", "cycle_bonds", rounded(ratio(F.col("cycle_bonds"), F.col("bonds"))).alias("bond_share"))


def cluster_cycles(bonds: DataFrame, parts: DataFrame, doubles: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """A row a cluster: cycles of molecules and of bonds, bonds in some cycle, and their shares of all arms.
    doubles: the clusters with root, h2 and is_largest. A cycle lies in one cluster, that of its smallest molecule."""
    roots = parts.select("case_id", F.col("molecule").alias("v0"), "root")
    rows = doubles
    multiple = pairs(bonds)
    half = halves(bonds) if paths is None else paths
    for length in (4, 6):
        found = saved(cycles(bonds, length, half), "cycles")
        counts = found.join(roots, ["case_id", "v0"]).groupBy("case_id", "root").agg(F.count("*").cast("long").alias(f"c{length}_mol"), F.sum("ways").cast("long").alias(f"c{length}_edge"))
        used = sides(found, length).join(multiple, ["case_id", "molecule_a", "molecule_b"]).withColumnRenamed("molecule_a", "v0").join(roots, ["case_id", "v0"])
        own = used.groupBy("case_id", "root").agg(F.sum("multiplicity").cast("long").alias(f"b{length}"))
        rows = rows.join(counts, ["case_id", "root"], "left").join(own, ["case_id", "root"], "left")
    rows = rows.fillna(0, ["c4_mol", "c4_edge", "b4", "c6_mol", "c6_edge", "b6"])
    share = lambda a, n=1: rounded(ratio(F.col(a), n * F.col("size")))
    return rows.select(
        "case_id", "cluster_id", "size", "bonds", "h2", "c4_mol", "c6_mol", "c4_edge", "c6_edge", "b4", "b6", "is_largest",
        share("h2").alias("q_h2"), share("b4", 2).alias("q4"), share("b6", 2).alias("q6"), share("c4_mol").alias("c4_per_molecule"), share("c6_mol").alias("c6_per_molecule"),
    )


def cycle_totals(rows: DataFrame) -> DataFrame:
    """Per case: molecules, cycles, and cycles per hundred molecules (not rounded)."""
    per = lambda c: 100 * ratio(F.sum(c), F.sum("size"))
    return rows.groupBy("case_id").agg(F.sum("size").cast("long").alias("molecules"), F.sum("c4_mol").cast("long").alias("c4"), F.sum("c6_mol").cast("long").alias("c6"), per("c4_mol").alias("c4_per_100"), per("c6_mol").alias("c6_per_100"))
