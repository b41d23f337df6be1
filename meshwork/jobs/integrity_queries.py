"""Queries that hold saved tables against each other: trajectories, candidates, bonds, membership, large cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.jobs.integrity_oracles import ORACLES  # noqa: F401
from meshwork.jobs.queries import Network, bonds, query
from meshwork.operators import cores, partitions, spatial, trajectories
from meshwork.sources import views
from meshwork.sources.storage import kept, saved

#: No lattice of trajectories is as large.
UNBOUNDED = 1 << 40


@query
def molecule_faults(spark, folder):
    """Trajectories with planted faults: molecules with any, and how many of each kind."""
    return trajectories.faults(views.faulty_trajectories(spark, folder))


@query
def nested_molecules(spark, folder):
    """Faultless molecules: type, centre, and the paths of the arms as text."""
    rows = trajectories.nested(views.faulty_trajectories(spark, folder))
    site = lambda p: F.concat_ws(" ", p["x"], p["y"], p["z"])
    arms = F.array_join(F.transform("arms", lambda a: F.array_join(F.transform(a, site), ";")), "|")
    return rows.select("case_id", "molecule", "type", site(F.col("centre")).alias("centre"), arms.alias("arms"))


@query
def molecule_ends(spark, folder):
    """The last step of each arm: the endpoints that candidates are sought between."""
    return trajectories.ends(views.faulty_trajectories(spark, folder))


def ends(spark, folder) -> DataFrame:
    """Dealt out by case, a group of orders, so that probes of sites and further joins stay where they are."""
    return kept(spark, folder, ("orders",), "ends", lambda: trajectories.ends(views.trajectories(spark, folder))).repartition("case_id")


def expected(points: DataFrame) -> DataFrame:
    return trajectories.told(spatial.candidates(points, UNBOUNDED, ("case_id",)), points, ["case_id"])


def candidates(spark, folder) -> DataFrame:
    return kept(spark, folder, ("orders",), "candidates", lambda: expected(ends(spark, folder))).repartition("case_id")


def listed(rows: DataFrame) -> DataFrame:
    """Candidates with faults that follow from their numbers: left out, repeated, invented, other fields."""
    k = F.col("endpoint_a")
    other = F.when(F.col("type_b") == "A", "B").otherwise("A")
    changed = rows.where(k % 53 != 7).withColumns({
        "x_a": F.when(k % 59 == 11, F.col("x_a") + 1).otherwise(F.col("x_a")),
        "type_b": F.when(k % 61 == 13, other).otherwise(F.col("type_b")),
        "distance": F.when(k % 67 == 17, 3 - F.col("distance")).otherwise(F.col("distance")),
        "arm_b": F.when(k % 79 == 31, F.col("arm_b") + 4).otherwise(F.col("arm_b")),
    })
    return changed.unionByName(changed.where(k % 71 == 19)).unionByName(changed.where(k % 73 == 23).withColumn("endpoint_b", F.col("endpoint_b") + 4))


@query
def candidate_reconciliation(spark, folder):
    """Listed candidates against those that the trajectories give: missing, invented, repeated, altered by field."""
    found = candidates(spark, folder)
    return trajectories.reconciled(listed(found), found)


@query
def bond_row_faults(spark, folder):
    """Listed pairs as rows of bonds: owner, arm, type, coordinates, reach, distance, ends used again."""
    return trajectories.bond_faults(listed(candidates(spark, folder)), ends(spark, folder))


def stored(members: DataFrame) -> DataFrame:
    """Membership with faults that follow from the numbers: clusters merged, split and renamed, molecules left out,
    repeated and invented, other sizes and degrees."""
    c, m = F.col("cluster_id"), F.col("molecule")
    label = F.when(c % 11 == 3, c - 1).when((c % 13 == 5) & (F.expr("molecule div 2") % 2 == 1), c + 1_000_000).when(c % 17 == 7, c + 5_000_000).otherwise(c)
    # All numbers that a row is stored under come from the row: a union would be dealt out anew.
    under = F.filter(F.array(m, F.when(m % 103 == 29, m), F.when(m % 101 == 31, m + 8_000_000)), lambda x: x.isNotNull())
    return members.where(m % 97 != 13).select(
        "case_id", F.explode(under).alias("molecule"), label.alias("cluster_id"),
        F.when(c % 19 == 11, F.col("cluster_size") + 1).otherwise(F.col("cluster_size")).alias("cluster_size"),
        F.when(m % 89 == 7, F.col("bond_degree") + 1).otherwise(F.col("bond_degree")).alias("bond_degree"),
    )


@query
def partition_differences(spark, folder):
    """Stored clusters against components found anew: which are split, merged, mixed or renamed."""
    net = Network(spark, folder)
    met = saved(partitions.contingency(stored(net.members()), net.parts), "contingency", *net.dealt)
    return partitions.differences(met, net.summary, net.small)


@query
def membership_faults(spark, folder):
    net = Network(spark, folder)
    members = saved(net.members(), "members")
    return partitions.membership_faults(stored(members), members)


@query
def giant_clusters(spark, folder):
    """Clusters of a network of which a third is one case, numbered and marked without a window over the case."""
    return Network(spark, folder, None).summary.select("case_id", "cluster_id", "root", "molecule_count", "bond_count", "is_largest", "tied")


@query
def giant_two_core(spark, folder):
    return cores.two_core(bonds(spark, folder, None))


@query
def giant_partition_differences(spark, folder):
    net = Network(spark, folder, None)
    met = saved(partitions.contingency(stored(net.members()), net.parts), "contingency", *net.dealt)
    return partitions.differences(met, net.summary, net.small)
