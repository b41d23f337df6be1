"""Equality of two partitions of molecules up to names: stored membership against recomputed components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.numbering import with_group


def contingency(stored: DataFrame, parts: DataFrame) -> DataFrame:
    """case_id, label, root, n: molecules that have both. stored: case_id, molecule, cluster_id (the label); parts:
    case_id, molecule, root. Rows that repeat count once."""
    labels = stored.select("case_id", "molecule", F.col("cluster_id").alias("label")).distinct()
    return labels.join(parts.select("case_id", "molecule", "root"), ["case_id", "molecule"]).groupBy("case_id", "label", "root").agg(F.count("*").cast("long").alias("n"))


def differences(met: DataFrame, names: DataFrame, small: bool = False) -> DataFrame:
    """case_id, label, root, molecules, kind: the cells of a contingency in which the partitions differ. split: several
    labels share a component; merged: a label has several components; mixed: both; renamed: the same molecules under
    another label than names (case_id, root, cluster_id) give. met is read several times. small: a task can hold any case."""
    by_label = met.groupBy("case_id", "label").agg(F.count("*").alias("roots"))
    by_root = met.groupBy("case_id", "root").agg(F.count("*").alias("labels"))
    rows = with_group(met, by_label.withColumn("rows", F.col("roots")), ["case_id", "label"], "rows", small)
    rows = with_group(rows, by_root.withColumn("rows", F.col("labels")), ["case_id", "root"], "rows", small)
    several = lambda c: F.col(c) > 1
    kind = F.when(several("labels") & several("roots"), "mixed").when(several("labels"), "split").when(several("roots"), "merged")
    named = rows.withColumn("kind", kind).join(names.select("case_id", "root", "cluster_id"), ["case_id", "root"])
    named = named.withColumn("kind", F.coalesce("kind", F.when(F.col("label") != F.col("cluster_id"), "renamed")))
    return named.where("kind is not null").select("case_id", "label", "root", F.col("n").alias("molecules"), "kind")


def membership_faults(stored: DataFrame, members: DataFrame) -> DataFrame:
    """case_id, rule, bad_count (where there are any): stored rows (case_id, molecule, cluster_id, cluster_size,
    bond_degree) against those worked out anew: missing, unknown and repeated molecules, other sizes and degrees."""
    copies = stored.groupBy("case_id", "molecule").agg(F.count("*").alias("n"), F.min("cluster_size").alias("size"), F.max("cluster_size").alias("most"), F.min("bond_degree").alias("degree"), F.max("bond_degree").alias("highest"))
    met = copies.join(members.select("case_id", "molecule", "cluster_size", "bond_degree"), ["case_id", "molecule"], "full_outer")
    c = F.col
    both = c("n").isNotNull() & c("cluster_size").isNotNull()
    rules = {
        "missing": c("n").isNull(),
        "unknown": c("cluster_size").isNull(),
        "repeated": c("n") > 1,
        "size": both & ((c("size") != c("cluster_size")) | (c("most") != c("cluster_size"))),
        "degree": both & ((c("degree") != c("bond_degree")) | (c("highest") != c("bond_degree"))),
    }
    names = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items())), lambda n: n.isNotNull())
    return met.select("case_id", F.explode(names).alias("rule")).groupBy("case_id", "rule").agg(F.count("*").cast("long").alias("bad_count"))
