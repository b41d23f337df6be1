"""Integrity rules as data: one row per case and rule with the number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalars import ratio
from meshwork.operators.graph import pairs

ARMS = 4


def bond_violations(bonds: DataFrame) -> DataFrame:
    """case_id, rule, bad_count, for every case and rule. Molecules of type A have even numbers."""
    per_row = bonds.groupBy("case_id").agg(
        F.count_if(F.col("endpoint_a") >= F.col("endpoint_b")).alias("order"),
        F.count_if((F.expr(f"endpoint_a div {ARMS}") != F.col("molecule_a")) | (F.expr(f"endpoint_b div {ARMS}") != F.col("molecule_b"))).alias("owner"),
        F.count_if((F.col("molecule_a") % 2 != 0) | (F.col("molecule_b") % 2 != 1)).alias("type"),
    )
    # Numbers have to be 0, 1, ...: repeated ones count, and those that are left out or below zero.
    ids = bonds.groupBy("case_id", "bond_id").agg(F.count("*").alias("n"))
    k = F.col("bond_id")
    numbering = ids.groupBy("case_id").agg((F.sum(F.col("n") - 1) + F.greatest(F.max(k), F.lit(-1)) + 1 - F.count_if(k >= 0) + F.count_if(k < 0)).alias("numbering"))
    ends = bonds.select("case_id", F.explode(F.array("endpoint_a", "endpoint_b")).alias("endpoint"))
    reused = ends.groupBy("case_id", "endpoint").count().groupBy("case_id").agg(F.count_if(F.col("count") > 1).alias("endpoint_reuse"))
    many = pairs(bonds).groupBy("case_id").agg(F.count_if(F.col("multiplicity") > ARMS).alias("multiplicity"))
    wide = per_row.join(numbering, "case_id").join(reused, "case_id").join(many, "case_id")
    names = ["order", "owner", "type", "numbering", "endpoint_reuse", "multiplicity"]
    return wide.unpivot(["case_id"], names, "rule", "bad_count").select("case_id", "rule", F.col("bad_count").cast("long"))


def coverage(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: conditions that are missing, and unknown ones."""
    parts = [a.select(*keys).distinct().exceptAll(b.select(*keys).distinct()).withColumn("problem", F.lit(p)) for a, b, p in ((expected, found, "missing"), (found, expected, "unknown"))]
    return reduce(DataFrame.unionByName, parts)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").cast("long").alias("copies")).where("copies > 1")


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of a full outer join whose values differ, a missing row included: keys, a_value.., b_value.."""
    left = a.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values))
    right = b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values))
    same = reduce(lambda x, y: x & y, (F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in values))
    return left.join(right, keys, "full_outer").where(~same)


def broken(rows: DataFrame, keys: list[str], rules: dict) -> DataFrame:
    """keys, rule: the rules (name -> condition that has to hold) that a row breaks; an undefined one is broken."""
    names = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return rows.select(*keys, F.explode(F.filter(names, lambda n: n.isNotNull())).alias("rule"))


def sample_violations(rows: DataFrame) -> DataFrame:
    """Sample rows whose numbers contradict each other."""
    c = F.col
    return broken(rows, ["case_id"], {
        "bonds": c("h1") + 2 * c("h2") + 3 * c("h3") + 4 * c("h4") == c("bonds"),
        "double_share": F.abs(ratio(c("h2"), c("molecules")) - c("p") * 2 * ratio(c("h2"), c("bonds"))) <= 1e-8,
        "range": (2 * c("h2") <= c("bonds")) & (c("bonds") <= 2 * c("molecules")) & (c("h2") >= 0),
        "largest": F.abs(c("largest_fraction") - ratio(c("largest"), c("molecules"))) <= 1e-8,
        "sizes": (c("second_largest") <= c("largest")) & (c("largest") + c("second_largest") <= c("molecules")) & (c("isolated_molecules") <= c("clusters")) & (c("clusters") <= c("molecules")),
    })


def cycle_violations(rows: DataFrame) -> DataFrame:
    """Per case the clusters whose cycle counts can't be."""
    c, bad = F.col, lambda x: F.count_if(x).cast("long")
    return rows.groupBy("case_id").agg(
        bad((c("c4_edge") < c("c4_mol")) | (c("c6_edge") < c("c6_mol"))).alias("fewer_edge_cycles"),
        bad((c("b4") > c("bonds")) | (c("b6") > c("bonds"))).alias("too_many_bonds"),
        bad(((c("c4_mol") > 0) != (c("b4") > 0)) | ((c("c6_mol") > 0) != (c("b6") > 0))).alias("unmatched"),
    )


def graph_violations(bonds: DataFrame, parts: DataFrame) -> DataFrame:
    """case_id, rule, bad_count (where there are any): bonds against clusters (parts: case_id, molecule, root)."""
    placed = bonds
    for side in "ab":
        placed = placed.join(parts.select("case_id", F.col("molecule").alias(f"molecule_{side}"), F.col("root").alias(f"root_{side}")), ["case_id", f"molecule_{side}"], "left")
    c, every = F.col, F.col("bonds")
    inside = placed.groupBy("case_id", c("root_b").alias("root")).agg(
        F.count("*").alias("bonds"), F.count_if(~c("root_a").eqNullSafe(c("root_b"))).alias("apart"), F.count_if((c("molecule_a") - c("molecule_b")) % 2 == 0).alias("same_type")
    )
    # Bonds outside of any cluster, and clusters without a bond, count too; the former have no size.
    sizes = parts.groupBy("case_id", "root").agg(F.count("*").alias("size"))
    counted = sizes.join(inside, ["case_id", "root"], "full_outer").fillna(0, ["bonds", "apart", "same_type"])
    degree = bonds.select("case_id", F.explode(F.array("molecule_a", "molecule_b")).alias("molecule")).groupBy("case_id", "molecule").agg(F.count("*").alias("n"))
    clusters = {"apart": F.sum("apart"), "same_type": F.sum("same_type"), "too_few": F.count_if(every < c("size") - 1), "too_many": F.count_if(every > 2 * c("size")), "lone": F.count_if((c("size") == 1) & (every > 0))}
    found = ((counted, clusters), (degree, {"degree": F.count_if(c("n") > ARMS)}))
    per = (rows.groupBy("case_id").agg(*(n.cast("long").alias(rule) for rule, n in rules.items())).unpivot(["case_id"], list(rules), "rule", "bad_count") for rows, rules in found)
    return reduce(DataFrame.unionByName, per).where("bad_count > 0")


def candidate_violations(found: DataFrame) -> DataFrame:
    """case_id, rule, bad_count: ends out of order, endpoints with over 24 candidates, repeated pairs."""
    # A row counts for its pair and for each of its ends, so that candidates are worked out once for all rules.
    c, row = F.col, lambda pair, a, b: F.struct(F.lit(pair).alias("pair"), a.alias("a"), b.alias("b"))
    nowhere = F.lit(None).cast(found.schema["endpoint_b"].dataType)
    each = found.select("case_id", F.explode(F.array(row(True, c("endpoint_a"), c("endpoint_b")), row(False, c("endpoint_a"), nowhere), row(False, c("endpoint_b"), nowhere))).alias("r"))
    counts = each.select("case_id", "r.*").groupBy("case_id", "pair", "a", "b").agg(F.count("*").alias("n"))
    rules = {"order": F.coalesce(F.sum(F.when(c("pair") & (c("a") >= c("b")), c("n"))), F.lit(0)), "crowded": F.count_if(~c("pair") & (c("n") > 24)), "repeated": F.count_if(c("pair") & (c("n") > 1))}
    return counts.groupBy("case_id").agg(*(n.cast("long").alias(rule) for rule, n in rules.items())).unpivot(["case_id"], list(rules), "rule", "bad_count")


def trajectory_violations(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gaps (numbers that don't follow), jumps (not to a neighbouring site), crossings (sites left and found
    again), mixed (types): of paths with any. steps: keys, step, x, y, z, type; equal rows count once."""
    rows = steps.distinct()
    by = Window.partitionBy(*keys).orderBy("step", "x", "y", "z", "type")
    for c in ("step", "x", "y", "z"):
        rows = rows.withColumn(f"{c}0", F.lag(c).over(by))
    moved = sum((F.abs(F.col(c) - F.col(f"{c}0")) for c in "xyz"), F.lit(0))
    per = rows.groupBy(*keys).agg(
        F.count_if(F.col("step") != F.col("step0") + 1).cast("long").alias("gaps"),
        F.count_if(moved != 1).cast("long").alias("jumps"),
        (F.count("*") - F.count_distinct("x", "y", "z")).cast("long").alias("crossings"),
        (F.count_distinct("type") > 1).cast("int").alias("mixed"),
    )
    return per.where("gaps + jumps + crossings + mixed > 0")


def layout_faults(relation: DataFrame, sizes: list[int], percents: list[int]) -> DataFrame:
    """size, percent, problem: of a keyed relation (size, percent, scope, size_low, size_high, n, total): repeated keys,
    contributions that can't be (n not from 1 to total), fractions that are no whole percent, and conditions that the
    layout of sizes by percents has and the relation has not, or the other way round."""
    c = F.col
    key = ["size", "percent", "scope", "size_low", "size_high"]
    odd = relation.select("size", "percent", F.when(c("percent").isNull(), "percent").when(~F.coalesce(c("n").between(1, c("total")), F.lit(False)), "contribution").alias("problem")).where("problem is not null").distinct()
    again = relation.groupBy(*key).count().where("count > 1").select("size", "percent", F.lit("repeated").alias("problem")).distinct()
    expected = relation.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sizes))).alias("size")).select("size", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    return odd.unionByName(again).unionByName(coverage(relation.where("percent is not null"), expected, ["size", "percent"]))


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a, unless a and b do not have the same conditions: then reading it fails, with the first that is alone."""
    alone = coverage(a, b, keys).agg(F.min(F.to_json(F.struct(*keys, "problem"))).alias("alone"))
    checked = a.crossJoin(F.broadcast(alone))
    return checked.where(F.when(F.col("alone").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("not aligned: "), F.col("alone"))).cast("boolean"))).drop("alone")


def replicates(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """keys, samples: the conditions that have not exactly as many samples."""
    return rows.groupBy(*keys).agg(F.count("*").cast("long").alias("samples")).where(F.col("samples") != expected)


def moment_faults(samples: DataFrame, histogram: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """case_id, rule: sample rows whose numbers are not those of their histogram (case_id, size, count) of cluster
    sizes, up to tolerance, relative or absolute; a moment is undefined in both or in none."""
    s, n = F.col("size"), F.col("count")
    per = histogram.groupBy("case_id").agg(
        F.sum(n).alias("of_clusters"), F.sum(s * n).alias("of_molecules"), F.max("size").alias("of_largest"), F.max_by("count", "size").alias("ties"),
        F.sum(s * s * n).alias("squares"), F.coalesce(F.sum(F.when(s == 1, n)), F.lit(0)).alias("of_isolated"),
    )
    c = F.col
    top, all_top = c("of_largest"), c("of_largest") * c("ties")
    want = {
        "largest_fraction": ratio(top, c("of_molecules")),
        "size_mean": ratio(c("of_molecules"), c("of_clusters")),
        "weighted_all": ratio(c("squares"), c("of_molecules")),
        "weighted_excl_one": ratio(c("squares") - top * top, c("of_molecules") - top),
        "weighted_excl_all_tied": ratio(c("squares") - top * all_top, c("of_molecules") - all_top),
    }
    rows = samples.join(per, "case_id", "left")
    rules = {name: (c(name) == c(f"of_{name}")) for name in ("clusters", "molecules", "largest")} | {"isolated_molecules": c("isolated_molecules") == c("of_isolated")}
    rules |= {name: (c(name).isNull() & x.isNull()) | (F.abs(c(name) - x) <= tolerance * F.greatest(F.lit(1.0), F.abs(x))) for name, x in want.items()}
    return broken(rows, ["case_id"], rules)
