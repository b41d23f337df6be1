"""Compact viewer documents: one JSON text a case, of positional arrays.

{"format", "hasBonds", "molecules": [[id, type, x, y, z, [arm, arm, arm, arm]], ...], "bonds": [[a, b, arm_a, arm_b],
...]}, an arm as a flat list of coordinates from its first step on. A document is taken apart as a variant, so
that values of the wrong kind become faults of that document instead of nulls; steps, ends and components
are worked out anew by the operators for tables, never taken from the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators import graph, trajectories
from meshwork.operators.spatial import REACH
from meshwork.sources.storage import saved

CASE = ["case_id"]


def written(steps: DataFrame, bonds: DataFrame, form: str) -> DataFrame:
    """case_id, value: the documents. steps: as trajectories has them; bonds: case_id, molecule and arm of both ends."""
    point = lambda p: F.concat_ws(",", p["x"], p["y"], p["z"])
    paths = steps.where("arm >= 0").groupBy("case_id", "molecule", "arm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "x", "y", "z"))), point), ",").alias("path"))
    arms = paths.groupBy("case_id", "molecule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arm", "path"))), lambda a: F.concat(F.lit("["), a["path"], F.lit("]"))), ",").alias("arms"))
    centre = steps.where("arm = -1").join(arms, ["case_id", "molecule"])
    row = F.format_string('[%d,"%s",%d,%d,%d,[%s]]', "molecule", "type", "x", "y", "z", "arms")
    listed = lambda rows, key, text: rows.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text.alias("t")))), lambda m: m["t"]), ",").alias("list"))
    molecules = listed(centre, F.col("molecule").alias("k"), row)
    pairs = listed(bonds, F.struct("molecule_a", "arm_a").alias("k"), F.format_string("[%d,%d,%d,%d]", "molecule_a", "molecule_b", "arm_a", "arm_b")).withColumnRenamed("list", "pairs")
    text = F.concat(F.lit(f'{{"format":"{form}","hasBonds":true,"molecules":['), "list", F.lit('],"bonds":['), F.coalesce("pairs", F.lit("")), F.lit("]}"))
    return molecules.join(pairs, "case_id", "left").select("case_id", text.alias("value"))


class Documents:
    """documents: case_id, value (text). Frames of what they hold; faults: case_id, fault."""

    def __init__(self, documents: DataFrame, form: str):
        get = F.try_variant_get
        docs = documents.select("case_id", F.try_parse_json("value").alias("v"))
        head = docs.select("case_id", F.col("v").isNull().alias("text"), get("v", "$.format", "string").alias("format"), get("v", "$.hasBonds", "boolean").alias("has"), get("v", "$.molecules", "array<variant>").alias("m"), get("v", "$.bonds", "array<variant>").alias("b"))
        shape = F.col("has").isNull() | F.col("m").isNull() | (F.size("m") < 1) | F.col("b").isNull() | (~F.col("has") & (F.size("b") > 0)) | ~F.col("format").eqNullSafe(form)
        wrong = head.select("case_id", F.when(F.col("text"), "text").when(shape, "format").alias("fault")).where("fault is not null")
        row = head.select("case_id", F.posexplode("m").alias("at", "r"))
        whole = lambda x: F.coalesce((x >= 0) & (x == F.floor(x)), F.lit(False))
        item = row.select("case_id", "at", get("r", "$[0]", "double").alias("id"), get("r", "$[1]", "string").alias("type"), F.array(*(get("r", f"$[{k}]", "double") for k in (2, 3, 4))).alias("centre"), get("r", "$[5]", "array<array<double>>").alias("arms"), get("r", "$[6]", "string").isNotNull().alias("more"))
        good = whole(F.col("id")) & F.coalesce(F.col("type").isin("A", "B"), F.lit(False)) & F.forall("centre", whole) & ~F.col("more")
        good = good & F.coalesce((F.size("arms") == 4) & F.forall("arms", lambda a: (F.size(a) > 0) & (F.size(a) % 3 == 0) & F.forall(a, whole)), F.lit(False))
        item = saved(item.withColumn("good", good), "compact")
        broken = item.where("not good").select("case_id", F.lit("molecule").alias("fault"))
        kept = item.where("good").select("case_id", F.col("id").cast("long").alias("molecule"), "type", "centre", "arms")
        again = kept.groupBy("case_id", "molecule").count().where("count > 1").select("case_id", F.lit("repeated id").alias("fault"))
        centre = kept.select("case_id", "molecule", "type", F.lit(-1).cast("long").alias("arm"), F.lit(0).cast("long").alias("step"), F.col("centre").alias("p"))
        arm = kept.select("case_id", "molecule", "type", F.posexplode("arms").alias("arm", "flat"))
        point = F.transform(F.sequence(F.lit(0), F.size("flat") - 1, F.lit(3)), lambda k: F.slice("flat", k + 1, 3))
        step = arm.select("case_id", "molecule", "type", F.col("arm").cast("long").alias("arm"), F.posexplode(point).alias("k", "p"))
        every = centre.unionByName(step.select("case_id", "molecule", "type", "arm", (F.col("k") + 1).cast("long").alias("step"), "p"))
        self.steps = every.select("case_id", "molecule", "type", "arm", "step", *(F.get("p", F.lit(k)).cast("long").alias(c) for k, c in enumerate("xyz")))
        pair = saved(head.select("case_id", F.posexplode("b").alias("bond_id", "r")).select("case_id", "bond_id", get("r", "$", "array<double>").alias("q")), "compact")
        fine = F.coalesce((F.size("q") == 4) & F.forall("q", whole), F.lit(False))
        self.bonds = pair.where(fine).select("case_id", F.col("bond_id").cast("long"), *(F.get("q", F.lit(k)).cast("long").alias(c) for k, c in enumerate(("molecule_a", "molecule_b", "arm_a", "arm_b"))))
        odd = pair.where(~fine).select("case_id", F.lit("bond").alias("fault"))
        self.molecules = kept.select("case_id", "molecule").distinct()
        self.faults = wrong.unionByName(broken).unionByName(again).unionByName(odd).unionByName(self.step_faults()).unionByName(self.bond_faults()).distinct()

    def step_faults(self) -> DataFrame:
        found = trajectories.judged(self.steps)
        kinds = F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in ("lengths", "jumps")))
        own = found.select("case_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("fault"))
        other = self.steps.groupBy("case_id").agg(F.count_distinct(F.when(F.col("arm") == 0, F.col("step"))).alias("n"))
        lengths = self.steps.where("arm >= 0").groupBy("case_id", "molecule", "arm").agg(F.count("*").alias("n")).join(other.withColumnRenamed("n", "most"), "case_id").where("n <> most").select("case_id", F.lit("lengths").alias("fault"))
        shared = self.steps.groupBy("case_id", "x", "y", "z").count().where("count > 1").select("case_id", F.lit("sites").alias("fault"))
        return own.unionByName(lengths).unionByName(shared)

    def bond_faults(self) -> DataFrame:
        points = trajectories.ends(self.steps)
        met = self.bonds
        for s in "ab":
            met = met.join(points.select("case_id", F.col("molecule").alias(f"molecule_{s}"), F.col("arm").alias(f"arm_{s}"), F.struct("type", "x", "y", "z").alias(f"end_{s}")), ["case_id", f"molecule_{s}", f"arm_{s}"], "left")
        far = trajectories.far(F.col("end_a"), F.col("end_b"))
        target = F.col("end_a").isNull() | F.col("end_b").isNull() | (F.col("molecule_a") == F.col("molecule_b")) | (F.col("end_a.type") == F.col("end_b.type"))
        kinds = F.array(F.when(target, F.lit("target")), F.when(F.coalesce(~far.between(1, REACH), F.lit(False)), F.lit("reach")))
        rows = met.select("case_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("fault"))
        used = self.bonds.select("case_id", F.explode(F.array(*(F.struct(F.col(f"molecule_{s}").alias("m"), F.col(f"arm_{s}").alias("arm")) for s in "ab"))).alias("e")).groupBy("case_id", "e").count().where("count > 1")
        return rows.unionByName(used.select("case_id", F.lit("reuse").alias("fault")))

    def summary(self) -> DataFrame:
        """Of each faultless document: molecules, bonds, occupied sites, arm length, and components worked out anew."""
        good = self.molecules.select("case_id").distinct().join(self.faults, "case_id", "left_anti")
        molecules, bonds, steps = (rows.join(good, "case_id", "left_semi") for rows in (self.molecules, self.bonds, self.steps))
        parts = graph.members(bonds, molecules)
        sizes = parts.groupBy("case_id", "root").agg(F.count("*").alias("n")).groupBy("case_id", "n").agg(F.count("*").alias("clusters"))
        groups = sizes.groupBy("case_id").agg(F.sum("clusters").cast("long").alias("clusters"), F.sum(F.col("n") * F.col("clusters")).cast("long").alias("molecules"), F.max("n").alias("largest"), F.max_by("clusters", "n").alias("tied"))
        of = steps.groupBy("case_id").agg(F.count("*").alias("occupied"), F.max("step").alias("arm_length"))
        held = bonds.groupBy("case_id").agg(F.count("*").alias("bonds"))
        return groups.join(of, "case_id").join(held, "case_id", "left").fillna(0, ["bonds"]).select("case_id", "molecules", "bonds", "occupied", "arm_length", "clusters", "largest", "tied")
