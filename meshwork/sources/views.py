"""The driver's tables in the roles of network samples: bonds, molecules, lattice sites, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.operators.numbering import numbered
from meshwork.sources.storage import saved, table

#: (l_orderkey, l_linenumber) repeats; only all columns tell rows apart.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
ARMS = 4
#: Keys a side that a case's molecules have: few make many parallel bonds and cycles, many make small clusters.
DENSE, SPARSE = 16, 800
LATTICE = 24
#: Orders of a block; cases are months by blocks, so that there are more of them, not larger ones, in larger tables.
BLOCK = 15_000
CASES = 1_000_000


def case_id(day: str, order: str) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("long") * CASES + F.expr(f"{order} div {BLOCK}")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with line, a row's place in its order by LINE_ORDER: (l_orderkey, line) sorts as LINE_ORDER does, and
    further shuffles go without its columns."""
    return table(spark, folder, "lineitem").withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


def bonds(spark: SparkSession, folder: str, modulus: int, parts: int) -> DataFrame:
    """case_id, bond_id, endpoint_a, endpoint_b, molecule_a, molecule_b: every line is a bond. The lines of a case
    with one key fill a molecule's arms, then those of a further molecule of that key, so each endpoint has one
    bond. Molecules of type A have even numbers, those of type B odd ones. Dealt out by case into so many parts."""
    each = table(spark, folder, "lineitem").select(case_id("l_shipdate", "l_orderkey").alias("case_id"), "l_orderkey", "l_linenumber", "l_partkey")
    rows = each.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("case_id", (F.col("o_custkey") % modulus).alias("key_a"), "l_orderkey", "l_linenumber", "l_partkey")
    # A case has at most the lines of a block, so it is sorted whole, and all that follows needs no other shuffle.
    rows = rows.repartition(parts, "case_id").withColumn("key_b", F.col("l_partkey") % modulus)
    # Lines of a case that tie here have the same keys, and no other line comes between them in LINE_ORDER: either order
    # of theirs gives the same bonds, if both sides keep to it.
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("case_id").orderBy("l_orderkey", "l_linenumber", "l_partkey")))
    for side in "ab":
        rows = rows.withColumn(f"rank_{side}", (F.row_number().over(Window.partitionBy("case_id", f"key_{side}").orderBy("line")) - 1).cast("long"))
    molecule = {s: (2 * (F.expr(f"rank_{s} div {ARMS}") * modulus + F.col(f"key_{s}")) + odd).cast("long") for odd, s in enumerate("ab")}
    ends = rows.select("case_id", *(molecule[s].alias(f"molecule_{s}") for s in "ab"), *((ARMS * molecule[s] + F.col(f"rank_{s}") % ARMS).alias(f"endpoint_{s}") for s in "ab"))
    bond = (F.row_number().over(Window.partitionBy("case_id").orderBy("endpoint_a")) - 1).cast("long")
    return ends.select("case_id", bond.alias("bond_id"), "endpoint_a", "endpoint_b", "molecule_a", "molecule_b")


def giant(spark: SparkSession, folder: str) -> DataFrame:
    """As bonds, but every third order is of case 0, which so has a third of all bonds; the others are cases by month
    and block. Orders bond with parts of a supplier group, some one line each: one large component, many small
    ones, and long pendant trees. Molecules of a case are numbered densely by type."""
    case = F.when(F.col("l_orderkey") % 3 == 0, F.lit(0).cast("long")).otherwise(case_id("l_shipdate", "l_orderkey"))
    rows = lines(spark, folder).select(case.alias("case_id"), F.col("l_orderkey").alias("key_a"), (F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("key_b"), "line")
    for side in "ab":
        rank = F.row_number().over(Window.partitionBy("case_id", f"key_{side}").orderBy("key_a", "line")) - 1
        rows = rows.withColumn(f"rank_{side}", rank.cast("long")).withColumn(f"more_{side}", F.expr(f"rank_{side} div {ARMS}"))
    rows = saved(rows.drop("line"), "giant")
    for odd, side in enumerate("ab"):
        keys = ["case_id", f"key_{side}", f"more_{side}"]
        number = numbered(rows.select(*keys).distinct(), ["case_id"], keys[1:], "number")
        rows = rows.join(number.select(*keys, (2 * F.col("number") + odd).alias(f"molecule_{side}")), keys)
    ends = rows.select("case_id", *(f"molecule_{s}" for s in "ab"), *((ARMS * F.col(f"molecule_{s}") + F.col(f"rank_{s}") % ARMS).alias(f"endpoint_{s}") for s in "ab"))
    return numbered(ends, ["case_id"], ["endpoint_a"], "bond_id").select("case_id", "bond_id", "endpoint_a", "endpoint_b", "molecule_a", "molecule_b")


def bonded(bond_rows: DataFrame) -> DataFrame:
    """case_id, molecule: those with bonds."""
    return bond_rows.select("case_id", F.explode(F.array("molecule_a", "molecule_b")).alias("molecule")).distinct()


def molecules(bond_rows: DataFrame, modulus: int) -> DataFrame:
    """case_id, molecule: one of each key and type, with or without bonds, and the further ones that have bonds."""
    ends = bond_rows.select("case_id", F.explode(F.array("molecule_a", "molecule_b")).alias("molecule"))
    # The further ones of a case, at most the lines of a block, in an array: a union would be dealt out anew.
    more = ends.groupBy("case_id").agg(F.collect_set(F.when(F.col("molecule") >= 2 * modulus, F.col("molecule"))).alias("more"))
    first = F.sequence(F.lit(0).cast("long"), F.lit(2 * modulus - 1).cast("long"))
    return more.select("case_id", F.explode(F.concat(first, "more")).alias("molecule"))


def faulty(rows: DataFrame) -> DataFrame:
    """Bonds with faults that follow from their numbers: other owners, reused and swapped endpoints, gaps and repeated numbers."""
    k = F.col("bond_id")
    return rows.where(k % 97 != 41).select(
        "case_id",
        F.when(k % 83 == 29, k - 1).otherwise(k).alias("bond_id"),
        F.when(k % 53 == 7, F.col("endpoint_b")).when(k % 59 == 11, F.lit(3).cast("long")).otherwise(F.col("endpoint_a")).alias("endpoint_a"),
        F.when(k % 53 == 7, F.col("endpoint_a")).otherwise(F.col("endpoint_b")).alias("endpoint_b"),
        F.when(k % 61 == 13, F.col("molecule_a") + 2).when(k % 67 == 17, F.col("molecule_a") + 1).otherwise(F.col("molecule_a")).alias("molecule_a"),
        "molecule_b",
    )


def sites(spark: SparkSession, folder: str, size: int = LATTICE) -> DataFrame:
    """case_id, endpoint, x, y, z, site, type, molecule: the occupied sites of a lattice a block of orders. Lines that
    fall on one site are one endpoint, of the first line's type."""
    rows = table(spark, folder, "lineitem").select(
        F.expr(f"l_orderkey div {BLOCK // 5}").alias("case_id"),
        (F.col("l_partkey") % size).cast("long").alias("x"),
        ((7 * F.col("l_suppkey") + F.col("l_orderkey")) % size).cast("long").alias("y"),
        (F.expr("l_orderkey div 5") % size).cast("long").alias("z"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.struct(*LINE_ORDER).alias("at"),
        (F.col("l_returnflag") == "N").alias("n"),
    )
    first = rows.groupBy("case_id", "x", "y", "z").agg(F.min_by("n", "at").alias("n"), F.count("*").cast("long").alias("lines"))
    site = (F.col("x") * size + F.col("y")) * size + F.col("z")
    return first.repartition("case_id").select("case_id", site.alias("site"), "x", "y", "z", F.when(F.col("n"), "A").otherwise("B").alias("type"), "lines").withColumn("endpoint", F.col("site"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """segment, region (the condition), sample, n, h: per customer its orders and its finished ones."""
    orders, customers, nations = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    per = orders.groupBy("o_custkey").agg(F.count("*").cast("long").alias("n"), F.count_if(F.col("o_orderstatus") == "F").cast("long").alias("h"), F.sum("o_totalprice").alias("value"))
    joined = per.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").cast("long").alias("region"), F.col("c_custkey").alias("sample"), "n", "h", F.round("value", 2).alias("value"))


#: Orders of a lattice, places along its x and y axes, sites between centres, steps of an arm.
GROUP, PLACES, SPACING, ARM = 3_000, 16, 4, 3


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """case_id, molecule, type, arm, step, x, y, z: every order is a molecule, its type the customer's parity. Its centre
    is its place on a lattice a group of orders; an arm steps out along x or y and goes on along z. So arms of
    neighbouring molecules end two sites from each other."""
    number = F.col("o_orderkey") % GROUP
    at = {"x": number % PLACES, "y": F.floor(number / PLACES) % PLACES, "z": F.floor(number / PLACES**2)}
    rows = table(spark, folder, "orders").select(F.expr(f"o_orderkey div {GROUP}").alias("case_id"), F.col("o_orderkey").alias("molecule"), F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B").alias("type"), *((1 + SPACING * v).cast("long").alias(f"c{c}") for c, v in at.items()))
    sites = [(-1, 0, 0, 0, 0)] + [(arm, step, dx, dy, step - 1) for arm, (dx, dy) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1))) for step in range(1, ARM + 1)]
    steps = F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(("arm", "step", "x", "y", "z"), site))) for site in sites))
    each = rows.select("case_id", "molecule", "type", "cx", "cy", "cz", F.explode(steps).alias("s"))
    return each.select("case_id", "molecule", "type", F.col("s.arm").alias("arm"), F.col("s.step").alias("step"), *((F.col(f"c{c}") + F.col(f"s.{c}")).alias(c) for c in "xyz"))


def faulty_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """The trajectories with faults that follow from the molecules' numbers."""
    rows = trajectories(spark, folder)
    k, arm, step = F.col("molecule"), F.col("arm"), F.col("step")
    here = lambda modulus, rest, a, s: (k % modulus == rest) & (arm == a) & (step == s)
    kept = rows.where(~(here(101, 3, 2, 2) | here(113, 11, 3, ARM)))
    x = F.col("x") + F.when(here(103, 5, 1, ARM), 5).otherwise(0)
    z = F.col("z") - F.when(here(107, 7, 0, 3), 2).otherwise(0)
    kept = kept.select(
        "case_id", "molecule", F.when((k % 109 == 9) & (arm == 3), F.when(F.col("type") == "A", "B").otherwise("A")).when(k % 139 == 23, "C").otherwise(F.col("type")).alias("type"),
        F.when((k % 131 == 17) & (arm == 3), 4).otherwise(arm).cast("long").alias("arm"), F.when((k % 137 == 19) & (arm == -1), 1).otherwise(step).cast("long").alias("step"), x.alias("x"), "y", z.alias("z"),
    )
    again = rows.where((k % 127 == 13) & (arm == -1)).withColumn("z", F.col("z") + 1000)
    return kept.unionByName(again.select(*kept.columns))
