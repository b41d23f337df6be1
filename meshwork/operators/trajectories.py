"""Molecules from rows of sites: nested, checked by a fold over their steps, and held against what is told of
their ends.

Rows: keys of a molecule (case_id, molecule), type, arm (-1: the centre), step, x, y, z. A molecule's rows meet
in one shuffle and are folded in order of (arm, step), as the steps of a state machine. A molecule of over
FOLD rows, which only a faulty table has, is not gathered: its rows are numbered across partitions and each
meets the one before by an equi-join on its place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.operators.numbering import numbered
from meshwork.operators.spatial import REACH

ARMS = 4
KEYS = ["case_id", "molecule"]
FOLD = 20_000
STEP = ["arm", "step", "x", "y", "z", "type"]
FAULTS = ["types", "centres", "arms", "steps", "lengths", "jumps", "crossings"]
#: What is told of an end of a candidate or bond.
FIELDS = ["molecule", "arm", "type", "x", "y", "z"]


def far(a: Column, b: Column) -> Column:
    return reduce(lambda p, q: p + q, (F.abs(a[c] - b[c]) for c in "xyz"))


def on_arm(k: int):
    return lambda p: p["arm"] == k


def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    steps = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*STEP))).alias("s"))
    centre = F.try_element_at(F.filter("s", lambda p: p["arm"] == -1), F.lit(1))
    zero = F.lit(0).cast("long")
    whole = lambda c: c.cast("long")

    def on(state: Column, p: Column) -> Column:
        first = p["arm"] != state["arm"]
        place = F.when(first, 1).otherwise(state["place"] + 1).cast("long")
        before = F.when(first, centre).otherwise(state["at"])
        judged = p["arm"].between(0, ARMS - 1)
        return F.struct(
            p["arm"].cast("int").alias("arm"), place.alias("place"), p.alias("at"),
            (state["steps"] + whole(judged & (p["step"] != place))).alias("steps"),
            (state["jumps"] + whole(judged & F.coalesce(far(p, before) != 1, F.lit(False)))).alias("jumps"),
        )

    kind = dict(steps.dtypes)["s"].removeprefix("array<").removesuffix(">")
    start = F.struct(F.lit(-2).cast("int").alias("arm"), zero.alias("place"), F.lit(None).cast(kind).alias("at"), zero.alias("steps"), zero.alias("jumps"))
    sites = F.transform("s", lambda p: F.struct(p["x"], p["y"], p["z"]))
    length = [F.size(F.filter("s", on_arm(k))) for k in range(ARMS)]
    types = F.array_distinct(F.transform("s", lambda p: p["type"]))
    states = steps.withColumn("f", F.aggregate("s", start, on))
    return states.select(
        *keys,
        whole((F.size(types) != 1) | ~F.coalesce(F.forall(types, lambda t: t.isin("A", "B")), F.lit(False))).alias("types"),
        whole((F.size(F.filter("s", lambda p: p["arm"] == -1)) != 1) | (F.size(F.filter("s", lambda p: (p["arm"] == -1) & (p["step"] != 0))) > 0)).alias("centres"),
        whole(F.size(F.filter("s", lambda p: ~p["arm"].between(-1, ARMS - 1)))).alias("arms"),
        F.col("f.steps").alias("steps"),
        whole(F.greatest(*length) != F.least(*length)).alias("lengths"),
        F.col("f.jumps").alias("jumps"),
        whole(F.size("s") - F.size(F.array_distinct(sites))).alias("crossings"),
    )


def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As folded, for molecules of any number of rows."""
    c, count = F.col, lambda x: F.count_if(F.coalesce(x, F.lit(False))).cast("long")
    placed = numbered(rows.select(*keys, *STEP), [*keys, "arm"], ["step", "x", "y", "z", "type"])
    before = placed.select(*keys, "arm", (c("place") + 1).alias("place"), F.struct("x", "y", "z").alias("before"))
    centre = placed.where("arm = -1 and place = 0").select(*keys, F.struct("x", "y", "z").alias("centre"))
    # An arm's first step comes after the centre, the others after the step before.
    first = placed.where("place = 0").join(centre.withColumnRenamed("centre", "before"), keys, "left")
    met = first.unionByName(placed.where("place > 0").join(before, [*keys, "arm", "place"], "left"))
    at = c("before")
    judged = c("arm").between(0, ARMS - 1)
    per = met.groupBy(*keys).agg(
        ((F.count_distinct("type") != 1) | (F.count_if(c("type").isNull() | ~c("type").isin("A", "B")) > 0)).cast("long").alias("types"),
        ((F.count_if(c("arm") == -1) != 1) | (F.count_if((c("arm") == -1) & (c("step") != 0)) > 0)).cast("long").alias("centres"),
        count(~c("arm").between(-1, ARMS - 1)).alias("arms"),
        count(judged & (c("step") != c("place") + 1)).alias("steps"),
        *(F.count_if(c("arm") == k).alias(f"arm{k}") for k in range(ARMS)),
        count(judged & (far(F.struct("x", "y", "z"), at) != 1)).alias("jumps"),
        F.count("*").alias("rows"),
    )
    sites = rows.select(*keys, "x", "y", "z").distinct().groupBy(*keys).agg(F.count("*").alias("sites"))
    arms = [c(f"arm{k}") for k in range(ARMS)]
    wide = per.join(sites, keys).withColumn("lengths", (F.greatest(*arms) != F.least(*arms)).cast("long")).withColumn("crossings", c("rows") - c("sites"))
    return wide.select(*keys, *FAULTS)


def judged(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys and the number of each of FAULTS, of every molecule: types (not one, or neither A nor B), centres (not
    one, or not at step 0), arms (rows of unknown ones), steps (rows whose step is not their place in the arm), lengths
    (arms unequal), jumps (not to a neighbour; the first step's is the centre), crossings (sites used before)."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > FOLD).select(*keys)
    if large.isEmpty():
        return folded(rows, keys)
    return folded(rows.join(large, keys, "left_anti"), keys).unionByName(joined(rows.join(large, keys, "left_semi"), keys))


def faults(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return judged(rows, keys).where(" + ".join(FAULTS) + " > 0")


def nested(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, type, centre, arms (an array of paths from the centre on) of each faultless molecule."""
    good = judged(rows, keys).where(" + ".join(FAULTS) + " = 0").select(*keys)
    site = F.struct("x", "y", "z")
    steps = rows.join(good, keys, "left_semi").groupBy(*keys).agg(F.min("type").alias("type"), F.min(F.when(F.col("arm") == -1, site)).alias("centre"), F.array_sort(F.collect_list(F.struct(*STEP))).alias("s"))
    path = lambda k: F.transform(F.filter("s", on_arm(k)), lambda p: F.struct(p["x"], p["y"], p["z"]))
    return steps.select(*keys, "type", "centre", F.array(*(F.concat(F.array("centre"), path(k)) for k in range(ARMS))).alias("arms"))


def ends(rows: DataFrame, case: list[str] = ["case_id"]) -> DataFrame:  # noqa: B006
    """case, endpoint, molecule, arm, type, x, y, z: the last step of each arm."""
    last = rows.where(F.col("arm").between(0, ARMS - 1)).groupBy(*case, "molecule", "arm").agg(F.max_by(F.struct("type", "x", "y", "z"), "step").alias("e"))
    return last.select(*case, (ARMS * F.col("molecule") + F.col("arm")).cast("long").alias("endpoint"), "molecule", "arm", "e.*")


def told(found: DataFrame, points: DataFrame, case: list[str]) -> DataFrame:
    """Pairs (case, endpoint_a, endpoint_b, distance) with the FIELDS of both ends."""
    for side in "ab":
        found = found.join(points.select(*case, F.col("endpoint").alias(f"endpoint_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in FIELDS)), [*case, f"endpoint_{side}"])
    return found


def reconciled(listed: DataFrame, expected: DataFrame, case: list[str] = ["case_id"]) -> DataFrame:  # noqa: B006
    """case, endpoint_a, endpoint_b, problem, field: where a list of candidates is not what the molecules give.
    Problems: missing, invented, repeated (a pair listed again) and altered, a row for each field that differs."""
    pair = [*case, "endpoint_a", "endpoint_b"]
    values = [f"{c}_{s}" for s in "ab" for c in FIELDS] + ["distance"]
    # Copies of a row are counted before they meet, so that a row listed very often is one row of the join.
    rows = listed.groupBy(*pair, *values).agg(F.count("*").alias("copies")).select(*pair, F.struct(*values).alias("listed"), "copies")
    want = expected.select(*pair, F.struct(*values).alias("expected"))
    met = rows.join(want, pair, "full_outer")
    differs = [F.when(~F.col(f"listed.{v}").eqNullSafe(F.col(f"expected.{v}")), F.struct(F.lit("altered").alias("problem"), F.lit(v).alias("field"))) for v in values]
    alone = lambda problem: F.array(F.struct(F.lit(problem).alias("problem"), F.lit(None).cast("string").alias("field")))
    found = F.when(F.col("listed").isNull(), alone("missing")).when(F.col("expected").isNull(), alone("invented")).otherwise(F.filter(F.array(*differs), lambda d: d.isNotNull()))
    problems = met.select(*pair, F.explode(found).alias("p")).select(*pair, "p.*").distinct()
    again = rows.groupBy(*pair).agg(F.sum("copies").alias("n")).where("n > 1").select(*pair, F.lit("repeated").alias("problem"), F.lit(None).cast("string").alias("field"))
    return problems.unionByName(again)


def bond_faults(bonds: DataFrame, points: DataFrame, case: list[str] = ["case_id"]) -> DataFrame:  # noqa: B006
    """case, rule, bad_count (where there are any): rows of bonds, with FIELDS of both ends and distance, against
    the molecules' ends."""
    met = bonds
    for side in "ab":
        met = met.join(points.select(*case, F.col("endpoint").alias(f"endpoint_{side}"), F.struct(*FIELDS).alias(f"known_{side}")), [*case, f"endpoint_{side}"], "left")
    c = F.col
    differs = lambda *names: reduce(lambda a, b: a | b, (~c(f"{n}_{s}").eqNullSafe(c(f"known_{s}.{n}")) for n in names for s in "ab"))
    owner = reduce(lambda a, b: a | b, (~c(f"endpoint_{s}").eqNullSafe(ARMS * c(f"molecule_{s}") + c(f"arm_{s}")) for s in "ab"))
    apart = reduce(lambda a, b: a + b, (F.abs(c(f"{x}_a") - c(f"{x}_b")) for x in "xyz"))
    rules = {
        "order": c("endpoint_a") >= c("endpoint_b"),
        "owner": owner,
        "arm": reduce(lambda a, b: a | b, (~c(f"arm_{s}").between(0, ARMS - 1) for s in "ab")),
        "unknown": c("known_a").isNull() | c("known_b").isNull(),
        "type": differs("type"),
        "same_type": c("type_a") == c("type_b"),
        "coordinates": differs("x", "y", "z"),
        "reach": ~apart.between(1, REACH),
        "distance": apart != c("distance"),
    }
    names = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items())), lambda n: n.isNotNull())
    per_row = met.select(*case, F.explode(names).alias("rule")).groupBy(*case, "rule").agg(F.count("*").cast("long").alias("bad_count"))
    used = bonds.select(*case, F.explode(F.array("endpoint_a", "endpoint_b")).alias("endpoint")).groupBy(*case, "endpoint").agg(F.count("*").alias("n")).where("n > 1")
    return per_row.unionByName(used.groupBy(*case).agg(F.lit("reuse").alias("rule"), F.count("*").cast("long").alias("bad_count")))
