"""Candidates between endpoints at Manhattan distance 1 or 2 on an open cubic lattice: a band join,
written as an equi-join by exploding each endpoint into half of the sites around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 2
#: All integer offsets with Manhattan length 1 or 2: 24.
OFFSETS = [(dx, dy, dz) for dx in range(-REACH, REACH + 1) for dy in range(-REACH, REACH + 1) for dz in range(-REACH, REACH + 1) if 1 <= abs(dx) + abs(dy) + abs(dz) <= REACH]


#: Of each offset and its opposite one: what finds a pair from one of its ends only.
FORWARD = [o for o in OFFSETS if o > (0, 0, 0)]


def around(offsets: list[tuple[int, int, int]] = OFFSETS) -> Column:
    return F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dx, dy, dz in offsets))


def inside(size: int, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).between(0, size - 1)
    return out


def probes(endpoints: DataFrame, keys: list[str], offsets: list[tuple[int, int, int]] = OFFSETS) -> DataFrame:
    """Each endpoint at each of the sites around it: keys, endpoint, type, x, y, z (of the site probed), distance."""
    rows = endpoints.select(*keys, "endpoint", "type", "x", "y", "z", F.explode(around(offsets)).alias("o"))
    distance = F.abs("o.dx") + F.abs("o.dy") + F.abs("o.dz")
    return rows.select(*keys, "endpoint", "type", *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "xyz"), distance.cast("int").alias("distance"))


def candidates(endpoints: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, endpoint_a < endpoint_b, distance, of endpoints of different types and, where the frame has a
    column molecule, of different molecules."""
    keys, own = list(keys), [c for c in ("molecule",) if c in endpoints.columns]
    endpoints = endpoints.withColumn("within", inside(size, "x", "y", "z"))
    here = endpoints.select(*keys, F.col("endpoint").alias("endpoint_b"), F.col("type").alias("type_b"), *(F.col(c).alias(f"{c}_b") for c in own), F.col("within").alias("within_b"), "x", "y", "z")
    # Looked up, not sorted: there are twelve probes to an endpoint.
    met = probes(endpoints, [*keys, *own, "within"], FORWARD).join(here.hint("shuffle_hash"), [*keys, "x", "y", "z"])
    for c in own:
        met = met.where(F.col(c) != F.col(f"{c}_b"))
    # The greater end has to lie on the lattice.
    greater = F.when(F.col("endpoint") < F.col("endpoint_b"), F.col("within_b")).when(F.col("endpoint") > F.col("endpoint_b"), F.col("within"))
    low, high = (f("endpoint", "endpoint_b") for f in (F.least, F.greatest))
    return met.where(greater & (F.col("type") != F.col("type_b"))).select(*keys, low.alias("endpoint_a"), high.alias("endpoint_b"), "distance")


def search_effort(endpoints: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, offsets_tested, site_lookups (those inside)."""
    return probes(endpoints, list(keys)).groupBy(*keys).agg(F.count("*").cast("long").alias("offsets_tested"), F.count_if(inside(size, "x", "y", "z")).cast("long").alias("site_lookups"))


def attached(found: DataFrame, endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with type, site and coordinates of both ends."""
    for side in "ab":
        found = found.join(endpoints.select(*keys, F.col("endpoint").alias(f"endpoint_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("type", "site", "x", "y", "z"))), [*keys, f"endpoint_{side}"])
    return found


def occupation(sites: DataFrame) -> DataFrame:
    """Per case: occupied sites, by type, what lies on them, and the sites that several share."""
    of = lambda c: F.count_if(c).cast("long")
    return sites.groupBy("case_id").agg(F.count("*").cast("long").alias("sites"), of(F.col("type") == "A").alias("type_a"), of(F.col("type") == "B").alias("type_b"), F.sum("lines").cast("long").alias("lines"), of(F.col("lines") > 1).alias("shared"))
