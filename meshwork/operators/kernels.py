"""Random placement and greedy matching: sequential within a sample, so each sample is one call of a
small kernel and Spark deals the samples out. Draws follow one fixed order from one generator, so a
seed gives the same network everywhere."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.spatial import candidates

MASK = (1 << 64) - 1
#: Steps in the order in which free neighbours are listed.
STEPS = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
ARMS = 4


class SplitMix64:
    """Steele, Lea and Flood, 2014."""

    def __init__(self, state: int):
        self.state = state & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
        return z ^ z >> 31

    def below(self, n: int) -> int:
        """Uniform in 0..n-1; values in the incomplete first cycle are drawn again."""
        least = (1 << 64) % n
        while (v := self.next()) < least:
            pass
        return v % n

    def uniform(self) -> float:
        return (self.next() >> 11) * 2.0**-53


def molecules_for(phi: str, size: int, arm_length: int) -> int:
    """Whole sites within the fraction, in exact decimals, then whole molecules."""
    return int(Decimal(phi) * size**3) // (1 + ARMS * arm_length)


class Lattice:
    def __init__(self, size: int):
        self.size, self.owner = size, {}

    def place(self, rng: SplitMix64, molecule: int, centre: tuple[int, int, int], arm_length: int, p_a: float):
        """The type and the arms, None if an arm can't go on (then nothing stays occupied; draws stay used)."""
        kind = "A" if rng.uniform() < p_a else "B"
        taken, arms = [centre], []
        self.owner[centre] = molecule
        for _ in range(ARMS):
            at, arm = centre, []
            for _ in range(arm_length):
                beside = [(at[0] + dx, at[1] + dy, at[2] + dz) for dx, dy, dz in STEPS]
                free = [n for n in beside if min(n) >= 0 and max(n) < self.size and n not in self.owner]
                if not free:
                    for site in taken:
                        del self.owner[site]
                    return None
                at = free[rng.below(len(free))]
                self.owner[at] = molecule
                taken.append(at)
                arm.append(at)
            arms.append(arm)
        return kind, arms


def place_sample(size: int, seed: int, target: int, arm_length: int, p_a: float, most_attempts: int) -> tuple[list[tuple], dict]:
    """Endpoint rows (endpoint, molecule, type, x, y, z) and the sample's counts with the generator's state."""
    rng, lattice, rows = SplitMix64(seed), Lattice(size), []
    placed = attempts = occupied = trapped = 0
    while placed < target and attempts < most_attempts:
        n = rng.below(size**3)
        attempts += 1
        centre = (n // size**2, n // size % size, n % size)
        if centre in lattice.owner:
            occupied += 1
        elif (got := lattice.place(rng, placed, centre, arm_length, p_a)) is None:
            trapped += 1
        else:
            rows += [(ARMS * placed + k, placed, got[0], *arm[-1]) for k, arm in enumerate(got[1])]
            placed += 1
    return rows, {"target": target, "placed": placed, "attempts": attempts, "center_occupied": occupied, "trapped": trapped, "completed": int(placed == target), "rng_state": str(rng.state)}


ENDPOINTS = "case_id long, endpoint long, molecule long, type string, x int, y int, z int"
COUNTS = "target long, placed long, attempts long, center_occupied long, trapped long, completed int, rng_state string"


def place(cases: DataFrame, most_attempts: int = 10_000) -> DataFrame:
    """cases: case_id, size, seed (decimal), phi (text), arm_length, p_a. One row per case with its counts
    and endpoints; an incomplete case keeps its counts and has no endpoints."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c in batch.itertuples():
                rows, counts = place_sample(c.size_, int(c.seed), molecules_for(c.phi, c.size_, c.arm_length), c.arm_length, c.p_a, most_attempts)
                names = ("endpoint", "molecule", "type", "x", "y", "z")
                out.append({"case_id": c.case_id, "size": c.size_, **counts, "endpoints": [dict(zip(names, r)) for r in rows] if counts["completed"] else []})
            yield pd.DataFrame(out, columns=["case_id", "size", *(x.split()[0] for x in COUNTS.split(", ")), "endpoints"])

    of = "array<struct<endpoint:long,molecule:long,type:string,x:int,y:int,z:int>>"
    return cases.withColumnRenamed("size", "size_").mapInPandas(run, f"case_id long, size int, {COUNTS}, endpoints {of}")


def match_sample(edges: list[tuple[int, int]], endpoints: int, state: int, several: bool = True) -> list[tuple[int, int]]:
    """Greedy one-to-one matching: endpoints in a shuffled order, each with a random free neighbour.
    several: whether two molecules may have more than one bond. Neighbours are in the edges' order."""
    rng = SplitMix64(state)
    near: list[list[int]] = [[] for _ in range(endpoints)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    order = list(range(endpoints))
    for n in range(endpoints, 1, -1):
        j = rng.below(n)
        order[n - 1], order[j] = order[j], order[n - 1]
    partner: dict[int, int] = {}
    tied: set[tuple[int, int]] = set()
    bonds = []
    for a in order:
        if a in partner:
            continue
        free = [b for b in near[a] if b not in partner and (several or (min(a, b) // ARMS, max(a, b) // ARMS) not in tied)]
        if free:
            b = free[rng.below(len(free))]
            partner[a], partner[b] = b, a
            tied.add((min(a, b) // ARMS, max(a, b) // ARMS))
            bonds.append((min(a, b), max(a, b)))
    return bonds


def endpoints_of(placed: DataFrame) -> DataFrame:
    return placed.select("case_id", F.explode("endpoints").alias("e")).select("case_id", "e.*")


def bond(placed: DataFrame, size: int, several: bool = True) -> DataFrame:
    """Bonds of placed cases of one lattice size: case_id, bond_id, endpoint_a, endpoint_b, molecule_a, molecule_b."""
    # A case is one call of the kernel, so that all its rows can be in one task from here on.
    ends = endpoints_of(placed).repartition("case_id")
    where = ends.select("case_id", F.col("endpoint").alias("endpoint_b"), ((F.col("x") * size + F.col("y")) * size + F.col("z")).alias("site_b"))
    near = candidates(ends, size, ("case_id",)).join(where, ["case_id", "endpoint_b"])
    lists = near.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("endpoint_a", "site_b", "endpoint_b"))).alias("edges"))
    cases = placed.where("completed = 1").select("case_id", "placed", "rng_state").join(lists, "case_id", "left")

    def run(batches):
        for batch in batches:
            rows = []
            for c in batch.itertuples():
                found = match_sample([(e["endpoint_a"], e["endpoint_b"]) for e in (c.edges if c.edges is not None else [])], ARMS * c.placed, int(c.rng_state), several)
                rows += [(c.case_id, k, a, b, a // ARMS, b // ARMS) for k, (a, b) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["case_id", "bond_id", "endpoint_a", "endpoint_b", "molecule_a", "molecule_b"]).astype("int64")

    return cases.mapInPandas(run, "case_id long, bond_id long, endpoint_a long, endpoint_b long, molecule_a long, molecule_b long")
