"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has a bit set where over half of the text's shingle hashes have it. The 64 bits
form a ring of 8 segments. If two fingerprints differ in at most 3 bits, there is a segment from
which every chain of consecutive segments stays within its share of the budget: the first l
segments differ in at most 3 * l / 8 bits (Qin and Xiao, "Pigeonring", 2018). So from that start
two segments are equal, and of the next three at most one differs: 8 starts with 3 choices give
24 keys of 32 bits, on which candidates meet; chains over their budget are pruned before the full
distance counts. Exact copies share a fingerprint and enter the search once.

Null and empty texts and texts without words have the fingerprint 0, which is linked like any
other. A row without an id takes the component of its fingerprint but links nothing. Repeated
rows give repeated results; an empty table gives an empty one; other columns are ignored by
`fingerprints` and `components`, and carried by `keep_first`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm import hamming
from meshwork.llm.components import connected
from meshwork.llm.rows import id_type, keyed, map_slices, octets, saved, unused

SHINGLE = 3
DISTANCE = 3
SEGMENTS, WIDTH = 8, 8
#: Bits of the first l segments, and their budget.
CHAINS = [(np.uint64((1 << WIDTH * n) - 1), n * DISTANCE // SEGMENTS) for n in range(1, SEGMENTS + 1)]
#: Segments (counted from the start) that a key holds, by which of the third to fifth may differ.
HELD = ((0, 1, 3, 4), (0, 1, 2, 4), (0, 1, 2, 3))
MASKS = tuple(np.uint64(sum(0xFF << WIDTH * s for s in held)) for held in HELD)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z, and the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, 42)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    begins = (ends - lens)[: len(words) - size + 1].tolist()
    hashes = np.array([xxh64_intdigest(joined[b:e], 42) for b, e in zip(begins, ends[size - 1 :].tolist())], np.uint64)
    counts = sum(np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(hashes), 4096))
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per row of df: the id and fp (long, the fingerprint's bits)."""

    def make():
        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, size) for t in octets(part.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], [id_col, "fp"])

        return handle

    return map_slices(keyed(df, id_col, text_col), make, f"`{id_col}` {id_type(df, id_col)}, fp long")


def turned(x: np.ndarray, start: int) -> np.ndarray:
    """The ring, from this segment on."""
    by = np.uint64(WIDTH * start)
    return (x >> by) | (x << np.uint64(64 - WIDTH * start)) if start else x


def ring_keys(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, fingerprints), for each start and choice."""
    ring = fp.view(np.uint64)
    return [(((turned(ring, s) & mask) | np.uint64((s * 3 + c) << 40)).view(np.int64), fp) for s in range(SEGMENTS) for c, mask in enumerate(MASKS)]


def ring_linked(a: list[np.ndarray], b: list[np.ndarray], key: np.ndarray) -> np.ndarray:
    """Whether all chains from the key's start stay within their budgets; the last one is the whole ring."""
    differs = a[0].view(np.uint64) ^ b[0].view(np.uint64)
    by = (key.view(np.uint64) >> np.uint64(40)) // np.uint64(3) * np.uint64(WIDTH)
    ring = (differs >> by) | (differs << ((np.uint64(64) - by) & np.uint64(63)))
    ok = np.bitwise_count(ring & CHAINS[4][0]) <= CHAINS[4][1]
    for mask, budget in CHAINS[5:]:
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(ring[at] & mask) <= budget
    return ok


def components(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """fps: the id and fp. One row per row: the id, fp, component_id (the smallest id reachable)."""
    first = saved(fps.groupBy("fp").agg(F.min(id_col).alias("node")), "fingerprints")
    edges = hamming.links(first.where(F.col("node").isNotNull()).select("fp"), ring_keys, ring_linked, "links")
    roots = connected(edges, "simhash")
    # Components are named by fingerprint so far; now by the smallest id.
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = roots.select("root").distinct()
    least = named.join(several, "root", "left_semi").groupBy("root").agg(F.min("node").alias("least"))
    of = named.join(least, "root", "left").select("fp", F.coalesce("least", "node").alias("component_id"))
    return fps.join(of, "fp").select(id_col, "fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return components(saved(fingerprints(df, id_col, text_col), "simhash"), id_col)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose id is not the smallest of its component. Rows without an id stay; rows
    that repeat an id are one document, which goes if any of them is a later copy."""
    key = unused(df, "later_copy")
    drop = near_duplicates(df, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(key)).distinct()
    return df.join(drop, F.col(id_col) == F.col(key), "left_anti")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
