"""Links between 64-bit fingerprints of a small Hamming distance.

A method gives each fingerprint a number of blocking keys. One shuffle deals (key, node, fingerprint)
out by buckets of keys, packed: a row holds what a batch has for a bucket. A task sorts its keys and
compares within equal ones, in numpy. A key of over GROUP nodes is compared by pivots: a row with all
others, then further rows outside the largest component so far, until there are none left; pairs in
the largest component need no look, which makes a group of near copies cheap. If that takes over WORK
comparisons, its rows are dealt anew as blocks of GROUP, each pair of blocks to a group of its own, so
that many tasks share the work. Of the links found a task passes on a spanning forest, at most one
edge a node, not the pairs.

Null keys, nodes and fingerprints are not allowed. Nodes that repeat under a key cost work only. An
empty table gives no edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.components import forest
from meshwork.llm.rows import saved

GROUP = 512
WORK = 200_000_000
#: Keys that a task holds before it packs them.
PACKED_KEYS = 1_000_000
NONE = np.zeros(0, np.int64)


def gathered(batches, n: int) -> list[np.ndarray]:
    """The partition's columns (all long) whole: its rows are what the shuffle dealt to one task."""
    held: list[list[np.ndarray]] = [[NONE] for _ in range(n)]
    for batch in batches:
        for column, more in zip(held, batch.columns):
            column.append(more.to_numpy(zero_copy_only=False))
    return [np.concatenate(c) for c in held]


def ranges(size: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each size, end to end."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)


def compare(first: np.ndarray, size: np.ndarray, key: np.ndarray, node: np.ndarray, more: list[np.ndarray], linked: Callable, block: np.ndarray | None = None):
    """Pairs of rows in a group (rows first .. first+size-1) that are linked, as edges of a forest of nodes.
    With block, only rows of different blocks."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    place, whole = ranges(size), np.repeat(size, size)
    row = np.repeat(first, size) + place
    for k in range(1, int(size.max(initial=0))):
        live = whole > place + k
        if not live.any():
            break
        place, whole, row = place[live], whole[live], row[live]
        a, b = row, row + k
        if block is not None:
            a, b = a[block[a] != block[b]], b[block[a] != block[b]]
        ok = linked([x[a] for x in more], [x[b] for x in more], key[a])
        if ok.any():
            found.append((node[a[ok]], node[b[ok]]))
            held += int(ok.sum())
            if held > 2_000_000:
                found = [forest(*(np.concatenate(x) for x in zip(*found)))]
                held = len(found[0][0])
    return forest(*(np.concatenate(x) for x in zip(*found))) if found else (NONE, NONE)


def by_pivots(key: np.ndarray, node: np.ndarray, more: list[np.ndarray], linked: Callable) -> tuple[np.ndarray, np.ndarray] | None:
    """Edges of the components of one group, or None if that takes more than WORK comparisons."""
    part, left, done = np.arange(len(node)), WORK, np.zeros(len(node), bool)
    pivot = 0
    while True:
        left -= len(node)
        if left < 0:
            return None
        done[pivot] = True
        met = linked([np.broadcast_to(x[pivot], x.shape) for x in more], more, key)
        met[pivot] = True
        joined = np.unique(part[met])
        if len(joined) > 1:
            part[np.isin(part, joined)] = joined[0]
        names, counts = np.unique(part, return_counts=True)
        rest = np.flatnonzero((part != names[counts.argmax()]) & ~done)
        if not len(rest):
            own = np.flatnonzero(part != np.arange(len(part)))
            return node[own], node[part[own]]
        pivot = int(rest[0])


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else NONE
    return first, np.diff(np.append(first, len(key)))


def packed(held: list[tuple[np.ndarray, ...]], buckets: int, kinds: tuple) -> pa.RecordBatch:
    """(bucket, packed): the columns of a bucket one after the other, as these kinds of numbers."""
    columns = [np.concatenate(c) for c in zip(*held)]
    key = columns[0].view(np.uint64)
    bucket = ((key ^ key >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order].astype(kind) for c, kind in zip(columns, kinds)]
    first, size = groups(bucket)
    rows = [b"".join(c[f : f + s].tobytes() for c in columns) for f, s in zip(first.tolist(), size.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "packed"])


def spread(keys: Callable[..., Iterable], kinds: tuple, buckets: int) -> Callable:
    """For mapInArrow: the packed keys of its rows."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for got in keys(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
                held.append(got)
                size += len(got[0])
            if size > PACKED_KEYS:
                yield packed(held, buckets, kinds)
                held, size = [], 0
        if size:
            yield packed(held, buckets, kinds)

    return run


def unpacked(batches, kinds: tuple) -> list[np.ndarray]:
    """The columns of a partition of packed keys, sorted by key."""
    held: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in kinds]
    widths = [np.dtype(kind).itemsize for kind in kinds]
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            size, at = len(raw) // sum(widths), 0
            for column, kind, width in zip(held, kinds, widths):
                column.append(np.frombuffer(raw, kind, size, at))
                at += size * width
    columns = [np.concatenate(c) for c in held]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def dealt(rows: DataFrame, keys: Callable[..., Iterable], kinds: tuple) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(spread(keys, kinds, 4 * n), "bucket int, packed binary").repartition(n, "bucket")


def links(rows: DataFrame, keys: Callable[..., Iterable], linked: Callable[[list, list, np.ndarray], np.ndarray], name: str, group: int = GROUP, kinds: tuple = (np.int64, np.int64)) -> DataFrame:
    """Edges a, b (nodes, long) with the same components as the graph of all linked pairs that share a key.
    keys(*columns of rows) gives tuples of arrays: the keys, the nodes, and what linked needs further. kinds: the
    numbers as which these are dealt out; keys of np.uint32 keep their low bits, beside the bucket that the whole
    key chose. linked(rows, rows, key) tells for pairs of rows, each a list of arrays: what came after the key and
    the node, or the node if that was all."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = [f"p{k}" for k in range(max(1, len(kinds) - 2))]
    edge = ", ".join(f"{c} long" for c in ("a", "key", "block", "blocks", *more))

    def batch(columns, names) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in columns], names)

    def first_look(batches):
        key, node, *other = unpacked(batches, kinds)
        other = other or [node]
        first, size = groups(key)
        small = (size > 1) & (size <= group)
        a, b = compare(first[small], size[small], key, node, other, linked)
        names = ["a", "key", "block", "blocks", *more]
        zero = np.zeros(len(a), np.int64)
        yield batch([a, zero, zero, zero, b, *[zero] * (len(more) - 1)], names)
        for f, s in zip(first[size > group].tolist(), size[size > group].tolist()):
            edges = by_pivots(key[f : f + s], node[f : f + s], [x[f : f + s] for x in other], linked)
            if edges is not None:
                zero = np.zeros(len(edges[0]), np.int64)
                yield batch([edges[0], zero, zero, zero, edges[1], *[zero] * (len(more) - 1)], names)
                continue
            yield batch([node[f : f + s], key[f : f + s], np.arange(s) // group, np.full(s, -(-s // group)), *(x[f : f + s] for x in other)], names)

    def second_look(batches):
        key, i, j, block, node, *other = gathered(batches, 5 + len(more))
        order = np.lexsort((j, i, key))
        key, i, j, block, node, *other = (x[order] for x in (key, i, j, block, node, *other))
        other = [x.astype(kind) for x, kind in zip(other, kinds[2:] or (np.int64,))]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(key) else NONE
        size = np.diff(np.append(first, len(key)))
        alone = i[first] == j[first]
        for some, of in ((alone, None), (~alone, block)):
            yield batch(compare(first[some], size[some], key, node, other, linked, of), ["a", "b"])

    looked = saved(dealt(rows, keys, kinds).mapInArrow(first_look, edge), name)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    large = looked.where("blocks > 0").select("key", "block", "a", *more, blocks)
    pairs = large.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", *more).repartition(n, "key", "i", "j")
    return looked.where("blocks = 0").select("a", F.col("p0").alias("b")).unionAll(pairs.mapInArrow(second_look, "a long, b long"))


def partnered(rows: DataFrame, keys: Callable[..., Iterable], linked: Callable[[list, list, np.ndarray], np.ndarray], kinds: tuple, group: int = GROUP) -> DataFrame:
    """node (long): the nodes that share a key with another one to which they are linked, perhaps several times;
    and all nodes of a key that has over GROUP."""

    def look(batches):
        key, node, *other = unpacked(batches, kinds)
        other = other or [node]
        first, size = groups(key)
        small = (size > 1) & (size <= group)
        a, b = compare(first[small], size[small], key, node, other, linked)
        whole = np.repeat(first[size > group], size[size > group]) + ranges(size[size > group])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a, b, node[whole]])).astype(np.int64))], ["node"])

    return dealt(rows, keys, kinds).mapInArrow(look, "node long")
