"""Packing documents into sequences: dominance reduction, then best fit.

A document's ids, with the end id, are cut into pieces of CAPACITY ids; its last piece may be shorter.
Pieces of a length are alike, so the packing is planned over the number of pieces of each length, at
most CAPACITY numbers however many documents there are:

1. Reduction (Martello and Toth, "Knapsack Problems", 1990, ch. 8): for a piece j, a set {j, k} or {j, a, b}
   dominates if whatever else fits beside j could be exchanged for a part of it that is no longer. Such a set
   is in some best packing, so it is fixed, as often as there are pieces for it, and the instance shrinks,
   until no set is found. A piece beside which nothing fits is fixed alone; one that another fills up exactly,
   with that one.
2. Best fit of the remainder by falling length: a piece goes to the fullest sequence that still takes it.

The plan is a list of runs: pieces number `first`.. of a length go to sequences `bin`.. at an offset, `each` of
them a sequence. A task numbers its pieces by length as it makes them; sums over tasks of their counts
make these numbers those of the whole table, without a sort, so a length that most pieces have is no
more work than others. The plan has a few runs for each length and is known to all tasks.

A null text is an empty one, which is the end id alone. Rows without an id are packed like others and
repeated rows one by one. An empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, keyed, saved, slices, strings
from meshwork.llm.token_files import SLICE, default_tokenizer, worker_encoder

CAPACITY = 4096
Run = tuple[int, int, int, int, int, int]  # length, first, n, bin, each, offset


class Stock:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: n for k, n in counts.items() if n}
        self.lengths = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def longest(self, most: int, but: tuple[int, ...] = ()) -> int:
        """The length of the longest piece of at most this length, beside those in use; zero if there is none."""
        at = bisect_right(self.lengths, most)
        while at:
            at -= 1
            length = self.lengths[at]
            if self.count[length] > but.count(length):
                return length
        return 0

    def shortest(self, n: int, but: int) -> list[int]:
        """The lengths of the n shortest pieces, without one of length but."""
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(n - len(out), self.count[length] - (length == but))
            if len(out) == n:
                break
        return out

    def longest_second(self, room: int, longest: int, but: int) -> int:
        """The greatest possible length of the shorter one of two pieces that fit into room together, beside `but`;
        neither is longer than longest."""
        best = 0
        for at in range(bisect_right(self.lengths, min(room // 2, longest)), 0, -1):
            short = self.lengths[at - 1]
            n = self.count[short] - (short == but)
            if n < 1:
                continue
            if n > 1:
                return short
            # Its partner is the next longer piece there is.
            for other in self.lengths[at:]:
                if self.count[other] > (other == but):
                    if short + other <= room and other <= longest:
                        return short
                    break
        return best


def dominating(stock: Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """The pieces that go with one of length j in some best packing, if that can be told."""
    room = capacity - j
    k = stock.longest(room, (j,))
    if not k:
        return ()
    if k == room:
        return (k,)
    short = stock.shortest(3, j)
    if len(short) < 2 or short[0] + short[1] > room:
        return (k,)  # one other piece at most fits, and k is the longest
    if len(short) > 2 and sum(short) <= room:
        return None
    # Two others at most fit. {j, k} dominates if k is as long as any two of them.
    b = stock.longest(room - k, (j, k))
    u = stock.longest_second(room, k, j)
    if not u:
        return (k,)
    if most_of_two(stock, room, j) <= k:
        return (k,)
    # {j, k, b} dominates if no pair has a shorter one longer than b; its longer one is never longer than k.
    return (k, b) if b >= u else None


def most_of_two(stock: Stock, room: int, but: int) -> int:
    """The greatest length of two pieces together that fit into room, beside one of length but."""
    best = 0
    for length in stock.lengths:
        if 2 * length > room:
            break
        if stock.count[length] > (length == but):
            other = stock.longest(room - length, (but, length))
            best = max(best, length + other if other else 0)
    return best


class Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins, self.runs = capacity, 0, []
        self.used = dict.fromkeys(counts, 0)
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number of them)
        self.rooms: list[int] = []
        self.fixed = 0

    def place(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        self.runs.append((length, self.used[length], n, first, each, offset))
        self.used[length] += n

    def fix(self, pieces: tuple[int, ...], n: int) -> None:
        """n sequences with these pieces each, which take no others."""
        offset = 0
        for length in pieces:
            self.place(length, n, self.bins, 1, offset)
            offset += length
        self.bins += n
        self.fixed += n

    def keep(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.open:
                self.rooms.insert(bisect_left(self.rooms, room), room)
            self.open.setdefault(room, []).append((first, n))

    def best_fit(self, length: int, n: int) -> None:
        """Each piece into the fullest sequence that takes it; a sequence that still takes one is then the fullest."""
        while n:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, bins = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    self.rooms.pop(at)
            else:
                room, first = self.capacity, self.bins
                bins = -(-n // (self.capacity // length))
                self.bins += bins
            each = room // length
            full = min(bins, n // each)
            self.place(length, full * each, first, each, self.capacity - room) if full else None
            self.keep(room - each * length, first, full)
            n -= full * each
            rest = bins - full
            if rest and n:
                self.place(length, n, first + full, n, self.capacity - room)
                self.keep(room - n * length, first + full, 1)
                rest, n, full = rest - 1, 0, full + 1
            self.keep(room, first + full, rest)


def plan(counts: dict[int, int], capacity: int = CAPACITY, reduce: bool = True) -> Plan:
    """counts: pieces by length, 1 to capacity."""
    out, stock = Plan(counts, capacity), Stock(counts)
    changed = reduce
    while changed:
        changed = False
        for j in reversed(stock.lengths.copy()):
            while stock.count.get(j):
                others = dominating(stock, j, capacity)
                if others is None:
                    break
                pieces = (j, *others)
                n = min(stock.count[p] // pieces.count(p) for p in pieces)
                out.fix(pieces, n)
                for p in pieces:
                    stock.take(p, n)
                changed = True
    for length in reversed(stock.lengths):
        out.best_fit(length, stock.count[length])
    return out


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int | None, capacity: int, tokens: bool) -> DataFrame:
    """id, piece, start, length, ids_crc32, and tokens if wanted; part and k: the task that made the piece, and its
    number there among those of its length."""
    tail = b"" if end_id is None else struct.pack("<I", end_id)
    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "k", *(["tokens"] if tokens else [])]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        from pyspark import TaskContext

        part, encoder, made = TaskContext.get().partitionId(), worker_encoder(tokenizer), {}
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                of, out = [], []
                for row, raw in enumerate(encoder.encode(pa.array(strings(some.column(1)), pa.large_string()))):
                    raw += tail
                    for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                        ids = raw[at : at + 4 * capacity]
                        length = len(ids) // 4
                        made[length] = k = made.get(length, -1) + 1
                        of.append(row)
                        out.append((n, n * capacity, length, crc32(ids), part, k, *([ids] if tokens else [])))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)] if out else [pa.array([], kind) for kind in kinds[: len(names) - 1]]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of, pa.int64())), *columns], names)

    schema = f"`{id_col}` {id_type(df, id_col)}, piece int, start long, length long, ids_crc32 long, part int, k long" + (", tokens binary" if tokens else "")
    return keyed(df, id_col, text_col).mapInArrow(run, schema)


def placed(rows: DataFrame, runs: list[Run]) -> DataFrame:
    """rows (length, number: the piece's among all of its length) with sequence_id and offset."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    columns = rows.columns
    at = [columns.index(c) for c in ("length", "number")]

    def run(batches):
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in at)
            k = np.searchsorted(key, length << 44 | number, "right") - 1
            _, first, _, begin, each, offset = table[k].T
            m = number - first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin + m // each), pa.array(offset + m % each * length)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 1, capacity: int = CAPACITY, tokens: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset, and tokens (binary, little-endian unsigned 32-bit ids) if wanted."""
    made = saved(pieces(df, id_col, text_col, tokenizer or default_tokenizer(), end_id, capacity, tokens), "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begun = saved(counts.withColumn("before", F.coalesce(before, F.lit(0)).cast("long")), "piece-counts")
    total = {r["length"]: r["n"] for r in begun.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The counts grow with the number of tasks, so they are not broadcast.
    numbered = made.join(begun.select("part", "length", "before").hint("merge"), ["part", "length"]).withColumn("number", F.col("before") + F.col("k"))
    keep = [id_col, "piece", "start", "length", "ids_crc32", *(["tokens"] if tokens else [])]
    return placed(numbered.select(*keep, "number"), plan(total, capacity).runs).select(*keep, "sequence_id", "offset")


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """packed: with tokens. sequence_id, tokens, documents (id, piece and where it begins): one row a sequence, which
    has at most the capacity's number of ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", F.col(id_col).alias("id"), "piece", "tokens")))
    rows = packed.groupBy("sequence_id").agg(inside.alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["tokens"]))
    return rows.select("sequence_id", ids.alias("tokens"), F.transform("p", lambda p: F.struct(p["id"].alias(id_col), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("documents"))


def digest(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return packed.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
