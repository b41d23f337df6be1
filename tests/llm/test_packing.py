"""Packing: what is fixed is in some best packing, and every piece has its place."""

import random
import struct
from collections import Counter, defaultdict
from functools import lru_cache
from zlib import crc32

import pytest

from meshwork.llm import packing
from tests.llm.cases import frame, texts


def fewest(sizes, capacity):
    """The fewest sequences, by search."""
    sizes = sorted(sizes, reverse=True)

    @lru_cache(None)
    def fits(k, rooms):
        if k == len(sizes):
            return True
        return any(fits(k + 1, tuple(sorted((*rooms[:i], r - sizes[k], *rooms[i + 1 :])))) for i, r in enumerate(rooms) if r >= sizes[k] and r not in rooms[:i])

    n = -(-sum(sizes) // capacity)
    while not fits(0, (capacity,) * n):
        n += 1
    return n


def checked(plan, sizes, capacity):
    """The sequences of a plan, each with its pieces; all is gapless and every piece is placed once."""
    at = defaultdict(list)
    for length, first, n, begin, each, offset in plan.runs:
        for m in range(n):
            at[begin + m // each].append((offset + m % each * length, length, first + m))
    for row in at.values():
        end = 0
        for offset, length, _ in sorted(row):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted((length, k) for row in at.values() for _, length, k in row) == sorted((length, k) for length, n in Counter(sizes).items() for k in range(n))
    assert sorted(at) == list(range(plan.bins))
    return at


@pytest.mark.parametrize("low", [1, 4, 7])
def test_reduction_keeps_a_best_packing(low):
    """Fixed sequences and the fewest for the rest are as few as the fewest for all; then best fit of the rest."""
    rng, fixed = random.Random(low), 0
    for _ in range(400):
        capacity = rng.randint(10, 24)
        sizes = [rng.randint(min(low, capacity), capacity) for _ in range(rng.randint(1, 9))]
        plan = packing.plan(dict(Counter(sizes)), capacity)
        at = checked(plan, sizes, capacity)
        rest = [length for b, row in at.items() if b >= plan.fixed for _, length, _ in row]
        assert plan.fixed + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)
        assert plan.bins <= packing.plan(dict(Counter(sizes)), capacity, reduce=False).bins
        fixed += plan.fixed
    assert fixed > 400


def best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_best_fit_by_counts_is_best_fit_by_pieces():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        sizes = [rng.randint(1, rng.choice((5, capacity)) if capacity > 5 else capacity) for _ in range(rng.randint(0, 120))]
        plan = packing.plan(dict(Counter(sizes)), capacity, reduce=False)
        at = checked(plan, sizes, capacity)
        assert sorted(capacity - sum(x[1] for x in row) for row in at.values()) == best_fit(sizes, capacity)


def test_large_counts_are_planned_near_the_bound():
    rng = random.Random(5)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(300_000))
    counts[256] += 10**12
    plan = packing.plan(dict(counts))
    total = sum(k * n for k, n in counts.items())
    assert sum(r[2] for r in plan.runs) == sum(counts.values()) and len(plan.runs) < 40_000
    assert plan.bins <= 1.001 * total / 4096 + sum(n for k, n in counts.items() if k > 4000)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_documents_are_packed_whole(spark, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = texts()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            want[doc, n, at, struct.pack(f"<{len(ids[at : at + capacity])}I", *ids[at : at + capacity])] += 1
    packed = packing.pack(frame(spark, rows).repartition(7), capacity=capacity, tokens=True).cache()
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.tokens)) for r in got) == want
    assert all(r.ids_crc32 == crc32(r.tokens) and r.length * 4 == len(r.tokens) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, bytes(r.tokens)))
    for row in by.values():
        row.sort()
        assert [o * 4 for o, _ in row] == [sum(len(x) for _, x in row[:k]) for k in range(len(row))] and sum(len(x) for _, x in row) <= 4 * capacity
    bound = sum(r.length for r in got) / capacity
    assert bound <= len(by) <= 1.15 * bound + 1
    read = {r.sequence_id: bytes(r.tokens) for r in packing.sequences(packed).collect()}
    assert read == {k: b"".join(x for _, x in row) for k, row in by.items()}
    packed.unpersist()


def test_packing_edges(spark):
    nothing = packing.digest(packing.pack(frame(spark, texts()).where("false")))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    same = packing.digest(packing.pack(frame(spark, [(k % 5, "one two three") for k in range(500)]).repartition(9))).collect()
    assert len({(r.sequence_id, r.offset) for r in same}) == 500 and len({r.sequence_id for r in same}) == 1
