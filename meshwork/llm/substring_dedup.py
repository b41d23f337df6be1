"""Repeated byte strings across documents, by merging shard Burrows-Wheeler transforms.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document of a smaller
id. Exact copies of a text are set aside first: of LENGTH bytes or more they go whole.

1. Anchors. Each window of LENGTH bytes has a minimizer, the least hash of its GRAM-grams; equal
   windows have equal ones. A run of windows with one minimizer is a segment. Minimizers that only
   one document has are dropped: a shuffle deals (minimizer, document) out in packed blocks, in
   which a minimizer occurs once a slice of documents, however many of its documents have it.
2. Shards. Each slice of documents sorts the suffixes of its remaining segments and sends, by
   minimizer, their Burrows-Wheeler transform and where the segments occur.
3. Merge. A task gets the transforms of all shards for its minimizers. It walks them backwards for
   lengths, hashes and suffix lengths, sets segments aside that have the same content, and merges
   the transforms: starting from all suffixes in one interval, each round reads the characters
   before the suffixes in the current interleave, and a stable sort by them gives the interleave
   by one more character (Holt and McMillan, 2014). Where neighbours first part tells their common
   prefix; intervals of one suffix can't repeat and leave. After LENGTH rounds the intervals
   left are the repeated strings; the smallest document in each stays, the others lose the string.
4. Spans go back to their documents, which are cut.

The suffixes of all shards are never sorted again, and no task sees more than its minimizers'
segments. A minimizer with very many different surroundings is the largest unit of work of step 3.

Ids are integers. Null and empty texts have no bytes. Rows without an id keep their bytes and do
not count. Rows that repeat an id and a text are one document; of several texts of an id, the
one of the smallest hash counts and is cut, the others stay whole. An empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.hamming import ranges
from meshwork.llm.rows import id_type, keyed, map_slices, octets, saved

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
SLICE = 2 << 20
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All texts end to end, and for each segment: text, first window (in all bytes and in its text), windows, minimizer."""
    lens = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lens)
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return raw, none, none, none, none, none.astype(np.uint64)
    # Eight bytes at each place; three of these cover a gram. The last step mixes, which the order of minimizers needs.
    eight = np.lib.stride_tricks.as_strided(np.append(raw, np.zeros(8, np.uint8))[:8].view(U), (len(raw),), (1,))
    n = len(raw) - GRAM + 1
    gram = eight[:n] * U(0x9E3779B97F4A7C15)
    gram += eight[8 : n + 8]
    gram *= U(0xC2B2AE3D27D4EB4F)
    gram += eight[GRAM - 8 : n + GRAM - 8]
    gram = mixed(gram)
    least, width = gram, 1
    while width * 2 <= SPAN:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    n = len(gram) - SPAN + 1
    least = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
    valid = np.zeros(n + 1, np.int8)
    long = lens >= LENGTH
    np.add.at(valid, (ends - lens)[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    there = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    # A segment begins where a text does (no window spans two) or the minimizer changes.
    new = there.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~there[:-1]
    head = np.flatnonzero(new)
    stop = np.append(head[1:], n)
    text = np.searchsorted(ends, head, "right")
    windows = np.minimum(stop, ends[text] - LENGTH + 1) - head
    if len(windows) and windows.max() > SPAN:
        # In a long run of one minimizer, as in a repeated character, a segment ends after SPAN windows.
        parts = -(-windows // SPAN)
        at = ranges(parts) * SPAN
        head, windows = np.repeat(head, parts) + at, np.minimum(np.repeat(windows, parts) - at, SPAN)
        text = np.searchsorted(ends, head, "right")
    return raw, text, head, head - (ends - lens)[text], windows, least[head]


def split(a: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer's bucket, and 30 further bits of it; two that agree in both count as one, which costs work only."""
    return (a % U(buckets)).astype(np.int32), (a >> U(34)).astype(np.int32)


def joint(bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return bucket.astype(np.int64) << 30 | tag.astype(np.int64)


def lists(values: np.ndarray, groups: np.ndarray, n: int, kind=pa.int64()) -> pa.Array:
    """groups ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


PACKED = "bucket int, packed binary"


def packed_by(bucket: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Buckets, and of each the columns one after the other; rows keep their order within a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    edges = np.append(first, len(bucket)).tolist()
    return bucket[first].tolist(), [b"".join(c[b:e].tobytes() for c in columns) for b, e in zip(edges, edges[1:])]


def unpacked_by(raw: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def replies(text: np.ndarray, minimizer: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(text, minimizer) packed by buckets of texts."""
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(packed_by(((text.view(U) >> U(20)) % U(buckets)).astype(np.int32), text, minimizer), (pa.int32(), pa.binary()))], ["bucket", "packed"])


def anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """rows: hash and text. For each slice of texts, packed by bucket: its minimizers, each with the first of the
    texts there that has it; and, by bucket of texts (-1 - bucket), minimizers that several texts of the slice share."""

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column(0).to_numpy(zero_copy_only=False)
        _, text, _, _, _, a = segments(octets(part.column(1)))
        bucket, tag = split(a, buckets)
        # A stable sort finds the first text of each minimizer, and the minimizers of several texts.
        order = stably(a)
        key, owner = a[order], text[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        first = order[head]
        first.sort()  # in the texts' order, which packs well
        low, high = edges_of(key, ids[owner])
        shared = order[low != high]
        own, raw = packed_by(bucket[first], tag[first], ids[text[first]])
        within = replies(ids[text[shared]], joint(bucket[shared], tag[shared]), buckets)
        back = [-1 - b for b in within.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([*own, *back], pa.int32()), pa.array([*raw, *within.column(1).to_pylist()], pa.binary())], ["bucket", "packed"])

    return map_slices(rows, lambda: handle, PACKED, limit=SLICE)


def edges_of(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest and the largest text hash of its key; keys ascend."""
    if not len(key):
        return text, text
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    return np.repeat(np.minimum.reduceat(text, first), size), np.repeat(np.maximum.reduceat(text, first), size)


def repeats_between(blocks: DataFrame, partitions: int, buckets: int) -> DataFrame:
    """text, repeated: the minimizers that a text shares with others, once or twice."""

    def answer(batches):
        keys, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            bucket, packed = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            back = np.flatnonzero(bucket < 0)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - bucket[back], pa.int32()), packed.take(pa.array(back))], ["bucket", "packed"])
            for k in np.flatnonzero(bucket >= 0).tolist():
                tag, text = unpacked_by(packed[k].as_py(), np.int32, np.int64)
                keys.append(joint(np.full(len(tag), bucket[k]), tag))
                texts.append(text)
        key, text = np.concatenate(keys), np.concatenate(texts)
        order = np.argsort(key)
        key, text = key[order], text[order]
        low, high = edges_of(key, text)
        several = low != high
        yield replies(text[several], key[several], buckets)

    def collect(batches):
        texts, tags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                text, tag = unpacked_by(raw, np.int64, np.int64)
                texts.append(text)
                tags.append(tag)
        text, tag = np.concatenate(texts), np.concatenate(tags)
        order = np.argsort(text)
        there = np.unique(text)
        for k in range(0, len(there), 10_000):
            some = there[k : k + 10_000]
            mine = order[np.searchsorted(text, some[0], sorter=order) : np.searchsorted(text, some[-1], "right", sorter=order)]
            yield pa.RecordBatch.from_arrays([pa.array(some), lists(tag[mine], np.searchsorted(some, text[mine]), len(some))], ["text", "repeated"])

    asked = blocks.repartition(partitions, "bucket").mapInArrow(answer, PACKED)
    return asked.repartition(partitions, "bucket").mapInArrow(collect, "text long, repeated array<long>")


def stably(*keys: np.ndarray) -> np.ndarray:
    """The stable order by keys, the first one leading: as numbers with the place in their low bits, which
    sort several times faster than places by numbers; so a key takes more than one pass if it is wide."""
    n = len(keys[0])
    bits = max(1, int(n).bit_length())
    place, low = np.arange(n, dtype=U), U((1 << bits) - 1)
    order = None
    for key in reversed(keys):
        key = key.astype(U)
        width = int(key.max(initial=0)).bit_length()
        for shift in range(0, max(width, 1), 64 - bits):
            some = key if order is None else key[order]
            some = (some >> U(shift)) << U(bits) | place
            some.sort()
            at = (some & low).view(np.int64)
            order = at if order is None else order[at]
    return order


def suffix_order(symbols: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Positions by bucket, then by what follows up to the next 0; equal ones by position. Prefix doubling
    that sorts again only what is still tied."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, np.uint16)]).astype(np.uint64)
    key, alive = padded[:n].copy(), padded[:n] > 0
    for k in range(1, 7):
        s = np.where(alive, padded[k : n + k], U(0))
        key = key << U(9) | s
        alive &= s > 0
    order = stably(bucket, key)
    new = np.concatenate([[True], (key[order[1:]] != key[order[:-1]]) | (bucket[order[1:]] != bucket[order[:-1]])])
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = first[np.cumsum(new) - 1]
    depth = 7
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    tied = tied[alive[order[tied]]]
    while len(tied):
        p = order[tied]
        group, second = rank[p], rank[p + depth]
        by = stably(group, second)
        order[tied] = p = p[by]
        group, second = group[by], second[by]
        starts = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        # Ranks change only after all have been read.
        rank[p] = tied[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        lone = starts & np.append(starts[1:], True)
        ended = symbols_end(symbols, p, depth)
        tied = tied[~lone & ~ended]
        depth *= 2
    return order


def symbols_end(symbols: np.ndarray, p: np.ndarray, depth: int) -> np.ndarray:
    """Whether the string at p ends before p + 2 * depth."""
    ends = np.flatnonzero(symbols == 0)
    return ends[np.searchsorted(ends, p)] < p + 2 * depth


SHARDS = pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int32())), ("packed", pa.binary())])


def shards(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: id, text, tags (array<long>: the repeated minimizers). A row per slice and bucket: the
    transform of its segments, and where they occur, packed (see unpacked)."""

    def make():
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)

        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            raw, text, at, place, windows, a = segments(octets(part.column(1)))
            bucket, tag = split(a, buckets)
            tag = joint(bucket, tag)
            per_text = part.column(2)
            lens = pc.fill_null(pc.list_value_length(per_text), 0).to_numpy(zero_copy_only=False)
            known = per_text.flatten().to_numpy(zero_copy_only=False)
            both = lambda t, k: mixed(k.astype(np.uint64) * U(0x9E3779B97F4A7C15) + t.astype(np.uint64))
            live = np.flatnonzero(np.isin(both(text, tag), both(np.repeat(np.arange(len(lens)), lens), known)))
            live = live[np.argsort(bucket[live], kind="stable")]
            text, at, place, windows, bucket, tag = (x[live] for x in (text, at, place, windows, bucket, tag))
            if not len(live):
                return pa.RecordBatch.from_pylist([], SHARDS)
            data = raw.tobytes()
            number: dict[tuple[int, bytes], int] = {}
            string = np.array([number.setdefault((t, data[b : b + n]), len(number)) for t, b, n in zip(tag.tolist(), at.tolist(), (windows + LENGTH - 1).tolist())], np.int32)
            _, first = np.unique(string, return_index=True)
            sizes = windows[first] + LENGTH - 1
            ends = np.cumsum(sizes + 1) - 1
            symbols = np.zeros(int(ends[-1]) + 1, np.uint16)
            inner = np.ones(len(symbols), bool)
            inner[ends] = False
            symbols[inner] = np.frombuffer(b"".join(s for _, s in number), np.uint8).astype(np.uint16) + 1
            of = np.repeat(bucket[first], sizes + 1)
            order = suffix_order(symbols, of.astype(np.uint16) if buckets < 65536 else of)
            before = symbols[order - 1]  # before a string's first symbol lies the end of another: 0
            there = np.unique(bucket)
            rows = []
            for k, c, d, e, f, g, h in zip(there.tolist(), *(np.searchsorted(x, there, side) for x in (of, bucket[first], bucket) for side in ("left", "right"))):
                b = before[c:d]
                columns = ((np.maximum(b, 1) - 1).astype(np.uint8), np.flatnonzero(b == 0).astype(np.int32), tag[first][e:f], (string[g:h] - e).astype(np.int32), ids[text[g:h]].astype(np.int64), place[g:h].astype(np.int32))
                rows.append((k, [len(x) for x in columns], packer.compress(b"".join(x.tobytes() for x in columns))))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), SHARDS)], schema=SHARDS)

        return handle

    return map_slices(docs, make, "bucket int, sizes array<int>, packed binary", limit=SLICE)


def unpacked(sizes: list[int], packed: bytes) -> list[np.ndarray]:
    """The transform's bytes, the slots before which a string ends, the strings' minimizers, and of each
    occurrence its string, document and first byte there."""
    import zstandard

    kinds = (np.uint8, np.int32, np.int64, np.int32, np.int64, np.int32)
    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class Merged:
    """The shards of one bucket side by side; slots number the suffixes of all, shard after shard."""

    def __init__(self, rows: list[dict]):
        symbol, back, first, base = [], [], [], 0
        tag, string, doc, place, strings = [], [], [], [], 0
        slots = np.int32 if sum(row["sizes"][0] for row in rows) < 1 << 31 else np.int64
        for row in rows:
            bwt, ends, own_tag, own_string, own_doc, own_place = unpacked(row["sizes"], row["packed"])
            bwt = bwt.astype(np.uint16) + np.uint16(1)
            bwt[ends] = 0
            order = np.argsort(bwt, kind="stable")
            to = np.empty(len(bwt), slots)
            to[order] = np.arange(base, base + len(bwt), dtype=slots)
            symbol.append(bwt)
            back.append(to)
            first.append(np.arange(base, base + len(ends), dtype=slots))  # the ends sort first
            tag.append(own_tag)
            string.append(own_string.astype(np.int64) + strings)
            doc.append(own_doc)
            place.append(own_place.astype(np.int64))
            base, strings = base + len(bwt), strings + len(ends)
        self.symbol, self.back = np.concatenate(symbol), np.concatenate(back)
        self.tag, self.string, self.doc, self.place = (np.concatenate(x) for x in (tag, string, doc, place))
        self.walk(np.concatenate(first))

    def walk(self, now: np.ndarray) -> None:
        """Backwards through all strings at once: of each slot its string and the length of its suffix; of
        each string its length and a hash."""
        n = len(now)
        self.of, self.suffix = np.zeros(len(self.symbol), np.int32), np.zeros(len(self.symbol), np.int16)
        self.size, self.hash = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        who, t, h = np.arange(n, dtype=np.int32), 0, np.zeros(n, U)
        while len(now):
            self.of[now], self.suffix[now] = who, t
            s = self.symbol[now]
            if not s.all():
                done, go = np.flatnonzero(s == 0), np.flatnonzero(s)
                self.size[who[done]], self.hash[who[done]] = t, h[done]
                who, now, s, h = who[go], now[go], s[go], h[go]
            h = (h ^ s) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(32)
            now, t = self.back[now], t + 1

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each string: its content's number; of each content: the smallest document; and the contents that
        share their minimizer with another one."""
        order = np.lexsort((self.size, self.hash, self.tag))
        t, h, s = self.tag[order], self.hash[order], self.size[order]
        same = (t[1:] == t[:-1]) & (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        content = np.empty(len(order), np.int64)
        content[order] = np.cumsum(np.concatenate([[False], ~same]))
        low = np.full(int(content.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, content[self.string], self.doc)
        head = order[np.concatenate([[True], ~same])]  # a string of each content
        tags = self.tag[head]
        meets = np.zeros(len(head), bool)
        meets[1:] |= tags[1:] == tags[:-1]
        meets[:-1] |= tags[1:] == tags[:-1]
        return content, low, head[meets]

    def intervals(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of suffixes of these strings whose first LENGTH characters occur at another slot too, by
        interval, and the interval of each: the interleave after LENGTH rounds."""
        use = np.zeros(len(self.size), bool)
        use[strings] = True
        slot = np.flatnonzero(use[self.of]).astype(self.back.dtype)
        block = np.zeros(len(slot), np.int32)
        for depth in range(LENGTH):
            s = self.symbol[slot]
            if not s.all():
                go = np.flatnonzero(s)
                slot, block, s = slot[go], block[go], s[go]
            s = (s - np.uint16(1)).astype(np.uint8)
            by = np.argsort(s, kind="stable")
            s, block = s[by], block[by]
            slot = self.back[slot[by]]
            # Neighbours that part here have a common prefix of depth characters.
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (block[1:] != block[:-1])]) if len(s) else np.zeros(0, bool)
            block = np.cumsum(new, dtype=np.int32) - np.int32(1)
            if depth >= 3:
                keep = ~(new & np.append(new[1:], True)) if len(new) else new
                slot, block = slot[keep], block[keep]
        return slot, block

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first byte and end of what goes, by occurrence; runs of windows are one."""
        content, low, ambiguous = self.least()
        slot, block = self.intervals(ambiguous)
        string_of, window = self.of[slot].astype(np.int64), self.size[self.of[slot]] - self.suffix[slot]
        width = SPAN
        least = np.repeat(low, width).reshape(-1, width)
        if len(slot):
            block = np.unique(block, return_inverse=True)[1]
            smallest = np.full(int(block.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, block, low[content[string_of]])
            np.minimum.at(least, (content[string_of], window), smallest[block])
        which = content[self.string]
        windows = self.size[self.string] - LENGTH + 1
        goes = (self.doc[:, None] > least[which]) & (np.arange(width) < windows[:, None])
        edge = np.diff(np.pad(goes, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, b = np.nonzero(edge == 1)
        _, e = np.nonzero(edge == -1)
        return self.doc[i], self.place[i] + b, self.place[i] + e - 1 + LENGTH


def merge(blocks: DataFrame, partitions: int) -> DataFrame:
    """doc, begins, ends: spans to remove, from each bucket on its own."""

    def run(batches):
        by: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by.setdefault(row["bucket"], []).append(row)
        while by:
            doc, begin, end = Merged(by.popitem()[1]).removed()
            order = np.lexsort((begin, doc))
            there = np.unique(doc)
            groups = np.searchsorted(there, doc[order])
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), lists(begin[order].astype(np.int32), groups, len(there), pa.int32()), lists(end[order].astype(np.int32), groups, len(there), pa.int32())], ["doc", "begins", "ends"])

    return blocks.repartition(partitions, "bucket").mapInArrow(run, "doc long, begins array<int>, ends array<int>")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, n_bytes, n_removed, n_spans, kept (binary)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n
    rows = keyed(df, id_col, text_col).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("content"))
    named, hash_of = rows.where("doc is not null"), F.xxhash64("content")
    long = named.where(F.octet_length("content") >= LENGTH)
    small = long.select("doc", F.struct(hash_of.alias("hash"), F.xxhash64(F.lit("other"), "content").alias("second"), F.octet_length("content").alias("size")).alias("key")).distinct()
    one = saved(small.groupBy("doc").agg(F.min("key").alias("key")), "texts")
    firsts = saved(one.groupBy("key").agg(F.min("doc").alias("doc")), "first-texts")
    copies = one.join(firsts.withColumnRenamed("doc", "first"), "key").where(F.col("doc") > F.col("first"))
    # Texts are told apart by their hashes here, so that copies of one are no repetition.
    known = repeats_between(anchors(long.select(hash_of.alias("hash"), "content"), buckets), n, buckets)
    tags = known.join(firsts.select("doc", F.col("key.hash").alias("text"), F.col("key.hash").alias("hash")), "text").select("doc", "hash", F.col("repeated").alias("tags"))
    # This join and the last one deal out the same frame by doc; Spark shuffles it once (for that the
    # text has a name of its own: an alias of the same name is dropped from one of the two).
    mine = hash_of == F.col("hash")
    heads = named.join(tags, "doc").select("doc", "content", F.when(mine, F.col("tags")).alias("tags"))
    spans = merge(shards(heads, buckets), n)
    cuts = spans.groupBy("doc").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    cuts = cuts.join(one, "doc").select("doc", F.col("key.hash").alias("hash"), "begins", "ends")
    whole = copies.select("doc", F.col("key.hash").alias("hash"), F.array(F.lit(0)).alias("begins"), F.array(F.lit(2**31 - 1)).alias("ends"))
    joined = named.join(cuts.unionAll(whole), "doc", "left").select("doc", "content", F.when(mine, F.col("begins")).alias("begins"), F.when(mine, F.col("ends")).alias("ends"))
    none = F.lit(None).cast("array<int>")
    joined = joined.unionAll(rows.where("doc is null").select("doc", "content", none, none)).select(F.col("doc").cast(df.schema[id_col].dataType).alias(id_col), "content", "begins", "ends")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept"]

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, begins, ends in zip(octets(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
            kept, done, n = [], 0, 0
            for b, e in sorted(zip(begins or [], ends or [])):
                e = min(e, len(text))
                if b > done or not n:
                    kept.append(text[done:b])
                    n += 1
                done = max(done, e)
            kept.append(text[done:])
            left = b"".join(kept)
            out.append((len(text), len(text) - len(left), n, left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    return map_slices(joined, lambda: handle, f"`{id_col}` {id_type(df, id_col)}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cut.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
