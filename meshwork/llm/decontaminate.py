"""Benchmark decontamination.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is n
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

The windows are few: their hashes and words are broadcast, after a check of their texts' size (they
take some ten times as much). A benchmark over BROADCAST_BYTES is dealt with in parts of about that, one
pass each, one part in memory at a time; the hits of all parts are joined before anything is judged or
cut, so results do not depend on the limit. In a task, words become
numbers of the benchmark's vocabulary, a window hash is a weighted sum of n numbers, and a
sorted lookup gives the candidates; each is verified word by word.

Null and empty texts have no words and no hits. Items with null text or without words are no
windows; a null item id is left out of the lists of items. Repeated items and rows are treated
one by one; items that repeat an id count once. An empty benchmark hits nothing. Other columns
are carried by `decontaminate` and ignored by `find_hits`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, keyed, map_slices, octets, saved, unused

WINDOW = 10
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower case for A-Z; what is in no word becomes a blank.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of benchmark text up to which its windows are broadcast.
BROADCAST_BYTES = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(CLEAN).split()


class Windows:
    """The windows of a benchmark: for each length, their hashes, words and items, as arrays."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items if item is not None})
        place, by = {item: k for k, item in enumerate(self.items)}, {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                size = min(n, len(ids))
                windows = np.lib.stride_tricks.sliding_window_view(ids, size)
                by.setdefault(size, []).append((windows, np.full(len(windows), place.get(item, -1), np.int32)))
        self.lengths = {}
        for size in sorted(by):
            rows, owner = (np.concatenate(c) for c in zip(*by.pop(size)))
            key = self.key(rows.T)
            order = np.argsort(key, kind="stable")
            self.lengths[size] = key[order], rows[order], owner[order]

    @staticmethod
    def key(columns) -> np.ndarray:
        mix = np.random.default_rng(3).integers(1, 2**63, len(columns), np.uint64) * np.uint64(2) + np.uint64(1)
        return sum(c.astype(np.uint64) * m for c, m in zip(columns, mix))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and by which items. ids: 0 is a word that no item has."""
        hit, items = np.zeros(len(ids), bool), set()
        ids = ids.astype(np.int32)
        known = ids > 0
        for size, (keys, rows, owner) in self.lengths.items():
            n = len(ids) - size + 1
            if n < 1:
                break
            if size > 1:  # only where all words are known
                run = np.cumsum(np.concatenate([[0], known]))
                at = np.flatnonzero(run[size:] - run[:-size] == size)
            else:
                at = np.flatnonzero(known)
            if not len(at):
                continue
            key = self.key([ids[at + k] for k in range(size)])
            place = np.searchsorted(keys, key)
            for more in range(len(keys)):  # windows with one hash lie side by side, as do those of several items
                live = (place + more < len(keys)) & (keys[np.minimum(place + more, len(keys) - 1)] == key)
                if not live.any():
                    break
                p, a = place[live] + more, at[live]
                same = (rows[p] == ids[a[:, None] + np.arange(size)]).all(axis=1)
                for k in range(size):
                    hit[a[same] + k] = True
                items.update(owner[p[same]].tolist())
        return hit, {self.items[k] for k in items if k >= 0}

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Windows:
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).collect()
    return Windows([(r[0], bytes(r[1] or b"")) for r in rows], n)


def parts_of(benchmark: DataFrame, text_col: str, limit: int) -> list[DataFrame]:
    """The benchmark, in as many parts as keep the texts of each near half the limit; a longer item is a part of
    its own, more or less."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    if total <= limit:
        return [benchmark]
    n = -(-2 * total // limit)
    return [benchmark.where(F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(n)) == k) for k in range(n)]


def located(docs: DataFrame, windows: Windows, id_col: str, text_col: str) -> DataFrame:
    """The id, n_words, hit (places of the words hit), items."""
    held = docs.sparkSession.sparkContext.broadcast(windows)

    def make():
        windows = held.value

        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in octets(part.column(1)):
                words = words_of(text)
                hit, items = windows.hits(windows.ids(words))
                rows.append((len(words), np.flatnonzero(hit), sorted(items)))
            n_words, hit, items = zip(*rows)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [id_col, "n_words", "hit", "items"])

        return handle

    return map_slices(keyed(docs, id_col, text_col), make, f"`{id_col}` {id_type(docs, id_col)}, n_words long, hit array<int>, items array<string>")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: the id, n_words, n_hit, and items array<string>, sorted."""
    parts = parts_of(benchmark, item_text_col, limit)
    windows = lambda p: benchmark_windows(p, item_col, item_text_col, n)
    if len(parts) == 1:
        return located(docs, windows(parts[0]), id_col, text_col).select(id_col, "n_words", F.size("hit").cast("long").alias("n_hit"), "items")
    # One pass over the texts per part; the places hit are joined by id and text.
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash")).alias("key"), F.col(text_col).alias("text"))
    every = reduce(DataFrame.unionAll, [saved(located(rows, windows(p), "key", "text").where(F.size("hit") > 0).distinct(), "benchmark-hits") for p in parts])
    hits = every.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counts = located(rows, Windows([], n), "key", "text").select(F.col("key").alias("row"), "n_words")
    joined = counts.join(hits, (F.col("row.id").eqNullSafe(F.col("key.id"))) & (F.col("row.hash") == F.col("key.hash")), "left")
    none = F.array().cast("array<string>")
    return joined.select(F.col("row.id").alias(id_col), "n_words", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def without(text: bytes, spans: list[tuple[int, int]], hit: np.ndarray) -> bytes:
    """The text without the runs of hit words and what lies between them. spans: of its words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    keep, done = [], 0
    for b, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        keep.append(text[done : spans[b][0]])
        done = spans[e - 1][1]
    return b"".join([*keep, text[done:]])


def cut(text: bytes, windows: Windows) -> tuple[bytes | None, int, int]:
    """The text without its hit spans, and the numbers of words and of hit ones. Cuts again until
    what is left makes no window anew."""
    first = None
    while True:
        clean = text.translate(CLEAN)
        spans = [m.span() for m in WORD.finditer(clean)]
        ids = windows.ids([clean[b:e] for b, e in spans])
        hit, _ = windows.hits(ids)
        first = first or (len(ids), int(hit.sum()))
        if not hit.any():
            return text, *first
        text = without(text, spans, hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, drop_share: float = 0.5, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs with hit spans cut out of its texts; a row of whose words more than drop_share are hit goes."""
    parts = parts_of(benchmark, item_text_col, limit)
    windows = lambda p: benchmark_windows(p, item_col, item_text_col, n)
    return cut_out(docs, windows(parts[0]), text_col, drop_share) if len(parts) == 1 else cut_by_parts(docs, parts, windows, text_col, drop_share)


def cut_by_parts(docs: DataFrame, parts: list[DataFrame], windows: Callable[[DataFrame], Windows], text_col: str, drop_share: float) -> DataFrame:
    """As cut_out with the windows of all parts: a round finds the hits of every part in the same texts and
    cuts their union; the first one judges the rows. Rounds go on until nothing is hit."""
    key, found, at = unused(docs, "cut_key"), unused(docs, "cut_hit"), docs.columns.index(text_col)
    schema, columns, first = docs.schema, docs.columns, True

    def make():
        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(at).cast(pa.binary()).to_pylist()
            for i, places in enumerate(part.column(len(columns)).to_pylist()):
                if places:
                    spans = [m.span() for m in WORD.finditer(texts[i].translate(CLEAN))]
                    hit = np.zeros(len(spans), bool)
                    hit[places] = True
                    texts[i] = without(texts[i], spans, hit)
            column = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
            return pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(part.columns[: len(columns)])], columns)

        return handle

    while True:
        rows = docs.withColumn(key, F.sha2(F.col(text_col).cast("string").cast("binary"), 256))
        texts = rows.where(F.col(key).isNotNull()).select(key, text_col).dropDuplicates([key])
        every = reduce(DataFrame.unionAll, [saved(located(texts, windows(p), key, text_col).where(F.size("hit") > 0), "benchmark-hits") for p in parts])
        hits = saved(every.groupBy(key).agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias(found)), "decontamination-hits")
        if hits.isEmpty():
            return docs
        if first:
            hits = hits.withColumn("goes", F.size(found) > drop_share * F.col("n_words"))
            rows = rows.join(hits.where("goes").select(key), key, "left_anti")
        joined = rows.join(hits.select(key, found), key, "left").select(*columns, found)
        docs, first = saved(map_slices(joined, make, schema, text_at=at), "decontaminated"), False


def cut_out(docs: DataFrame, windows: Windows, text_col: str, drop_share: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(windows)
    at = docs.columns.index(text_col)

    def make():
        windows = held.value

        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            there = part.column(at).is_valid().to_pylist()
            texts, keep = [], []
            for text, valid in zip(octets(part.column(at)), there):
                left, n_words, n_hit = cut(text, windows)
                texts.append(left if valid else None)
                keep.append(n_hit <= drop_share * n_words)
            column = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
            out = pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(part.columns)], part.schema.names)
            return out.filter(pa.array(keep, pa.bool_()))

        return handle

    return map_slices(docs, make, docs.schema, text_at=at)


def digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return hits.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: digest(find_hits(documents, benchmark)), by joining all windows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS window_text
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS window_text
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
), found AS (SELECT doc_id, places.size, p, item FROM places JOIN windows USING (size, window_text)
), words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p + k AS at_word FROM found, range(0, 10) AS t(k) WHERE k < size) GROUP BY ALL
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY ALL)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
