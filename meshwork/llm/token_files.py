"""Token ids in seekable zstandard files.

A shard file is a sequence of independent zstandard frames, each the little-endian unsigned
32-bit ids of whole documents; a skippable frame with the document index (an Arrow stream: id,
n_tokens, frame); and a trailing skippable frame with the seek table of the public "zstd
seekable format": for each frame its compressed size, its size and a checksum (the low 32 bits
of XXH64 of its content). A plain zstandard reader sees all ids of the shard; ours reads the
index and decompresses only the frames of the documents asked for.

Documents are range-partitioned and sorted by id (nulls first, ties by text), so shards and the
documents in them ascend. A task writes its shard under a name of its own attempt and moves it
into place when complete, so a repeated task leaves one whole file. Only the totals of the
shards, one number each, pass through the driver.

Null and empty texts give the end id alone. Repeated rows are written one by one. An empty
table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, keyed, saved, shared_folder, slices, strings

SKIP_INDEX, SKIP_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
FRAMES_A_READER = 64
CACHED_PARTS = 800_000
#: Bytes of text encoded at once.
SLICE = 2 << 20
#: Characters of a chunk up to which its ids are kept.
CACHED_LENGTH = 64
#: What the last token of a run of letters ends in.
END = "</w>"
#: Signs and letters of Latin-1 that end in a letter, then ASCII punctuation.
WORD_AND_SIGNS = re.compile("([\x21-\x7e\xa1-\xac\xae-\xff]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])([!-/:-@\\[-`{-~]*)")
#: Chunks on which a tokenizer has to show that parts can be encoded apart.
PROBES = ("Word,", "WORD!!", "été&&&", "GRÖSSE###", "a.", "Ab|", "x***.")


class ChunkEncoder(dict):
    """Part of a chunk of text between blanks -> its ids as bytes, by the tokenizers library. The tokenizer drops
    white space, lowers case and parts letters from other signs before it looks for pairs, and none
    of its tokens spans any of these borders; so the ids of a text are those of its chunks, and
    those of a chunk that ends in punctuation are its letters' and its punctuation's. The last token of a
    run of letters, and no other one, ends in END, so that many runs can be encoded at once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(END)]] = True
        self.parts = all(self.one(c) == [i for p in self.split(c) for i in self.one(p)] for c in PROBES)

    @staticmethod
    def split(chunk: str) -> tuple[str, str]:
        """The chunk in two parts, the first in lower case where that is the same in every context."""
        m = WORD_AND_SIGNS.fullmatch(chunk)
        return (m[1].lower(), m[2]) if m and "<|" not in chunk else (chunk, "")

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, asked: list[str]) -> None:
        letters = [c for c in asked if c.isalpha()]
        for begin in range(0, len(letters), 5_000):
            some = letters[begin : begin + 5_000]
            ids = np.array(self.one(" ".join(some)), "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) == len(some):  # else the library sees other letters than Python
                raw = ids.tobytes()
                self.update((c, raw[b:e]) for c, b, e in zip(some, [0, *ends.tolist()], ends.tolist()))
        left = [c for c in asked if c not in self]
        for begin in range(0, len(left), 5_000):
            some = left[begin : begin + 5_000]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """texts: strings without nulls."""
        if len(self) > CACHED_PARTS:
            self.clear()
        self[""] = b""
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = chunks.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [c for c in known if c not in self]
        parts = list(map(self.split, fresh)) if self.parts else [(c, "") for c in fresh]
        self.learn([p for p in set(chain.from_iterable(parts)) if p not in self])
        self.update((c, self[core] + self[tail]) for c, (core, tail) in zip(fresh, parts) if tail or core != c)
        found = list(map(self.__getitem__, known))
        for c in fresh:
            if len(c) > CACHED_LENGTH:
                del self[c]
        # The ids of every chunk in its place, by the chunk's number.
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lens) - lens
        index = words.indices.to_numpy(zero_copy_only=False)
        size = lens[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(at[index] - ends[:-1], size) + np.arange(int(ends[-1]))]
        edges = ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()].tolist()
        return [ids[b:e].tobytes() for b, e in zip(edges, edges[1:])]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ShardWriter:
    """Frames, document index and seek table, in that order, to a binary file object."""

    def __init__(self, out, id_kind: pa.DataType, level: int = 1):
        import zstandard

        self.out, self.id_kind = out, id_kind
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.held: list[bytes] = []
        self.size = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id, ids: bytes) -> None:
        if self.held and self.size + len(ids) > FRAME_BYTES:
            self.flush()
        for column, x in zip(self.index, (doc_id, len(ids) // 4, len(self.seek))):
            column.append(x)
        self.held.append(ids)
        self.size += len(ids)

    def flush(self) -> None:
        import xxhash

        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        kinds = (self.id_kind, pa.uint32(), pa.uint32())
        rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.index, kinds)], ["id", "n_tokens", "frame"])
        buffer = io.BytesIO()
        with pa.ipc.new_stream(buffer, rows.schema) as stream:
            stream.write_batch(rows)
        index = buffer.getvalue()
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


class ShardReader:
    """Random access to a shard file: a binary file object with seek and a known size."""

    def __init__(self, file, size: int):
        self.file = file
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        entries = struct.unpack(f"<{3 * n}I", self.at(size - 9 - 12 * n, 12 * n))
        self.packed, self.sizes, self.sums = (np.array(entries[k::3], np.int64) for k in range(3))
        self.begins = np.concatenate([[0], np.cumsum(self.packed)])
        skip, length = struct.unpack("<II", self.at(int(self.begins[-1]), 8))
        if skip != SKIP_INDEX:
            raise ValueError("no document index behind the frames")
        table = pa.ipc.open_stream(self.at(int(self.begins[-1]) + 8, length)).read_all()
        self.ids = table["id"]
        self.n_tokens = table["n_tokens"].to_numpy().astype(np.int64)
        self.frame = table["frame"].to_numpy().astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_tokens)])

    def at(self, begin: int, n: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(n)

    def frame_bytes(self, k: int) -> bytes:
        import xxhash
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(self.at(int(self.begins[k]), int(self.packed[k])), max_output_size=max(1, int(self.sizes[k])))
        if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """(place in the index, ids as bytes); each frame is read at most once."""
        now, raw, base = -1, b"", 0
        for k in wanted:
            if self.frame[k] != now:
                now = int(self.frame[k])
                raw, base = self.frame_bytes(now), int(self.starts[np.searchsorted(self.frame, now)])
            begin = (int(self.starts[k]) - base) * 4
            yield k, raw[begin : begin + int(self.n_tokens[k]) * 4]


def write_tokens(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 1, shards: int | None = None) -> DataFrame:
    """Writes df's texts as shard files below folder (a URI that all executors reach) and returns their
    manifest: shard, path, n_docs, n_tokens, n_frames, start (ids in the shards before)."""
    path = tokenizer or default_tokenizer()
    tail = b"" if end_id is None else struct.pack("<I", end_id)
    spark = df.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By id alone: the sample that finds the ranges is gathered by the driver, and texts would weigh in it.
    ordered = keyed(df, id_col, text_col).repartitionByRange(n, F.col(id_col).asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder = writer = None
        name = f"shard-{context.partitionId():07d}.u32.zst"
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                if writer is None:
                    encoder = worker_encoder(path)
                    store.create_dir(root, recursive=True)
                    draft = f"{root}/_draft-{context.taskAttemptId()}-{name}"
                    out = store.open_output_stream(draft, compression=None)
                    writer = ShardWriter(out, part.column(0).type)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(pa.array(strings(part.column(1)), pa.large_string()))):
                    writer.add(doc, ids + tail)
        if writer is not None:
            writer.close()
            out.close()
            store.move(draft, f"{root}/{name}")
            row = [context.partitionId(), f"{folder}/{name}", len(writer.index[0]), sum(writer.index[1]), len(writer.seek)]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "path", "n_docs", "n_tokens", "n_frames"), row))], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_frames", pa.int64())]))

    written = saved(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long, n_frames long"), "manifest")
    totals, starts = sorted(map(tuple, written.select("shard", "n_tokens").collect())), {}
    before = 0
    for shard, n_tokens in totals:
        starts[shard] = before
        before += n_tokens
    begun = spark.createDataFrame([(k, v) for k, v in starts.items()], "shard int, start long")
    return written.join(F.broadcast(begun), "shard")


def read_tokens(manifest: DataFrame, id_kind: str = "long", only: DataFrame | None = None) -> DataFrame:
    """One row per document of the shards: doc_id, start, tokens (binary, little-endian unsigned 32-bit ids).
    only: a frame with doc_id; then frames without any of these are not decompressed. It is sent to
    the readers, so it has to be a short list."""
    wanted = None if only is None else {r[0] for r in only.select("doc_id").distinct().collect()}
    spans = manifest.select("path", "start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_frames") - 1, F.lit(0)), F.lit(FRAMES_A_READER))).alias("first"))

    def run(batches):
        from pyarrow import fs

        names = ["doc_id", "start", "tokens"]
        for batch in batches:
            for row in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(at) as file:
                    shard = ShardReader(file, file.size())
                    mine = np.flatnonzero((shard.frame >= row["first"]) & (shard.frame < row["first"] + FRAMES_A_READER))
                    if wanted is not None:
                        mine = mine[[shard.ids[int(k)].as_py() in wanted for k in mine]]
                    ids = dict(zip(mine.tolist(), shard.ids.take(pa.array(mine)).to_pylist()))
                    held, size = [], 0
                    for k, raw in shard.documents(mine.tolist()):
                        held.append((ids[k], row["start"] + int(shard.starts[k]), raw))
                        size += len(raw)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (shard.ids.type, pa.int64(), pa.binary()))], names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (shard.ids.type, pa.int64(), pa.binary()))], names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(n).mapInArrow(run, f"doc_id {id_kind}, start long, tokens binary")


def round_trip(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    manifest = write_tokens(df, shared_folder(spark, "tokens"), id_col, **options)
    return read_tokens(manifest, id_type(df, id_col))


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))
