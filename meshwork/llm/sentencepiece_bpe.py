"""SentencePiece BPE by vectorised merge rounds.

The distinct words of a slice of documents lie end to end in one flat numpy array of symbols.
In a round, every word finds the best rank among its neighbouring pairs (a segmented minimum),
merges all leftmost non-overlapping occurrences of that rank at once, and the array is
compacted; words without a pair leave. No piece of the vocabulary has a space sign behind
another character, so a word (space signs and what follows them) never merges with the next
one and the ids of a text are those of its words in order.

Merging all occurrences of a rank at once equals merging them one by one, unless a pair born
in between has a better rank; a word in which that could happen merges only its leftmost
occurrence in that round.

Null and empty texts have no ids, as in the library, and decode to ''. Rows are independent:
repeated rows give repeated results, an empty table gives an empty one, columns other than the
two named are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, keyed, map_slices, strings

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Distinct words whose ids a task keeps.
CACHED_WORDS = 500_000


class PairTable:
    """(left symbol, right symbol) -> piece, by open addressing in two flat arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int], symbols: int):
        self.symbols, self.bits = symbols, max(4, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for (a, b), v in pairs.items():
            key = a * symbols + b
            at, n = int(self.slot(np.array([key]))[0]), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.keys[at], self.values[at], self.probes = key, v, max(self.probes, n)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 where there is none. Symbols below 0 are in no pair."""
        out = np.full(len(a), -1, np.int32)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[live].astype(np.int64) * self.symbols + b[live]
        at = self.slot(key)
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == key
            out[live[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            live, key, at = live[more], key[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.unknown = lib.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i in range(n):
            if lib.is_byte(i):
                self.byte_ids[int(pieces[i][1:-1], 16)] = i
        self.falls_back = any(lib.is_byte(i) for i in range(n))
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(lib.is_unused(i) for i in range(n)) or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a model with unused pieces, or with pieces over word borders, is not handled")
        probe = "A  b  c\nﬁ "
        if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("a model that normalises its input is not handled")
        # Characters inside pieces that are no pieces themselves get symbols behind the vocabulary.
        chars = sorted({c for p in normal for c in p} - normal.keys())
        symbol = normal | {c: n + k for k, c in enumerate(chars)}
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        scores = {i: -lib.get_score(i) for i in normal.values()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values())))}
        self.rank = np.full(n + 1, NONE, np.int32)  # the last: of no piece
        for i, s in scores.items():
            self.rank[i] = order[s]
        self.pairs = PairTable({(symbol[p[:k]], symbol[p[k:]]): i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}, n + len(chars))
        self.size = n
        shown = [b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else bytes([int(p[1:-1], 16)]) if lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_len = np.array([len(x) for x in shown])
        self.shown_at = np.concatenate([[0], np.cumsum(self.shown_len)[:-1]])
        self.leads = np.array([p.startswith(SPACE) and not s for p, s in zip(pieces, special)])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and the number of each."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(w) for w in words], np.int64)
        sym, char = self.of_char[code], np.arange(len(code))
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            joins = word[1:] == word[:-1]
            made = np.full(len(sym), -1, np.int32)
            made[:-1] = np.where(joins, self.pairs.find(np.where(joins, sym[:-1], -1), sym[1:]), -1)
            rank = self.rank[made]
            first = np.flatnonzero(np.concatenate([[True], ~joins]))
            best = np.minimum.reduceat(rank, first)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sym))))
            ends = best[of] == NONE
            if ends.any():
                done.append((word[ends], char[ends], sym[ends]))
                keep = ~ends
                sym, char, word, made, rank, of = sym[keep], char[keep], word[keep], made[keep], rank[keep], of[keep]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best[of])
            # Of neighbouring occurrences every second one, from the leftmost.
            run = np.concatenate([[True], np.diff(at) > 1])
            start = at[np.flatnonzero(run)][np.cumsum(run) - 1]
            at = at[(at - start) % 2 == 0]
            at = at[self.certain(sym, word, rank, made, at)]
            sym = sym.copy()
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, char, word = sym[keep], char[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, char, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(char, kind="stable")
        return self.to_ids(word[order], code[char[order]], sym[order], len(words))

    def certain(self, sym, word, rank, made, at) -> np.ndarray:
        """Which merges may be made at once: all of a word, or its leftmost if a pair born in between could be better."""
        ok = np.ones(len(at), bool)
        first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        several = np.zeros(len(at), bool)
        several[:-1] |= ~first[1:]
        several |= ~first
        k = np.flatnonzero(several)
        if not len(k):
            return ok
        i, piece = at[k], made[at[k]]
        near = np.concatenate([sym, [-1, -1]])
        places = np.concatenate([word, [-1, -1]])
        right = np.where(places[i + 2] == word[i], near[i + 2], -1)
        prev = np.where(k > 0, at[k - 1], -9)
        left = np.where(prev == i - 2, made[prev], near[i - 1])
        left = np.where((i > 0) & (places[i - 1] == word[i]), left, -1)
        worse = np.minimum(self.rank[self.pairs.find(piece, right)], self.rank[self.pairs.find(left, piece)]) < rank[i]
        if worse.any():
            alone = np.unique(word[i[worse]])
            ok &= first | ~np.isin(word[at], alone)
        return ok

    def to_ids(self, word, code, sym, n_words) -> tuple[np.ndarray, np.ndarray]:
        odd = (sym < 0) | (sym >= self.size)
        width = np.ones(len(sym), np.int64)
        if odd.any() and self.falls_back:
            width[odd] = 1 + (code[odd] > 0x7F) + (code[odd] > 0x7FF) + (code[odd] > 0xFFFF)
        out = np.repeat(np.where(odd, self.unknown, sym).astype(np.int32), width)
        if odd.any() and self.falls_back:
            raw = np.frombuffer(code[odd].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(odd, width)] = self.byte_ids[raw]
        return out, np.bincount(word, width, n_words).astype(np.int64)

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        if not len(ids):
            return [""] * len(counts)
        if ids.min() < 0 or ids.max() >= self.size:
            raise ValueError("an id outside the vocabulary")
        width = self.shown_len[ids]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        begin = np.concatenate([[0], np.cumsum(width)])
        raw = self.shown[np.arange(begin[-1]) + np.repeat(self.shown_at[ids] - begin[:-1], width)].tobytes()
        out = []
        for f, n in zip(first.tolist(), counts.tolist()):
            b, e = int(begin[f]), int(begin[f + n])
            b += bool(n and self.leads[ids[f]])
            out.append(shown_text(raw[b:e]))
        return out


def shown_text(raw: bytes) -> str:
    """UTF-8 to text; each byte that belongs to no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "surrogateescape").translate({0xDC00 + k: "�" for k in range(128, 256)})


class Words(dict):
    """word -> place; a word not seen before gets the next place and is noted."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at


def words_of(text: str) -> list[str]:
    """The words of a text, the first with the space sign that the library puts before a text. A
    word with a single space sign is named without it."""
    if not text:
        return []
    text = text.replace(" ", SPACE)
    if SPACE * 2 not in text and text[0] != SPACE and text[-1] != SPACE:
        return text.split(SPACE)
    out, signs = [], ""
    for part in (SPACE + text).split(SPACE)[1:]:
        signs += SPACE
        if part:
            out.append(part if signs == SPACE else signs + part)
            signs = ""
    return [*out, signs + SPACE] if signs else out  # signs alone: named with one more


class Encoder:
    """Encodes lists of texts; keeps the ids of words between calls."""

    def __init__(self, path: str):
        self.model = loaded(path)
        self.clear()

    def clear(self) -> None:
        self.places = Words()
        self.flat, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text."""
        if len(self.places) > CACHED_WORDS:
            self.clear()
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        if fresh := self.places.fresh:
            # A name that starts with a space sign has all its signs but one, or, of signs alone, one more.
            full = [(w if w.strip(SPACE) else w[1:]) if w[0] == SPACE else SPACE + w for w in fresh]
            ids, lens = self.model.encode_words(full)
            self.flat, self.lens = np.concatenate([self.flat, ids]), np.concatenate([self.lens, lens])
            self.places.fresh = []
        starts = np.concatenate([[0], np.cumsum(self.lens)])
        width = self.lens[at]
        ends = np.cumsum(width)
        flat = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[at] - (ends - width), width)]
        of = np.repeat(np.arange(len(texts)), n)
        return flat, np.bincount(of, width, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, so that words stay known."""
    return Encoder(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.int32()))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, decoded: bool = False) -> DataFrame:
    """One row per row of df: the id, ids array<int>, and on demand the text decoded from these ids.
    model: the path of the model file, the same on every executor."""
    path = model or default_model()

    def make():
        encoder = worker_encoder(path)

        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            flat, counts = encoder.encode(strings(part.column(1)))
            more = [pa.array(encoder.model.decode_flat(flat, counts), pa.string())] if decoded else []
            return pa.RecordBatch.from_arrays([part.column(0), lists(flat, counts), *more], names)

        return handle

    names = [id_col, "ids", *["decoded"] * decoded]
    return map_slices(keyed(df, id_col, text_col), make, f"`{id_col}` {id_type(df, id_col)}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """One row per row of df: the id and the text of its ids; null counts as no ids."""
    path = model or default_model()

    def run(batches):
        held = loaded(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                rows = [np.array(x or [], np.int32) for x in part.column(1).to_pylist()]
                texts = held.decode_flat(np.concatenate([*rows, np.zeros(0, np.int32)]), np.array([len(x) for x in rows], np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return df.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` {id_type(df, id_col)}, decoded string")


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
