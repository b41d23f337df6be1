import random
import zlib

import numpy as np
import pytest

from meshwork.llm import sentencepiece_bpe, token_files
from tests.llm.cases import frame, texts


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())


def odd_texts(n=3000):
    rng = random.Random(5)
    parts = ["a", "b", "e", "h", "t", "s", " ", "  ", "er", "in", "\n", "é", "the", "ß", "0", "▁", "ing", "\x00", "日", "\U0001f600", "ab" * 30, "the" * 9]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_ids_and_text_equal_the_librarys(library):
    some = odd_texts()
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.default_model())
    flat, counts = encoder.encode(some)
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == library.encode(some)
    assert encoder.model.decode_flat(flat, counts) == [library.decode(x) for x in got]


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(6)
    model = sentencepiece_bpe.loaded(sentencepiece_bpe.default_model())
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 8))]
        if 0 not in ids and not any(i in (1, 2) for i in ids):
            assert model.decode_flat(np.array(ids, np.int32), np.array([len(ids)])) == [library.decode(ids)], ids


def test_encode_and_decode_frames(spark, library):
    rows = texts()
    df = frame(spark, rows)
    encoded = sentencepiece_bpe.encode(df, decoded=True)
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in encoded.collect())
    assert got == sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows)
    again = sentencepiece_bpe.decode(encoded)
    assert sorted((str(r.doc_id), r.decoded) for r in again.collect()) == [(i, d) for i, _, d in got]
    assert sentencepiece_bpe.digest(sentencepiece_bpe.encode(df.where("false"), decoded=True)).count() == 0


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_tokenizer())


def test_chunks_encode_as_whole_texts(words):
    rng = random.Random(3)
    parts = ["a", "Word", "it", "'s", "don't", "É", "ß", "é", "é", "İ", "ΑΣ", "..", ",", "!!", "1", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "-", "日本", "\U0001f600", "ﬁ", "_", "µ", "\xad"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    encoder = token_files.ChunkEncoder(token_files.default_tokenizer())
    assert encoder.parts
    for text, ids in zip(some, encoder.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == words.encode(text, add_special_tokens=False).ids, text


def test_files_hold_all_documents_in_order(spark, words):
    rows = texts()
    got = sorted(token_files.digest(token_files.round_trip(spark, frame(spark, rows))).collect(), key=lambda r: r.start)
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = words.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_only_asked_documents(spark):
    manifest = token_files.write_tokens(frame(spark, texts()), token_files.shared_folder(spark, "t"))
    asked = spark.createDataFrame([(3,), (70,), (999,)], "doc_id long")
    assert {r.doc_id for r in token_files.read_tokens(manifest, "long", asked).collect()} == {3, 70}
    assert token_files.digest(token_files.round_trip(spark, frame(spark, texts()).where("false"))).count() == 0


def test_frames_are_plain_zstandard_and_damage_shows(tmp_path):
    import io

    import pyarrow as pa
    import zstandard

    out = io.BytesIO()
    writer = token_files.ShardWriter(out, pa.int64())
    docs = [np.arange(k, k + n, dtype="<u4").tobytes() for k, n in enumerate((3, 0, 300_000, 5, 400_000))]
    for k, d in enumerate(docs):
        writer.add(k, d)
    writer.close()
    raw = out.getvalue()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(docs)
    reader = token_files.ShardReader(io.BytesIO(raw), len(raw))
    assert len(reader.sizes) > 1
    assert dict(reader.documents(range(5))) == dict(enumerate(docs))
    assert dict(reader.documents([3])) == {3: docs[3]}
    broken = bytearray(raw)
    broken[10] ^= 255
    with pytest.raises(Exception):
        dict(token_files.ShardReader(io.BytesIO(bytes(broken)), len(raw)).documents(range(5)))
