"""Operators 8, 9 and 10 against the public libraries."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stocksmith.llm import harmonic_pack, piece_codec, rank_merge

WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = "abc the ing  \n\t's,.;!$#<|endoftext|>éàÉΣß²½ªµ日本🙂\x00\x1c\x85\xa0̧İ ▁_-19"


def texts(n, seed):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "<|endoftext|>", "a" * 5000, "x<|endoftext|>y <|startoftext|>", "  two  blanks "] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i if i % 7 else None, t, "x", 5) for i, t in enumerate(rows)], "doc_id bigint, text string, n_tokens string, start int")


def test_token_counts(spark):
    rows = texts(3000, 1)
    library = Tokenizer.from_file(BYTES)
    got = rank_merge.token_counts(frame(spark, rows), BYTES, limit=12).collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in rows]
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in rows]
    assert [r.over_limit for r in got] == [n > 12 for n in want]
    assert [r.doc_id for r in got] == [i if i % 7 else None for i in range(len(rows))]


def test_token_counts_of_runs():
    """Overlapping equal pairs merge from the left."""
    library, table = Tokenizer.from_file(BYTES), rank_merge.Merges(BYTES)
    for c in ("a", " ", "=", "ab", "\n", "0"):
        for n in range(1, 70):
            assert table.count_texts([c * n])[0] == len(library.encode(c * n, add_special_tokens=False).ids)


def test_word_ids():
    library, table = Tokenizer.from_file(WORDS), harmonic_pack.WordIds(WORDS)
    rows = texts(3000, 2)
    ids, ends = table.encode(rows)
    for t, part in zip(rows, np.split(ids, ends[:-1])):
        assert part.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_pack(spark, capacity):
    rows = texts(600, 3) + ["word " * n for n in (15, 16, 17, 100, 3000)]
    library = Tokenizer.from_file(WORDS)
    got = harmonic_pack.pack(frame(spark, rows), WORDS, capacity=capacity).collect()
    docs, bins = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    nulls = []
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        if i % 7 == 0:
            nulls += ids
            continue
        at, found = 0, []
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            found += np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert found == ids
    assert sum(r.length for r in docs[None]) == len(nulls)
    total = sum(r.length for r in got)
    padding = sum(capacity - n for b in bins.values() if (n := sum(r.length for r in b)) & (n - 1))
    assert padding <= 0.02 * total + capacity


@pytest.mark.parametrize("capacity", [1, 2, 64, 2048])
def test_cuts(capacity):
    for length in range(1, 3 * capacity + 2):
        pieces = harmonic_pack.cuts(length, capacity)
        assert sum(n for _, n in pieces) == length
        assert all(0 < n and j * n <= capacity for j, n in pieces)


def test_same_pieces_again(spark):
    """A task that runs again gives the same pieces."""
    df = frame(spark, texts(200, 4))
    run = lambda: [tuple(r) for r in harmonic_pack.pack(df, WORDS).collect()]
    assert run() == run()


def test_piece_codec(spark):
    rows = texts(3000, 5)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = frame(spark, rows)
    coded = piece_codec.encode(df, PIECES)
    got = piece_codec.decode(coded, PIECES, to="again").collect()
    assert coded.columns == [*df.columns, "ids", "parity", "decoded"]
    for t, r in zip(rows, got, strict=True):
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(t or ""), t
        assert r.parity and r.text == t
        assert r.decoded == r.again == library.decode(library.encode(t or ""))
    assert sum(r.decoded == (t or "") for t, r in zip(rows, got)) == len(rows) - sum("▁" in (t or "") for t in rows)


def message(number, raw):
    size, out = len(raw), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + out + bytes([size]) + raw


def test_unigram():
    """The same pieces with unigram scores: the best split, as the library finds it."""
    import math
    import struct
    raw = open(PIECES, "rb").read()
    out = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", -math.log(i + 2) - 3 - (i * 7919 % 1000) / 1e5) + bytes([0x18, kind])) for i, (p, _, kind) in enumerate(piece_codec.Model(raw).pieces))
    out += b"".join(message(n, v) for n, v in piece_codec.fields(raw) if n in (2, 3)) + b"\x12\x02\x18\x01"
    own, library = piece_codec.Codec(out), sentencepiece.SentencePieceProcessor(model_proto=out)
    assert own.model.kind == piece_codec.UNIGRAM
    rows = ["the thing and others", "日本 🙂  x", "internationalisation of programmes"] + [t for t in texts(200, 6) if t]
    same = sum(own.encode([t])[0].tolist() == library.encode(t) for t in rows)
    assert same >= 0.98 * len(rows)  # splits of equal scores may differ


def test_empty(spark):
    none = frame(spark, []).where("false")
    assert rank_merge.token_counts(none, BYTES).count() == 0
    assert harmonic_pack.pack(none, WORDS).count() == 0
    assert piece_codec.decode(piece_codec.encode(none, PIECES), PIECES, to="t").count() == 0


def test_queries_on_small_tables(spark):
    from stocksmith.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words, byte, piece = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = {r.doc_id: r for r in QUERIES["op10_token_counts"](spark, sf).collect()}
    codes = {r.doc_id: r for r in QUERIES["op8_piece_codec"](spark, sf).collect()}
    packed = {}
    for r in QUERIES["op9_harmonic_packing"](spark, sf).collect():
        packed.setdefault(r.doc_id, []).append(r)
    assert len(counts) == len(codes) == len(packed) == len(docs)
    for d in docs:
        n = len(byte.encode(d.text, add_special_tokens=False).ids)
        assert (counts[d.doc_id].n_tokens, counts[d.doc_id].over_limit) == (n, n > 1024)
        ids = piece.encode(d.text)
        c = codes[d.doc_id]
        assert (c.n_pieces, c.ids_crc32, c.parity, c.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True, True)
        ids = np.array(words.encode(d.text, add_special_tokens=False).ids + [1], "<u4")
        for r in packed[d.doc_id]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        assert sum(r.length for r in packed[d.doc_id]) == len(ids)
