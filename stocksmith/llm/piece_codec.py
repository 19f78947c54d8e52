"""SentencePiece encoding and decoding on the tokenizers library (operator 8).

The model file's protobuf is parsed here, and normaliser, blank marker, scores
(unigram) or merge order (BPE) and byte fallback are rebuilt as a tokenizers
pipeline.  (Where several unigram splits have the same score, the two libraries
may choose different ones; ``parity`` tells.)  Where no piece goes across the start of a word, a text is cut into
words with their blanks, each distinct word is encoded once in a
multithreaded batch, and its ids are held against the sentencepiece library.
"""

from __future__ import annotations

import re
import string
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import distinct, ragged_take, ship, text_slices

MARK = "▁"
LETTERS = frozenset(chr(c) for c in range(0x100) if chr(c).isalpha() and chr(c) not in "ªµº")
PUNCTUATION = frozenset(string.punctuation)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: A worker forgets its known words beyond this many.
KNOWN_LIMIT = 400_000
#: Bytes of text or ids handled at a time.
SLICE = 2 << 20


def fields(raw: bytes):
    """(number, value) of each field of a protobuf message: integers, and bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at:at + size]
            at += size


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, raw: bytes):
        # Fixed field numbers and defaults of the public format.
        self.pieces: list[tuple[str, float, int]] = []
        trainer, norm = {3: UNIGRAM, 35: 0, 40: 0}, {2: b"", 3: 1, 4: 1, 5: 1}
        for number, value in fields(raw):
            if number == 1:
                piece = {2: struct.pack("<f", 0.0), 3: NORMAL} | dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                norm |= dict(fields(value))
        self.kind, self.byte_fallback, self.unknown = trainer[3], bool(trainer[35]), trainer[40]
        self.charsmap, self.dummy_prefix, self.trim = norm[2], bool(norm[3]), bool(norm[4])
        if self.kind not in (UNIGRAM, BPE) or not norm[5] or any(kind == USER for *_, kind in self.pieces):
            raise ValueError("unigram or BPE models with escaped blanks and without user-defined pieces are supported")
        usable = [p for p, _, kind in self.pieces if kind == NORMAL]
        pairs = {p[k:k + 2] for p in usable for k in range(len(p) - 1)}
        #: No piece goes on with a blank after another character: words can be encoded one by one.
        self.by_word = not any(y == MARK != x for x, y in pairs)
        #: Nor over a line's end, nor from a letter to punctuation: they can be cut there, too.
        self.by_part = self.by_word and not any("\n" in xy or xy[0] in LETTERS and xy[1] in PUNCTUATION for xy in pairs)

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put a piece together from two others, best score first."""
        of = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for p, i in of.items():
            found += [(-self.pieces[i][1], i, of[p[:k]], of[p[k:]]) for k in range(1, len(p)) if p[:k] in of and p[k:] in of]
        return [(self.pieces[a][0], self.pieces[b][0]) for *_, a, b in sorted(found)]

    def normalizer(self, prefix: bool):
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        steps += [normalizers.Prepend(MARK)] * (prefix and self.dummy_prefix) + [normalizers.Replace(" ", MARK)]
        return normalizers.Sequence(steps)

    def tokenizer(self, prefix: bool = True) -> Tokenizer:
        """The tokenizers pipeline; ``prefix``: with the model's own blank before a text."""
        if self.kind == BPE:
            vocab = {p: i for i, (p, *_) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        out = Tokenizer(model)
        out.normalizer = self.normalizer(prefix)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * (prefix and self.dummy_prefix))
        return out


class Codec:
    """Encoder, decoder and the sentencepiece library's own view of one model."""

    _WORD = re.compile("[ ▁]*[^ ▁]+|[ ▁]+\\Z")
    _PART = re.compile("\n|[ ▁]*[^ ▁\nA-Za-zÀ-ÖØ-öø-ÿ]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ ▁\n!-/:-@\\[-`{-~]|\\Z)|[ ▁]*[^ ▁\n]+|[ ▁]+")

    def __init__(self, raw: bytes):
        self.model = Model(raw)
        self.by_word = self.model.by_word and not self.model.trim and not self.model.charsmap
        self.tokenizer = self.model.tokenizer()
        self.words = self.model.tokenizer(prefix=not self.by_word)
        self.inner = self.words if self.by_word else self.tokenizer  # decodes a word with its blank, or a text
        # an added normaliser message overrides the blank before a text: field 3 { 3: 0 }
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw + (b"\x1a\x02\x18\x00" if self.by_word else b""))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.lens, self.same = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        self.back: list[str] = []

    def _learn(self, units: list[str]) -> None:
        own = [e.ids for e in self.words.encode_batch_fast(units, add_special_tokens=False)]
        theirs = self.library.encode(units, num_threads=1)
        self.place.update(zip(units, range(len(self.place), len(self.place) + len(units)), strict=True))
        self.lens = np.r_[self.lens, np.fromiter(map(len, own), np.int64, len(own))]
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(own), np.uint32)]
        self.same = np.r_[self.same, np.fromiter(map(list.__eq__, own, theirs), bool, len(own))]
        self.back += self.inner.decode_batch(own, skip_special_tokens=False)

    def _units(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        units: list[str] = []
        ends = np.zeros(len(texts), dtype=np.int64)
        cut = (self._PART if self.model.by_part else self._WORD).findall
        for i, text in enumerate(texts):
            if text:
                units += cut(" " + text if self.model.dummy_prefix else text) if self.by_word else [text]
            ends[i] = len(units)
        return units, ends

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """All ids, where each text's ids end, if each text's words agree with the library, and the texts that the ids decode to."""
        units, ends = self._units(texts)
        if not units:
            return np.zeros(0, np.uint32), ends * 0, np.ones(len(texts), bool), [""] * len(texts)
        codes, unique = distinct(units, any("\0" in t for t in texts if t))
        if len(self.place) > KNOWN_LIMIT:
            self._forget()
        if new := [u for u in unique if u not in self.place]:
            self._learn(new)
        places = [self.place[u] for u in unique]
        at = np.array(places)[codes]
        ids = ragged_take(self.ids, np.cumsum(self.lens) - self.lens, self.lens, at)
        odd = np.r_[0, np.cumsum(~self.same[at])]
        begins = np.r_[0, ends[:-1]]
        words = [self.back[k] for k in places]
        cut = int(self.by_word and self.model.dummy_prefix)
        back = ["".join([words[c] for c in codes[a:b].tolist()])[cut:] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return ids, np.r_[0, np.cumsum(self.lens[at])][ends], odd[ends] == odd[begins], back

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


_LOADED: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Codec(f.read())
    return _LOADED[path]


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [more])


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit), ``parity`` and ``decoded`` added.

    The ids are those of ``text`` under the SentencePiece file ``model`` (a path on
    every worker); parity says if the sentencepiece library gives the same for
    each of its words (for a model whose pieces span words: for the text);
    decoded is the text that the ids stand for.  Null or empty text: no ids, parity
    true, decoded empty.  All other columns and rows stay; columns of these three names
    must not be there yet.  An empty table gives an empty result."""
    ship(docs.sparkSession)
    docs = docs.withColumn(text, F.col(text).cast("string"))
    place = docs.columns.index(text)

    def run(batches):
        table = codec(model)
        for part in text_slices(batches, place, SLICE):
            ids, ends, same, back = table.encode(part.column(place).to_pylist())
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends * 4].astype(np.int64).tobytes()), raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same), pa.array(back, pa.string())], names=[*part.schema.names, "ids", "parity", "decoded"])

    return docs.mapInArrow(run, _schema(docs, "ids binary, parity boolean, decoded string"))


def decode(coded: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``coded`` with the text of ``ids`` (as :func:`encode` gives them) added as column ``to``; null for null, empty for none."""
    ship(coded.sparkSession)
    place = coded.columns.index(ids)

    def run(batches):
        table = codec(model)
        for part in text_slices(batches, place, SLICE):
            lists = part.column(place).to_pylist()
            texts = iter(table.decode([np.frombuffer(x, "<u4") for x in lists if x is not None]))
            out = pa.array([None if x is None else next(texts) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, to])

    return coded.mapInArrow(run, _schema(coded, f"`{to}` string"))
