"""Harmonic packing of token sequences (operator 9).

Lengths fall into reciprocal-capacity classes: class j holds the pieces of up to
``capacity // j`` ids, and each of its bins takes exactly j pieces.  A piece that
would leave much of its slot empty is first cut at ``capacity // (j + 1)``, the
full slot of the next class, and the rest is classed again.  Every task keeps
its own bins and ends them itself, so workers share nothing and nothing is
shuffled.  What is left in open bins when a task ends is put end to end and cut
into full sequences and, for the last ids, into sequences whose length is a
power of two.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import distinct, ragged_take, text_rows, text_slices

#: A slot may stay empty by one part in so many before the piece is cut.
SLACK = 64
#: A worker forgets its known words beyond this many (about 200 bytes each).
KNOWN_LIMIT = 1_000_000

# A text is cut at blanks, and between a run of Latin letters and a run of ASCII punctuation
# (not the apostrophe): places that no normal form or pre-token of the file spans.
_UNITS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \t\r\n!-&(-/:-@\[-`{-~]|\Z)|[!-&(-/:-@\[-`{-~]+(?=[ \t\r\nA-Za-zÀ-ÖØ-öø-ÿ]|\Z)|[^ \t\r\n]+")
# Without apostrophes, a lower-cased Latin-1 text parts wherever letters and other characters meet.
_LATIN = re.compile(r"[a-zªµºß-öø-ÿ]+|[^a-zªµºß-öø-ÿ \t\r\n]+")


def units(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes independently of each other."""
    if "<|" in text:  # special strings are taken before anything else
        return [text]
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _UNITS.findall(text)
    text = text.lower()  # as the file's normaliser does it
    return (_UNITS if "'" in text else _LATIN).findall(text)


class WordIds:
    """Ids of a tokenizers file that drops blanks, each distinct word encoded once."""

    def __init__(self, path: str, limit: int = KNOWN_LIMIT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.encoder, self.limit = Tokenizer.from_file(path), limit
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])  # word k has the ids from ends[k] to ends[k + 1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids end."""
        words: list[str] = []
        ends = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                words += units(text)
            ends[i] = len(words)
        if not words:
            return np.zeros(0, np.uint32), ends * 0
        if len(self.place) > self.limit:
            self._forget()
        place = self.place
        codes, unique = distinct(words, any("\0" in t for t in texts if t))
        new = [w for w in unique if w not in place]
        place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        for e in self.encoder.encode_batch_fast(new, add_special_tokens=False):
            self.ids.extend(e.ids)
            self.ends.append(len(self.ids))
        codes = np.fromiter(map(place.__getitem__, unique), np.int64, len(unique))[codes]
        bounds = np.array(self.ends)
        lens = np.diff(bounds)
        flat = ragged_take(np.array(self.ids, dtype=np.uint32), bounds[:-1], lens, codes)
        return flat, np.r_[0, np.cumsum(lens[codes])][ends]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str, limit: int) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    _LOADED[path].limit = limit
    return _LOADED[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(class, piece length) of a document's pieces; the lengths add up to ``length``."""
    pieces = []
    while length > 0:
        j = max(1, capacity // length)
        slot = capacity // j
        if length > capacity:
            take = capacity
        elif slot - length <= slot // SLACK:
            take = length
        else:
            j += 1
            take = capacity // j
        pieces.append((j, take))
        length -= take
    return pieces


class Bins:
    """The open bins of one task; holds less than one sequence for each class."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at = 0
        for j, take in cuts(len(ids), self.capacity):
            bin_ = self.open.setdefault(j, [])
            bin_.append((doc, at, ids[at:at + take], len(ids)))
            at += take
            if len(bin_) == j:
                self._close(self.open.pop(j))

    def end(self) -> None:
        """What is left, end to end: full sequences, then lengths that are powers of two."""
        rest = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        while left:
            size = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
            left -= size
            bin_ = []
            while size:
                doc, start, ids, total = rest.pop(0)
                bin_.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    rest.insert(0, (doc, start + size, ids[size:], total))
                size -= min(size, len(ids))
            self._close(bin_)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=NAMES)


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", known_words: int = KNOWN_LIMIT) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` ids.

    A document's ids are those of the tokenizers file ``vocabulary`` (a path on
    every worker; a BPE file that drops blanks, given without special tokens)
    and then ``end_id``.  Per piece: doc_id, start (the document's ids before
    it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset in the sequence, gapless from 0.  ``capacity`` should be a power of two.

    Null or empty text: only ``end_id``.  Null ids and repeated rows are packed
    like others, each row as a document of its own.  An empty table gives no
    pieces; further columns are ignored.  A sequence id holds the task's number,
    and a task packs its rows in the order it reads them, so a task that runs
    again after a lost executor makes the same sequences as long as it reads the
    same rows in the same order, as a scan of files does.  ``known_words`` bounds the
    words whose ids a worker remembers; fewer take less memory and more time."""

    def run(batches):
        ids_of = word_ids(vocabulary, known_words)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        for part in text_slices(batches, 1):
            flat, ends = ids_of.encode(part.column(1).to_pylist())
            at = 0
            for doc, end in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                bins.add(doc, np.append(flat[at:end], np.uint32(end_id)).astype("<u4"))
                at = end
            yield bins.take()
        bins.end()
        yield bins.take()

    return text_rows(docs, doc_id, text).mapInArrow(run, SCHEMA)
