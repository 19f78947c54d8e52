"""Alignment of two tokenizers by interval coalescing (operator 12).

The tokens of both tokenizers are byte intervals of the same text.  A task lays
the intervals of a slice of documents end to end, sorts all of them by start,
and takes the running maximum of their ends: where a start reaches it, every
earlier token has ended and a group begins.  Inside a group the overlapping
pairs are expanded, for each token the run of the other tokenizer's tokens
between the first that ends after its start and the last that starts before its
end.  A slice keeps each linked id pair once, with the number of documents that
hold it; Spark adds these up and sends each slice the totals of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import distinct, ragged_take, release, ship, text_rows, text_slices, written
from .piece_codec import BYTE, Codec, Model
from .rank_merge import SELF_BYTES, pre_tokens

#: Text of a slice; a task holds about 60 times as much.
SLICE = 2 << 20
#: A worker forgets its known units beyond this many.
KNOWN_LIMIT = 250_000


class Units:
    """Ids of a tokenizer's units (parts that it encodes one by one), each distinct unit encoded once."""

    def __init__(self, encode, tokens: list[bytes], before: str = ""):
        self.encode_units, self.bytes, self.before = encode, tokens, before
        self.token_bytes = np.array(list(map(len, tokens)))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.lens, self.exact = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, units: list[str]) -> None:
        ids = self.encode_units(units)
        self.place.update(zip(units, range(len(self.place), len(self.place) + len(units)), strict=True))
        lens, flat = np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int32)
        self.exact = np.r_[self.exact, self._reproduced(units, flat, lens)]
        self.lens, self.ids = np.r_[self.lens, lens], np.r_[self.ids, flat]

    def _reproduced(self, units: list[str], flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Are each unit's tokens' bytes its own? All together first, one by one if they are not."""
        raw = [(self.before + u).encode() for u in units]
        ends = np.cumsum(lens)
        size = np.diff(np.r_[0, np.cumsum(self.token_bytes[flat])][np.r_[0, ends]])
        same = size == np.fromiter(map(len, raw), np.int64, len(raw))
        tokens = list(map(self.bytes.__getitem__, flat.tolist()))
        if same.all() and b"".join(tokens) == b"".join(raw):
            return same
        return same & np.array([b"".join(tokens[e - n:e]) == u for e, n, u in zip(ends.tolist(), lens.tolist(), raw, strict=True)], dtype=bool)

    def encode(self, units: list[str], nul: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in one array, how many each unit has, and whether its tokens' bytes are those of the unit."""
        if len(self.place) > KNOWN_LIMIT:
            self._forget()
        codes, unique = distinct(units, nul)
        if new := [u for u in unique if u not in self.place]:
            self._learn(new)
        at = np.fromiter((self.place[u] for u in unique), np.int64, len(unique))[codes]
        return ragged_take(self.ids, np.cumsum(self.lens) - self.lens, self.lens, at), self.lens[at], self.exact[at]


class ByteLevel(Units):
    """A byte-level BPE file of the tokenizers library; special strings in a text are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        char = {chr(b): b for b in SELF_BYTES}
        char |= {chr(256 + k): b for k, b in enumerate(x for x in range(256) if chr(x) not in char)}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of = {i: bytes(char[c] for c in t) if all(c in char for c in t) else t.encode() for t, i in vocab.items()}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        super().__init__(lambda units: [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)],
                         [of.get(i, b"") for i in range(max(of) + 1)])

    def units(self, text: str) -> list[str]:
        return pre_tokens(" " + text)


class Pieces(Units):
    """A SentencePiece model file; the model puts a blank before a text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        model = Model(raw)
        if not model.dummy_prefix:
            raise ValueError("the model must put a blank before a text")
        self.by_unit = model.by_word and not model.trim and not model.charsmap
        self.cut = (Codec._PART if model.by_part else Codec._WORD).findall
        # an added normaliser message overrides the blank before a text: field 3 { 3: 0 }
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw + (b"\x1a\x02\x18\x00" if self.by_unit else b""))
        super().__init__(lambda units: self.library.encode(units, num_threads=1),
                         [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace("▁", " ").encode() for p, _, kind in model.pieces],
                         "" if self.by_unit else " ")

    def units(self, text: str) -> list[str]:
        return self.cut(" " + text) if self.by_unit else [text]


class Coded:
    """Tokens of some texts: ids, and where each token ends in the bytes of all texts together."""

    def __init__(self, units: Units, texts: list[str]):
        parts: list[str] = []
        bounds = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            parts += units.units(t)
            bounds[i + 1] = len(parts)
        self.ids, lens, exact = units.encode(parts, any("\0" in t for t in texts))
        self.bounds = np.r_[0, np.cumsum(lens)][bounds]  # of each text's tokens
        odd = np.r_[0, np.cumsum(~exact)]
        self.exact = odd[bounds[1:]] == odd[bounds[:-1]]
        self.token_bytes = units.token_bytes

    def keep(self, texts: np.ndarray) -> Coded:
        """The tokens of the texts that are kept."""
        lens = np.diff(self.bounds)
        self.ids = self.ids[np.repeat(texts, lens)]
        self.bounds = np.r_[0, np.cumsum(lens[texts])]
        self.ends = np.cumsum(self.token_bytes[self.ids])
        return self


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval of a list sorted by start: a new one begins where a start reaches all earlier ends."""
    if not len(starts):
        return np.zeros(0, np.int64)
    reach = np.maximum.accumulate(ends)
    return np.cumsum(np.r_[False, starts[1:] >= reach[:-1]])


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each A token's and each B token's group, of tokens that end at these bytes and begin where the one before ends."""
    side = np.r_[np.zeros(len(a_ends), np.int8), np.ones(len(b_ends), np.int8)]
    ends = np.r_[a_ends, b_ends]
    starts = np.r_[np.r_[0, a_ends[:-1]][:len(a_ends)], np.r_[0, b_ends[:-1]][:len(b_ends)]]
    order = np.lexsort((side, starts))
    group = np.empty(len(ends), np.int64)
    group[order] = coalesce(starts[order], ends[order])
    return group[:len(a_ends)], group[len(a_ends):]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place of an A token, place of a B token) whose bytes overlap."""
    a_starts, b_starts = np.r_[0, a_ends[:-1]][:len(a_ends)], np.r_[0, b_ends[:-1]][:len(b_ends)]
    first = np.searchsorted(b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, a_ends, side="left") - first
    a = np.repeat(np.arange(len(a_ends)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def group_texts(a: Coded, b: Coded, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    last = lambda g: np.r_[g[1:] != g[:-1], True][:len(g)]
    names = np.array([str(i) for i in range(max(len(a.token_bytes), len(b.token_bytes)))], dtype=object)
    commas, bars, semis = names + ",", names + "|", names + ";"
    a_words = np.where(last(a_group), bars[a.ids], commas[a.ids])
    b_words = np.where(last(b_group), semis[b.ids], commas[b.ids])
    order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
    words = np.r_[a_words, b_words][order].tolist()
    bounds = (a.bounds + b.bounds).tolist()
    return ["".join(words[i:j])[:-1] for i, j in zip(bounds, bounds[1:])]


_LOADED: dict[tuple, tuple[ByteLevel, Pieces]] = {}


def coders(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    if (a, b) not in _LOADED:
        _LOADED[a, b] = ByteLevel(a), Pieces(b)
    return _LOADED[a, b]


# Per text: its counts, and the places of its pairs in its slice's list with how often each is linked.
# The list itself stands in the slice's first row.
SLICED = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, at binary, times binary, pair_a binary, pair_b binary, pair_docs binary"


def _packed(x: np.ndarray, dtype: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).astype(dtype).tobytes(), 1)


def _unpacked(raw: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), dtype)


def align_slice(texts: list[str | None], left: ByteLevel, right: Pieces) -> dict[str, list]:
    """The columns of ``SLICED`` but for the first two."""
    n = len(texts)
    some = np.array([bool(t) for t in texts])
    given = [t for t in texts if t]
    a, b = Coded(left, given), Coded(right, given)
    exact = a.exact & b.exact
    some[some] = exact
    a, b = a.keep(exact), b.keep(exact)
    a_group, b_group = groups_of(a.ends, b.ends)
    names = group_texts(a, b, a_group, b_group)
    i, j = overlaps(a.ends, b.ends)
    m = len(names)
    link_bounds = np.searchsorted(i, a.bounds)
    doc = np.repeat(np.arange(m), np.diff(link_bounds))
    key = a.ids[i].astype(np.int64) << 32 | b.ids[j]
    pairs, place = np.unique(key, return_inverse=True)
    # each document's pairs once
    in_doc, times = np.unique(doc << 32 | place, return_counts=True)
    doc_bounds = np.searchsorted(in_doc >> 32, np.arange(m + 1))
    place = in_doc & 0xFFFFFFFF
    docs = np.bincount(place, minlength=len(pairs))
    out: dict[str, list] = {c: [0] * n for c in ("n_a", "n_b", "n_groups", "n_links")}
    out |= {"groups": [""] * n, "at": [None] * n, "times": [None] * n, "pair_a": [None] * n, "pair_b": [None] * n, "pair_docs": [None] * n}
    n_groups = np.array([a_group[y - 1] - a_group[x] + 1 for x, y in zip(a.bounds, a.bounds[1:])], dtype=np.int64)
    for k, row in enumerate(np.flatnonzero(some).tolist()):
        x, y = int(doc_bounds[k]), int(doc_bounds[k + 1])
        out["n_a"][row], out["n_b"][row] = int(a.bounds[k + 1] - a.bounds[k]), int(b.bounds[k + 1] - b.bounds[k])
        out["n_groups"][row], out["n_links"][row] = int(n_groups[k]), int(link_bounds[k + 1] - link_bounds[k])
        out["groups"][row] = names[k]
        out["at"][row] = _packed(np.diff(place[x:y], prepend=0), "<u4")
        out["times"][row] = _packed(times[x:y], "<u4")
    if n:
        out["pair_a"][0], out["pair_b"][0], out["pair_docs"][0] = _packed(pairs >> 32, "<i4"), _packed(pairs & 0xFFFFFFFF, "<i4"), _packed(docs, "<u4")
    return out


def _pair_rows(batches):
    for b in batches:
        for chunk, a, c, docs in zip(*(x.to_pylist() for x in b.columns), strict=True):
            a = _unpacked(a, "<i4")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), chunk)), pa.array(np.arange(len(a)), pa.int32()), pa.array(a), pa.array(_unpacked(c, "<i4")), pa.array(_unpacked(docs, "<u4").astype(np.int64))],
                                             names=["chunk", "place", "a", "b", "docs"])
    release()


def _count(rows: pa.Table, totals: pa.Table) -> pa.Table:
    """A slice's documents with the totals of their links."""
    place = totals.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    count[place] = totals.column("count").to_numpy()
    best[place] = totals.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for at, times in zip(rows.column("at").to_pylist(), rows.column("times").to_pylist(), strict=True):
        if at is None:
            n_best.append(0)
            count_sum.append(0)
            continue
        at, times = np.cumsum(_unpacked(at, "<u4")), _unpacked(times, "<u4").astype(np.int64)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    release()
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table({c: rows.column(c) for c in keep} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups": rows.column("groups")})


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def slices(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE, digest: bool = False) -> DataFrame:
    """Each document's alignment beside its slice's id pairs (columns ``SLICED``), as a written table.
    ``digest``: groups as lowercase hex of their SHA-256, empty without tokens."""
    def run(batches):
        left, right = coders(a, b)
        chunk = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, 1, slice_bytes):
            out = align_slice(part.column(1).to_pylist(), left, right)
            if digest:
                out["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out["groups"]]
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * part.num_rows, pa.int64()), part.column(0), *(pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True))], names=["chunk", "doc_id", *out])
            chunk += 1

    return written(docs.sparkSession, text_rows(docs, doc_id, text).mapInArrow(run, SLICED), "token-alignment")


def pair_totals(sliced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, place, a, b, docs) of every slice's pairs, and (a, b, count, best) of each pair in the corpus:
    how many documents hold it linked, and whether no other pair of its A id has more."""
    pairs = sliced.where(F.col("pair_a").isNotNull()).select("chunk", "pair_a", "pair_b", "pair_docs").mapInArrow(_pair_rows, "chunk bigint, place int, a int, b int, docs bigint")
    count = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # one row per id of the A vocabulary: a file's size bounds it
    most = count.groupBy("a").agg(F.max("count").alias("most"))
    return pairs, count.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    A are the tokens of a blank and the text under the byte-level BPE file ``a``, B
    those of the text under the SentencePiece file ``b``, whose model puts the blank
    there (paths on every worker; no special tokens, their strings are plain text).
    Groups lie between the bytes where tokens of both end; links are all pairs of
    tokens that share a byte.  A pair of ids counts the rows that hold it linked;
    n_best are the links whose pair counts most among the pairs of its A id (ties
    included), count_sum adds up the counts of all links.  groups is
    ``a1,a2|b1;a3|b2``: each group's A ids and B ids in order (or its digest).

    A null or empty text, and one whose tokens' bytes are not those of a blank
    and the text (a text with U+2581), has no tokens: zeros and empty groups.  Null ids and
    repeated rows are documents like others; an empty table gives an empty result; further
    columns are ignored.  Slices are cut by position, so a hot id or text does not gather; a
    slice holds one whole text at least."""
    ship(docs.sparkSession)
    sliced = slices(docs, a, b, doc_id, text, slice_bytes, digest)
    pairs, totals = pair_totals(sliced)
    replies = pairs.select("chunk", "place", "a", "b").join(totals, ["a", "b"]).select("chunk", "place", "count", "best")
    rows = sliced.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "times")
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_count, ALIGNED)
