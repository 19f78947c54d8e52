"""Text shards and packed messages between them, for the two exact substring operators.

Documents are dealt by a hash to chunks of a few MB.  A task that works on a
chunk sends other tasks not single values but packets: for each of a number of
buckets the values that fall into it, each once per chunk.  So a value that
every document has costs a bucket one entry per chunk, not one per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_rows

#: Text in a chunk. A task holds about 60 times as much; more memory allows larger chunks and so fewer packets.
CHUNK_BYTES = 3 << 20
#: Stands for a null id: no id is larger.
NO_ID = np.iinfo(np.int64).max

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def chunked(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int, carry: bool = False) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text compressed) of all rows, and the number of chunks. ``carry``: with the whole row, but for the text, as ``row``."""
    rows = text_rows(docs, doc_id, text)
    row = F.struct(*(F.lit(None).cast("string").alias(c) if c == text else F.col(c) for c in docs.columns)).alias("row")
    if carry:
        rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), row)
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [press.compress(t.as_buffer().to_pybytes()) if t.is_valid else press.compress(b"") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary()), *b.columns[3:]], names=["chunk", "doc_id", "z", *b.schema.names[3:]])

    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    schema = "chunk int, doc_id bigint, z binary" + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    return rows.select(chunk.alias("chunk"), "doc_id", "text", *rows.columns[2:]).mapInArrow(pack, schema), n


def released(f):
    """``f`` for a group or a pair of groups, after which the worker gives back its memory."""
    def one(rows: pa.Table) -> pa.Table:
        out = f(rows)
        release()
        return out

    def two(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = f(rows, replies)
        release()
        return out

    return one if f.__code__.co_argcount == 1 else two


class Chunk:
    """The documents of a chunk in one byte array; the same order in every task that loads them."""

    def __init__(self, rows: pa.Table):
        open_ = zstandard.ZstdDecompressor()
        ids = rows.column("doc_id").fill_null(NO_ID).to_pylist()
        docs = sorted((i, open_.decompress(z), k) for k, (i, z) in enumerate(zip(ids, rows.column("z").to_pylist(), strict=True)))
        self.order = [d[2] for d in docs]  # which of the rows each document is
        self.ids = np.array([d[0] for d in docs], dtype=np.int64)
        self.lens = np.array([len(d[1]) for d in docs], dtype=np.int64)
        self.ends = np.cumsum(self.lens)
        self.bytes = np.frombuffer(b"".join(d[1] for d in docs), dtype=np.uint8)
        self.number = int(rows.column("chunk")[0].as_py())
        self._eights = None

    @property
    def eights(self) -> np.ndarray:
        if self._eights is None:
            self._eights = eights(self.bytes)
        return self._eights

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit words that spreads each bit over all."""
    x = x + np.uint64(salt * int(ODD) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def eights(raw: np.ndarray) -> np.ndarray:
    """At each place of some bytes (and at their end) the eight from there on, as one number; zeros follow the end."""
    padded = np.r_[raw, np.zeros(16, np.uint8)]
    out = np.empty(len(raw) + 1, dtype=np.uint64)
    for p in range(min(8, len(out))):
        out[p::8] = np.frombuffer(padded, "<u8", count=(len(out) - p + 7) // 8, offset=p)
    return out


#: A run of more bytes is hashed by the xxhash library.
LONG_RUN = 128
TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _mix_in(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * MIX[1]
    h ^= h >> np.uint64(32)
    return h


def run_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """64 bits of each run of bytes (``words``: their :func:`eights`): eight bytes at a time go through a mixing step
    with all that came before, so that no sum of them can cancel."""
    words = eights(raw) if words is None else words
    h = mixed(size.astype(np.uint64), 3)
    few = np.flatnonzero(size < 8)
    h[few] = _mix_in(h[few], words[start[few]] & TAIL[size[few]])
    long = np.flatnonzero(size > LONG_RUN)
    some = np.flatnonzero((size >= 8) & (size <= LONG_RUN))
    if len(some):
        of, at, left = h[some], start[some], size[some]
        live, done = np.arange(len(some)), 0
        while len(live):
            live = live[left[live] > done + 8]
            of[live] = _mix_in(of[live], words[at[live] + done])
            done += 8
        h[some] = _mix_in(of, words[at + left - 8])
    for k in long.tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k]:start[k] + size[k]], seed=1)
    return mixed(h, 4)


def _joined(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    return mixed(left * MIX[1] ^ (right << np.uint64(23) | right >> np.uint64(41)), salt)


def window_hashes(h: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """64 bits of the ``length`` hashes from each place on: windows grow by joining two shorter ones, each time through a mixing step."""
    h, have = mixed(h, 17 + salt), 1
    while have < length and len(h):
        step = min(have, length - have)
        h = _joined(h[:-step], h[step:], 19 + salt)
        have += step
    return h if have == length else h[:0]


def short(keys: np.ndarray) -> bytes:
    """48 bits of each key."""
    return np.ascontiguousarray(keys).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unshort(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def smallest(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place: the smallest of ``values`` at the places with the same of ``groups``."""
    if not len(groups):
        return values
    order = np.argsort(groups)
    sorted_ = groups[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]]
    out = np.empty_like(values)
    out[order] = np.minimum.reduceat(values[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    return out


def spans_of(sorted_: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The different values of a sorted array, and from where to where each stands."""
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][:len(sorted_)])
    return sorted_[first].tolist(), first.tolist(), np.r_[first[1:], len(sorted_)].tolist() if len(first) else []


LOW48 = np.uint64((1 << 48) - 1)


def key_packets(chunk: Chunk, keys: np.ndarray, docs: np.ndarray, buckets: int, counted: bool = False) -> pa.Table:
    """A chunk's 48-bit keys for each bucket: those of one document and those of several. ``counted``: with how often the chunk has each, rounded up to a power of 2."""
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    values = keys[first]
    several = np.maximum.reduceat(docs, first) != np.minimum.reduceat(docs, first) if len(first) else first > 0
    bucket = (mixed(values, 7) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket * 2 + several, kind="stable")
    times = np.ceil(np.log2(np.diff(np.r_[first, len(keys)]))).astype(np.uint8)[order] if counted else None
    values, several, bucket = values[order], several[order], bucket[order]
    rows, lo, hi = spans_of(bucket)
    part = lambda flag: [short(values[a:b][several[a:b] == flag]) for a, b in zip(lo, hi, strict=True)]
    out = {"bucket": pa.array(rows, pa.int32()), "chunk": pa.array([chunk.number] * len(rows), pa.int32()), "one": pa.array(part(False), pa.binary()), "many": pa.array(part(True), pa.binary())}
    return pa.table(out | ({"times": pa.array([times[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary())} if counted else {}))


KEY_PACKETS = "bucket int, chunk int, one binary, many binary"
KEY_REPLY = "chunk int, keys binary"
COUNTED_PACKETS, COUNTED_REPLY = KEY_PACKETS + ", times binary", KEY_REPLY + ", hot binary"


def hot_keys(packets: pa.Table, most: int) -> pa.Table:
    """:func:`shared_keys` of counted packets, and which of them all chunks together have more than ``most`` times (or half as often)."""
    out = shared_keys(packets)
    mine = [np.r_[unshort(a), unshort(b)] for a, b in zip(packets.column("one").to_pylist(), packets.column("many").to_pylist(), strict=True)]
    keys, times = np.concatenate(mine), np.frombuffer(b"".join(packets.column("times").to_pylist()), np.uint8)
    # a key that no chunk has often needs many chunks to be hot
    often = np.unique(keys[times > 0]) if len(mine) <= most else np.unique(keys)
    at = np.flatnonzero(is_in(keys, often))
    total = np.bincount(np.searchsorted(often, keys[at]), weights=np.exp2(times[at]), minlength=len(often))
    hot = often[total > most]
    return out.append_column("hot", pa.array([short(k[is_in(k, hot)]) for k in mine], pa.binary()))


def shared_keys(packets: pa.Table) -> pa.Table:
    """To each chunk: which of its keys more than one document has."""
    ones = [unshort(x) for x in packets.column("one").to_pylist()]
    manys = [unshort(x) for x in packets.column("many").to_pylist()]
    values = np.sort(np.concatenate([*ones, *manys, *manys]))  # a key of several documents counts twice
    shared = values[1:][values[1:] == values[:-1]]
    shared = shared[np.r_[True, shared[1:] != shared[:-1]][:len(shared)]]
    out = []
    for a, b in zip(ones, manys, strict=True):
        mine = np.r_[a, b]
        out.append(short(mine[is_in(mine, shared)]))
    return pa.table({"chunk": packets.column("chunk"), "keys": pa.array(out, pa.binary())})


def is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def reply_keys(replies: pa.Table, name: str = "keys") -> np.ndarray:
    return np.sort(np.concatenate([unshort(x) for x in replies.column(name).to_pylist()] + [np.zeros(0, np.uint64)]))
