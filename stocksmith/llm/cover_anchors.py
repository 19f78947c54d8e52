"""Exact removal of repeated word windows by difference-cover anchors (operator 6).

A difference cover of period v holds, for every shift, two places that far
apart.  Only windows of ``length - v + 1`` words that start at cover places of
their document are hashed (6 of 31 places): two equal windows of ``length``
words, wherever they lie in their documents, then have such an anchor at the
same offset.  Anchors that more than one document has are extended: around them,
and only there, all full windows are compared across the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ragged_take
from .shards import CHUNK_BYTES, KEY_PACKETS, KEY_REPLY, LOW48, Chunk, chunked, is_in, key_packets, mixed, released, reply_keys, run_hashes, shared_keys, spans_of, window_hashes

LENGTH, PERIOD = 50, 31


def difference_cover(period: int) -> list[int]:
    """Places of which every shift modulo ``period`` is a difference: the fewest for short periods, else a greedy choice."""
    def shifts(places) -> set[int]:
        return {(a - b) % period for a in places for b in places}

    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    if period <= 31:
        for k in range(max(size - 2, 0), period):
            for rest in combinations(range(2, period), k):
                if len(shifts((0, 1, *rest))) == period:
                    return sorted({0, 1 % period, *rest})
    places = [0]
    while len(shifts(places)) < period:
        places.append(max(range(period), key=lambda p: len(shifts([*places, p]))))
    return sorted(places)


IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a chunk: where each lies in the bytes, its document, and hashes of runs of words."""

    def __init__(self, chunk: Chunk):
        ends = np.zeros(len(chunk.bytes) + 1, dtype=bool)  # a document's end parts words like a blank
        ends[chunk.ends] = True
        inside = ~IS_BLANK[chunk.bytes]
        before = np.r_[False, inside[:-1]][:len(inside)] & ~ends[:len(inside)]
        after = np.r_[inside[1:], False][:len(inside)] & ~ends[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.lens = np.flatnonzero(inside & ~after) + 1 - self.start
        self.doc = np.searchsorted(chunk.ends, self.start, side="right")
        self.count = np.bincount(self.doc, minlength=len(chunk.ids))
        self.first = np.cumsum(self.count) - self.count
        self.place = np.arange(len(self.start)) - self.first[self.doc]
        self.word = run_hashes(chunk.bytes, self.start, self.lens)

    def windows(self, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``length`` words of one document start, and their hashes."""
        has = self.place + length <= self.count[self.doc]
        return np.flatnonzero(has), window_hashes(self.word, length, salt)[has[:max(0, len(has) - length + 1)]]


def _anchors(words: Words, length: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    at, key = words.windows(length - period + 1)
    cover = np.zeros(period, dtype=bool)
    cover[difference_cover(period)] = True
    use = cover[words.place[at] % period]
    return at[use], key[use] & LOW48


def _send_anchors(rows: pa.Table, length: int, period: int, buckets: int) -> pa.Table:
    chunk = Chunk(rows)
    words = Words(chunk)
    at, key = _anchors(words, length, period)
    return key_packets(chunk, key, words.doc[at], buckets)


def _send_windows(rows: pa.Table, replies: pa.Table, length: int, period: int, buckets: int) -> pa.Table:
    """Each full window around a shared anchor: its hash and the chunk's smallest document that has it."""
    if not rows.num_rows:
        return _window_packets(0, [], [], [])
    chunk = Chunk(rows)
    words = Words(chunk)
    at, key = _anchors(words, length, period)
    at = at[is_in(key, reply_keys(replies))]
    near = np.zeros(len(words.start) + 1, dtype=np.int64)  # windows that hold a shared anchor start up to period - 1 words before it
    np.add.at(near, np.maximum(at - (period - 1), words.first[words.doc[at]]), 1)
    np.add.at(near, at + 1, -1)
    near = np.cumsum(near)[:-1] > 0
    at, key = words.windows(length)
    use = near[at]
    fine = words.windows(length, 1)[1][use]
    at, key = at[use], key[use]
    ids = chunk.ids[words.doc[at]]
    order = np.lexsort((ids, fine, key))
    key, fine, ids = key[order], fine[order], ids[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (fine[1:] != fine[:-1])][:len(key)]
    key, fine, ids = key[first], fine[first], ids[first]
    bucket = (mixed(key, 9) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, ids, bucket))
    key, fine, ids, bucket = key[order], fine[order], ids[order], bucket[order]
    return _window_packets(chunk.number, list(zip(*spans_of(bucket), strict=True)), [(key, fine)], ids)


def _window_packets(number: int, rows: list, hashes: list, ids) -> pa.Table:
    out = {"bucket": [], "key": [], "fine": [], "ids": [], "counts": []}
    for b, lo, hi in rows:
        (key, fine), own = hashes[0], ids[lo:hi]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out["bucket"].append(b)
        out["key"].append(key[lo:hi].astype("<u8").tobytes())
        out["fine"].append(fine[lo:hi].astype("<u8").tobytes())
        out["ids"].append(own[first].astype("<i8").tobytes())
        out["counts"].append(np.diff(np.r_[first, len(own)]).astype("<u4").tobytes())
    n = len(out["bucket"])
    return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "chunk": pa.array([number] * n, pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in ("key", "fine", "ids", "counts")}})


WINDOW_PACKETS = "bucket int, chunk int, key binary, fine binary, ids binary, counts binary"


def _earlier(packets: pa.Table) -> pa.Table:
    """To each chunk: which of its windows start in a smaller document elsewhere."""
    key = [np.frombuffer(x, "<u8") for x in packets.column("key").to_pylist()]
    fine = [np.frombuffer(x, "<u8") for x in packets.column("fine").to_pylist()]
    ids = [np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(c, "<u4")) for i, c in zip(packets.column("ids").to_pylist(), packets.column("counts").to_pylist(), strict=True)]
    of = np.repeat(np.arange(len(key)), [len(k) for k in key])
    key, fine, ids = np.concatenate(key), np.concatenate(fine), np.concatenate(ids)
    order = np.lexsort((ids, fine, key))
    k, f, i = key[order], fine[order], ids[order]
    first = np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])]
    least = i[np.flatnonzero(first)][np.cumsum(first) - 1]
    hit = order[least < i]
    of, key, fine = of[hit], key[hit], fine[hit]
    order = np.argsort(of, kind="stable")
    of, key, fine = of[order], key[order], fine[order]
    ends = np.searchsorted(of, np.arange(packets.num_rows + 1))
    cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.table({"chunk": packets.column("chunk"), "key": cut(key, "<u8"), "fine": cut(fine, "<u8")})


WINDOW_REPLY = "chunk int, key binary, fine binary"


def _remove(rows: pa.Table, replies: pa.Table, length: int) -> pa.Table:
    """Every document of a chunk without its removed words."""
    if not rows.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
    chunk = Chunk(rows)
    words = Words(chunk)
    at, key = words.windows(length)
    fine, ids = words.windows(length, 1)[1], chunk.ids[words.doc[at]]
    # a smaller document of this chunk
    order = np.lexsort((ids, fine, key))
    k, f, i = key[order], fine[order], ids[order]
    first = np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])][:len(k)]
    gone = np.zeros(len(at), dtype=bool)
    if len(k):
        gone[order] = i[np.flatnonzero(first)][np.cumsum(first) - 1] < i
    # or of another one
    told = np.zeros(sum(len(x) for x in replies.column("key").to_pylist()) // 8, dtype=[("k", "<u8"), ("f", "<u8")])
    told["k"] = np.frombuffer(b"".join(replies.column("key").to_pylist()), "<u8")
    told["f"] = np.frombuffer(b"".join(replies.column("fine").to_pylist()), "<u8")
    told.sort(order=["k", "f"])
    lo = np.searchsorted(told["k"], key, "left")
    hi = np.searchsorted(told["k"], key, "right")
    for step in range(int((hi - lo).max(initial=0))):  # more than one only if 64 bits collide
        has = lo + step < hi
        gone[has] |= told["f"][lo[has] + step] == fine[has]
    cover = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(cover, at[gone], 1)
    np.add.at(cover, at[gone] + length, -1)
    keep = np.cumsum(cover)[:-1] == 0
    kept = np.bincount(words.doc[keep], minlength=len(chunk.ids))
    # kept words, each with a blank behind it
    padded = np.r_[chunk.bytes, np.uint8(0x20)]
    lens = words.lens[keep] + 1
    out = ragged_take(padded, words.start[keep], lens, np.arange(len(lens)))
    out[np.cumsum(lens) - 1] = 0x20
    size = np.bincount(words.doc[keep], weights=lens, minlength=len(chunk.ids)).astype(np.int64)
    to = np.cumsum(size)
    raw = out.tobytes()
    texts = [raw[b - n:b - 1].decode() if n else "" for n, b in zip(size.tolist(), to.tolist(), strict=True)]
    return pa.table({"doc_id": chunk.id_column(), "n_words": pa.array(words.count), "n_removed": pa.array(words.count - kept), "kept": pa.array(texts, pa.string())})


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one blank) of each row of ``docs``.

    A word goes if a window of ``length`` words over it also starts in a document with a
    smaller id, judged on the input.  Words part at ASCII blanks.  Null or empty text: no words.  A
    null id counts as larger than all others; rows with the same id do not
    remove each other's words.  One row out for each in; an empty table gives an
    empty result; further columns are ignored.  One document must fit in a task's memory.

    Windows are compared by 128 bits of hashes that mix word by word, anchors by 48 bits
    (an anchor hit by chance only adds windows to compare)."""
    if not 0 < period < length or length - period < 12:
        raise ValueError("an anchor needs more than 12 words")
    chunks, n = chunked(docs, doc_id, text, chunk_bytes)
    packets = chunks.groupBy("chunk").applyInArrow(released(lambda t: _send_anchors(t, length, period, n)), KEY_PACKETS)
    shared = packets.groupBy("bucket").applyInArrow(shared_keys, KEY_REPLY)
    windows = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(released(lambda t, r: _send_windows(t, r, length, period, n)), WINDOW_PACKETS)
    earlier = windows.groupBy("bucket").applyInArrow(released(_earlier), WINDOW_REPLY)
    return chunks.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(released(lambda t, r: _remove(t, r, length)), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
