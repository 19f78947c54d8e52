"""Exact removal of repeated byte strings by induced suffix arrays (operator 7).

Texts are cut into runs of places whose next 50 bytes have the same smallest
27-byte hash; equal 50-byte strings have the same one.  Runs whose hash more
than one document has travel, with the bytes they need, to the shard of that
hash; runs of a hash that is very frequent go place by place, each to the shard of
its 50 bytes.  A shard joins its different runs into one string and builds its suffix
array by induced sorting: suffixes are classified, the leftmost-smaller (LMS)
substrings ranked, the string of their ranks sorted in turn, and all others
induced from them in two sweeps.  Common prefixes, computed in text order,
tell which neighbours share 50 bytes; each such group's smallest document
decides, and the shard tells each chunk which places start in an earlier one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged_take
from .shards import CHUNK_BYTES, COUNTED_PACKETS, COUNTED_REPLY, LOW48, MIX, Chunk, chunked, eights, hot_keys, is_in, key_packets, mixed, released, reply_keys, run_hashes, spans_of

LENGTH, GRAM = 50, 27
#: A gram hash that all chunks together have in more runs is split: its runs differ at the edges of a passage, and in one bucket would grow with the documents.
HOT_RUNS = 4096
#: A string whose symbols recur less often than this is ranked by doubling instead of by buckets.
RECUR = 256


def classify(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the next one. The last one is L-type, as only the end follows."""
    out = np.zeros(len(t), dtype=bool)
    out[:-1] = t[:-1] < t[1:]
    equal = np.flatnonzero(t[:-1] == t[1:])  # a run of equal symbols has the type of its last one
    if len(equal):
        ends = np.r_[equal[1:] != equal[:-1] + 1, True]
        out[equal] = out[equal[ends] + 1][np.cumsum(ends) - ends]
    return out


def _rank_lms(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings (equal ones share a rank), and how many ranks there are."""
    n = len(t)
    used = np.bincount(t, minlength=symbols) > 0
    bits = max(2, int(2 * used.sum() + 1).bit_length())
    per = 62 // bits
    size = np.r_[lms[1:], n - 1] - lms + 1
    code = np.r_[(np.cumsum(used) - 1)[t] * 2 + s + 1, np.zeros(per, np.int64)]

    def packed(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), dtype=np.int64)
        for k in range(per):
            key = key << bits | np.where(k < left, code[np.minimum(at + k, n)], 0)
        return key

    _, rank = np.unique(packed(lms, size), return_inverse=True)
    done = per
    while len(more := np.flatnonzero(size > done)):
        # ranks that longer ones have: each is split by their next symbols
        _, nxt = np.unique(packed(lms[more] + done, size[more] - done), return_inverse=True)
        split = np.zeros(int(rank.max()) + 1, dtype=bool)
        split[rank[more]] = True
        part = np.flatnonzero(split[rank])
        further = np.zeros(len(rank), dtype=np.int64)
        further[more] = nxt + 1
        keys, inner = np.unique(rank[part] * (len(more) + 1) + further[part], return_inverse=True)
        of = keys // (len(more) + 1)
        width = np.ones(len(split), dtype=np.int64)
        width[split] = np.bincount(of, minlength=len(split))[split]
        start = np.cumsum(width) - width
        begin = np.searchsorted(of, rank[part])
        rank = start[rank]
        rank[part] += inner - begin
        done += per
    return rank, int(rank.max()) + 1


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Suffix array of a string of ranks by prefix doubling; only unsettled suffixes are sorted again."""
    n = len(rank)
    order = np.argsort(rank)
    sorted_ = rank[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]]
    pos = np.empty(n, dtype=np.int64)
    pos[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a suffix's rank: where its group starts
    h = 1
    open_ = np.flatnonzero(~(first & np.r_[first[1:], True]))  # places in order that are in groups of two or more
    while len(open_):
        i = order[open_]
        key = pos[i] * (n + 1) + np.where(i + h < n, pos[np.minimum(i + h, n - 1)] + 1, 0)
        by = np.argsort(key)
        i, key = i[by], key[by]
        order[open_] = i
        first = np.r_[True, key[1:] != key[:-1]]
        pos[i] = open_[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))]
        open_ = open_[~(first & np.r_[first[1:], True])]
        h *= 2
    return order


_ZERO = np.zeros(1, dtype=np.int64)


def _deal(sa: np.ndarray, ends: np.ndarray, j: np.ndarray, c: np.ndarray, sign: int) -> None:
    """Puts suffixes j (in order) at the moving ends of the buckets of their symbols c."""
    by = np.argsort(c, kind="stable")
    j, c = j[by], c[by]
    edge = np.flatnonzero(c[1:] != c[:-1]) + 1
    first = np.concatenate((_ZERO, edge))
    count = np.concatenate((edge, [len(c)])) - first
    own = c[first]
    at = np.arange(len(c))
    sa[np.repeat(ends[own] - sign * first, count) + (at if sign > 0 else -at)] = j
    ends[own] += sign * count


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of t from its LMS suffixes in order: L-types in a sweep up, S-types in a sweep down."""
    n = len(t)
    edge = np.r_[0, np.cumsum(np.bincount(t, minlength=symbols))]
    sa = np.full(n, -1, dtype=np.int32)
    lms = lms.astype(np.int32)
    head, tail = edge[:-1].copy(), edge[1:] - 1
    lms_edge = np.searchsorted(t[lms], np.arange(symbols + 1))
    is_l = ~s
    _deal(sa, head, np.array([n - 1]), t[n - 1:], 1)  # the one before the end
    for c in np.flatnonzero(np.diff(edge)):
        at = edge[c]
        while at < head[c]:  # those that the bucket gives itself follow as a wave of their own
            wave, at = sa[at:head[c]] - 1, head[c]
            wave = wave[wave >= 0]
            wave = wave[is_l[wave]]
            if len(wave):
                _deal(sa, head, wave, t[wave], 1)
        wave = lms[lms_edge[c]:lms_edge[c + 1]] - 1
        wave = wave[wave >= 0]
        if len(wave):
            _deal(sa, head, wave, t[wave], 1)
    for c in np.flatnonzero(np.diff(edge))[::-1]:
        at = edge[c + 1] - 1
        while at > tail[c]:
            wave, at = sa[tail[c] + 1:at + 1][::-1] - 1, tail[c]
            wave = wave[wave >= 0]
            wave = wave[s[wave]]
            if len(wave):
                _deal(sa, tail, wave, t[wave], -1)
        wave = sa[edge[c]:head[c]][::-1] - 1
        wave = wave[wave >= 0]
        wave = wave[s[wave]]
        if len(wave):
            _deal(sa, tail, wave, t[wave], -1)
    return sa


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of a string of numbers below ``symbols`` by induced sorting."""
    if len(t) < 2:
        return np.arange(len(t))
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms):
        rank, ranks = _rank_lms(t, s, lms, symbols)
        if ranks == len(lms):
            order = np.argsort(rank)
        elif ranks * RECUR <= len(lms):
            order = suffix_array(rank, ranks)
        else:
            order = _doubled(rank)
        lms = lms[order]
    return _induce(t, s, lms, symbols)


def common_prefixes(t: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For suffixes of ``least`` bytes or more in sorted order: do so many agree with the one before? (The first: no.)

    Permuted: computed in text order, so that neighbouring places read neighbouring
    bytes, eight at a time."""
    n = len(order)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    before = np.full(len(t), -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    place = np.empty(len(t), dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    a = np.flatnonzero(before >= 0)
    rank, b = place[a], before[a]
    words = eights(t)
    steps = [*range(0, least - 7, 8)] + ([least - 8] if least % 8 else [])
    for k in steps:
        same = words[a + k] == words[b + k]
        rank, a, b = rank[same], a[same], b[same]
    out[rank] = True
    return out


#: Odd factors of the eight-byte parts of a gram.
PARTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def _least_grams(word8: np.ndarray, gram: int, span: int) -> np.ndarray:
    """At each place: the smallest hash of the ``span`` grams from there on, in blocks that fit a processor's cache.

    The hash only chooses where strings meet, and for grams a 48-bit key; strings themselves are compared byte by byte."""
    out = np.empty(max(0, len(word8) - gram - span + 1), dtype=np.uint64)
    parts = [*range(0, gram - 7, 8)] + ([gram - 8] if gram % 8 else [])
    for at in range(0, len(out), 16384):
        to = min(at + 16384, len(out)) + span - 1
        h = word8[at:to] * PARTS[0]
        for k, p in enumerate(parts[1:], 1):
            h ^= h >> np.uint64(31)
            h += word8[at + p:to + p]
            h *= PARTS[k % len(PARTS)]
        h ^= h >> np.uint64(32)
        h *= MIX[0]
        h ^= h >> np.uint64(29)
        have = 1
        while have < span:  # twice as many neighbours are covered each time
            step = min(have, span - have)
            h = np.minimum(h[:len(h) - step], h[step:])
            have += step
        out[at:to - span + 1] = h
    return out


class Runs:
    """Runs of places in a chunk whose windows have the same smallest gram hash."""

    def __init__(self, chunk: Chunk, length: int, gram: int):
        self.chunk = chunk
        least = _least_grams(chunk.eights, gram, length - gram + 1)
        n = len(least)
        first = np.empty(n, dtype=bool)
        first[1:] = least[1:] != least[:-1]
        some = chunk.lens >= length
        begin, end = (chunk.ends - chunk.lens)[some], chunk.ends[some] - length + 1  # places of each document that have a window
        first[begin] = True
        first[end[end < n]] = True
        first = np.flatnonzero(first) if n else np.zeros(0, np.int64)
        if not len(begin):
            first = first[:0]
        doc = np.searchsorted(begin, first, side="right") - 1
        size = np.diff(np.r_[first, n])
        has = (doc >= 0) & (first < end[doc]) if len(first) else np.zeros(0, bool)
        self.start, self.doc, self.places = first[has], np.flatnonzero(some)[doc[has]], size[has]
        self.key = least[self.start] & LOW48
        self.size = self.places + length - 1

    def split(self, hot: np.ndarray, length: int) -> None:
        """Cuts the runs of hot keys (sorted) into single places."""
        if not len(hot):
            return
        of = np.repeat(np.arange(len(self.key)), np.where(is_in(self.key, hot), self.places, 1))
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][:len(of)])
        within = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        self.start, self.doc, self.key, self.places = self.start[of] + within, self.doc[of], self.key[of], self.places[of]
        self.places[is_in(self.key, hot)] = 1
        self.size = self.places + length - 1


def _send_keys(rows: pa.Table, length: int, gram: int, buckets: int) -> pa.Table:
    chunk = Chunk(rows)
    runs = Runs(chunk, length, gram)
    return key_packets(chunk, runs.key, runs.doc, buckets, counted=True)


RUN_PACKETS = "bucket int, chunk int, count int, data binary, local binary"


def _pairs(start: np.ndarray, end: np.ndarray) -> bytes:
    """The union of some ranges, as disjoint ones: windows overlap, so these are far fewer."""
    if not len(start):
        return b""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return np.column_stack([start[first], reach[np.r_[first[1:], len(start)] - 1]]).astype("<u4").tobytes()


def _send_runs(rows: pa.Table, replies: pa.Table, length: int, gram: int, buckets: int) -> pa.Table:
    """The different runs with a shared key, each with the chunk's smallest document that has it and where that has it.

    Bytes of the chunk's other documents that have such a run are gone already."""
    out: dict[str, list] = {"bucket": [], "count": [], "data": []}
    number, local = 0, b""
    if rows.num_rows:
        chunk = Chunk(rows)
        number = chunk.number
        runs = Runs(chunk, length, gram)
        hot = reply_keys(replies, "hot")
        runs.split(hot, length)
        use = np.flatnonzero(is_in(runs.key, reply_keys(replies)))
        content = run_hashes(chunk.bytes, runs.start[use], runs.size[use], chunk.eights)
        order = np.argsort(content, kind="stable")
        use, content = use[order], content[order]
        ids = chunk.ids[runs.doc[use]]
        first = np.flatnonzero(np.r_[True, content[1:] != content[:-1]][:len(content)])
        copies = np.diff(np.r_[first, len(content)])
        least = np.repeat(np.minimum.reduceat(ids, first), copies) if len(first) else ids
        later = use[ids > least]
        local = _pairs(runs.start[later], (runs.start + runs.size)[later])
        # the smallest document's own places of each run
        stay = ids == least
        of = np.repeat(np.arange(len(first)), copies)[stay]
        use, ids, content = use[stay], ids[stay], content[stay]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][:len(of)])
        times = np.diff(np.r_[first, len(of)])
        one = use[first]
        bucket = (mixed(np.where(is_in(runs.key[one], hot), content[first], runs.key[one]), 9) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((runs.start[one], ids[first], bucket))
        press = zstandard.ZstdCompressor(level=1)
        for b, lo, hi in zip(*spans_of(bucket[order]), strict=True):
            part = order[lo:hi]
            head = [runs.size[one[part]].astype("<u4"), times[part].astype("<u4"), ids[first[part]].astype("<i8"), runs.start[ragged_take(use, first, times, part)].astype("<u4")]
            out["bucket"].append(b)
            out["count"].append(hi - lo)
            out["data"].append(press.compress(b"".join(x.tobytes() for x in head) + ragged_take(chunk.bytes, runs.start, runs.size, one[part]).tobytes()))
    n = len(out["bucket"])
    told = [local if k == number % n else b"" for k in range(n)]  # comes back once with the replies, of different chunks through different buckets
    return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "chunk": pa.array([number] * n, pa.int32()), "count": pa.array(out["count"], pa.int32()), "data": pa.array(out["data"], pa.binary()), "local": pa.array(told, pa.binary())})


RUN_REPLY = "chunk int, local binary, gone binary"


def _earlier(packets: pa.Table, length: int) -> pa.Table:
    """To each chunk: which of its bytes lie in a string that a smaller document elsewhere has."""
    open_ = zstandard.ZstdDecompressor()
    sizes, times, ids, starts, raws = [], [], [], [], []
    for n, z in zip(packets.column("count").to_pylist(), packets.column("data").to_pylist(), strict=True):
        data = open_.decompress(z)
        sizes.append(np.frombuffer(data, "<u4", n).astype(np.int64))
        times.append(np.frombuffer(data, "<u4", n, 4 * n).astype(np.int64))
        ids.append(np.frombuffer(data, "<i8", n, 8 * n))
        all_ = int(times[-1].sum())
        starts.append(np.frombuffer(data, "<u4", all_, 16 * n))
        raws.append(np.frombuffer(data, np.uint8, offset=16 * n + 4 * all_))
    n_runs = [len(x) for x in sizes]
    size, times, doc, starts, text = np.concatenate(sizes), np.concatenate(times), np.concatenate(ids), np.concatenate(starts), np.concatenate(raws)
    del raws
    start = np.cumsum(size) - size
    # each different run once, with its smallest document
    content = run_hashes(text, start, size)
    order = np.argsort(content, kind="stable")
    new = np.r_[True, content[order][1:] != content[order][:-1]]
    first = np.flatnonzero(new)
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    one, least = order[first], np.minimum.reduceat(doc[order], first)
    t = ragged_take(text, start, size, one)
    own, width = np.cumsum(size[one]) - size[one], size[one] - length + 1
    if not _same_bytes(text, start, size, t, own[which], size[one][which]):
        raise RuntimeError("two different runs have the same 64-bit hash")
    del text, content
    # suffixes that have a whole window in their run
    inside = np.ones(len(t), dtype=bool)
    inside[ragged_take(np.arange(len(t)), own + width, np.full(len(one), length - 1), np.arange(len(one)))] = False
    sa = suffix_array(t, 256)
    sa = sa[inside[sa]]
    same = common_prefixes(t, sa, length)
    group = np.cumsum(~same) - 1
    at_place = np.zeros(len(t), dtype=np.int64)
    at_place[inside] = np.repeat(least, width)
    at_place[sa] = np.minimum.reduceat(at_place[sa], np.flatnonzero(~same))[group]
    del sa, group, inside, t
    # back to each chunk's own run: from where to where its places are found in a smaller document
    count = width[which]
    begin = np.cumsum(count) - count
    flag = ragged_take(at_place, own[which], width[which], np.arange(len(which))) < np.repeat(doc, count)
    edge = np.zeros(len(flag) + 1, dtype=bool)
    edge[begin] = True
    from_ = np.flatnonzero(flag & (edge[:-1] | ~np.r_[False, flag[:-1]]))
    edge[-1] = True
    to = np.flatnonzero(flag & (edge[1:] | ~np.r_[flag[1:], False])) + 1
    run = np.searchsorted(begin, from_, side="right") - 1
    # at each of the places that the chunk's document has it
    n = times[run]
    base = ragged_take(starts.astype(np.int64), np.cumsum(times) - times, times, run)
    lo, hi = base + np.repeat(from_ - begin[run], n), base + np.repeat(to - begin[run], n) + length - 1
    bounds = np.searchsorted(np.repeat(run, n), np.r_[0, np.cumsum(n_runs)]).tolist()
    gone = [_pairs(lo[a:b], hi[a:b]) for a, b in zip(bounds, bounds[1:])]
    return pa.table({"chunk": packets.column("chunk"), "local": packets.column("local"), "gone": pa.array(gone, pa.binary())})


def _same_bytes(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> bool:
    """Are the runs of ``a``, one after another, those of ``b``? Compared a few MB at a time."""
    if not np.array_equal(a_size, b_size):
        return False
    step = 1 << 16
    return all(np.array_equal(a[a_start[k]:a_start[min(k + step, len(a_start)) - 1] + a_size[min(k + step, len(a_start)) - 1]],
                              ragged_take(b, b_start, b_size, np.arange(k, min(k + step, len(a_start))))) for k in range(0, len(a_start), step))


def _gone(chunk: Chunk, replies: pa.Table) -> np.ndarray:
    """Which bytes of a chunk are removed."""
    told = [x for name in ("local", "gone") for x in replies.column(name).to_pylist()]
    edges = np.frombuffer(b"".join(told), "<u4").reshape(-1, 2)
    n = len(chunk.bytes) + 1
    return np.cumsum(np.bincount(edges[:, 0], minlength=n) - np.bincount(edges[:, 1], minlength=n))[:-1] > 0


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _remove(rows: pa.Table, replies: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return pa.table({k: pa.array([], pa.int64()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")} | {"kept": pa.array([], pa.binary())})
    chunk = Chunk(rows)
    gone = _gone(chunk, replies)
    total = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, chunk.ends]])
    begins = gone & ~np.r_[False, gone[:-1]][:len(gone)]
    starts = (chunk.ends - chunk.lens)[chunk.lens > 0]
    begins[starts] = gone[starts]  # a run ends with its document
    removed = total(gone)
    ends = np.cumsum(chunk.lens - removed)
    raw = chunk.bytes[~gone].tobytes()
    kept = [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
    return pa.table({"doc_id": chunk.id_column(), "n_bytes": pa.array(chunk.lens), "n_removed": pa.array(removed), "n_spans": pa.array(total(begins)), "kept": pa.array(kept, pa.binary())})


def _replies(chunks: DataFrame, n: int, length: int, gram: int, hot_runs: int) -> DataFrame:
    """For each chunk: its bytes in strings that a smaller document has."""
    if not 8 <= gram < length:
        raise ValueError("a gram has 8 bytes at least and is shorter than the strings")
    n *= 2  # buckets: a run takes more memory in its bucket than its bytes in their chunk
    packets = chunks.groupBy("chunk").applyInArrow(released(lambda t: _send_keys(t, length, gram, n)), COUNTED_PACKETS)
    shared = packets.groupBy("bucket").applyInArrow(lambda t: hot_keys(t, hot_runs), COUNTED_REPLY)
    runs = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(released(lambda t, r: _send_runs(t, r, length, gram, n)), RUN_PACKETS)
    return runs.groupBy("bucket").applyInArrow(released(lambda t: _earlier(t, length)), RUN_REPLY)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of each row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``length`` bytes over it also starts in a
    document with a smaller id, judged on the input; n_spans counts maximal removed
    runs.  Null or empty text: no bytes.  A null id counts as larger than all others;
    rows with the same id do not remove each other's bytes.  One row out for
    each in; an empty table gives an empty result; further columns are ignored.
    One document must fit in a task's memory."""
    chunks, n = chunked(docs, doc_id, text, chunk_bytes)
    earlier = _replies(chunks, n, length, gram, hot_runs)
    return chunks.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(released(lambda t, r: _remove(t, r)), RESULT)


def _cut(rows: pa.Table, replies: pa.Table) -> pa.Table:
    """The rows of a chunk, with the text that is left where there was one."""
    if not rows.num_rows:
        return pa.table({"row": rows.column("row"), "left": pa.array([], pa.string())})
    chunk = Chunk(rows)
    gone = _gone(chunk, replies)
    first = np.flatnonzero((chunk.bytes & 0xC0) != 0x80)  # a character goes with any of its bytes
    if len(first):
        gone = np.repeat(np.logical_or.reduceat(gone, first), np.diff(np.r_[first, len(gone)]))
    ends = np.cumsum(chunk.lens - np.diff(np.r_[0, np.cumsum(gone)][np.r_[0, chunk.ends]]))
    raw = chunk.bytes[~gone].tobytes()
    left = [raw[a:b].decode() for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
    return pa.table({"row": rows.column("row").take(pa.array(chunk.order)), "left": pa.array(left, pa.string())})


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with the characters cut of which :func:`remove_repeats` removes a byte; all rows and other columns stay, null texts become empty."""
    chunks, n = chunked(docs, doc_id, text, chunk_bytes, carry=True)
    earlier = _replies(chunks, n, length, gram, hot_runs)
    schema = f"row {chunks.schema['row'].dataType.simpleString()}, left string"
    out = chunks.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(released(lambda t, r: _cut(t, r)), schema)
    return out.select(*(F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
