"""Near-duplicates by banded MinHash and odd sketches (operator 3).

A document's set are the hashes of its distinct word shingles; equal sets are one
class.  MinHash values, six to a band, put classes into buckets, and all values
of a class are folded into an odd sketch: a bitmap in which each (place, value)
flips one bit.  Of two sketches, the bits that differ tell how many values do, so
the XOR population count estimates a high similarity precisely.

In every bucket all classes are compared with its smallest one: pairs whose sketches
rule the similarity out are dropped, the others are confirmed on the full sets.
Buckets in which that does not connect all members are compared completely, in blocks, on the
full sets; a block gives back only links that connect something.  Links are
then joined to components.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_rows, text_slices, written
from .components import components
from .cover_anchors import Words
from .shards import mixed, released, window_hashes

BANDS, ROWS, BITS = 40, 6, 1024
#: Bytes of text handled at a time; a task holds about 60 times as much.
SLICE = 1 << 20
#: Members of a bucket that a task compares with as many others at a time.
BLOCK = 512

_RANDOM = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64), 5)
SALTS, FACTORS = _RANDOM[:BANDS * ROWS], _RANDOM[BANDS * ROWS:] | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted within it, one after another; and how many each has."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8).copy()
    raw[(raw >= 65) & (raw <= 90)] |= 32
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    split = Words(SimpleNamespace(bytes=raw, ends=np.cumsum(lens), ids=lens))
    at, h = split.windows(words)
    doc = split.doc[at]
    few = np.flatnonzero((split.count > 0) & (split.count < words))  # the whole sequence is one shingle
    parts = [h]
    for n in range(1, words):
        same = few[split.count[few] == n]
        row = split.word[split.first[same, None] + np.arange(n)].ravel()
        parts.append(mixed(window_hashes(row, n)[::n], 6 + n))
        doc = np.r_[doc, same]
    h = np.concatenate(parts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][:len(h)]
    return h[new], np.bincount(doc[new], minlength=len(texts))


def identities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set: two sums over its members; shape (sets, 2)."""
    out = np.zeros((len(sizes), 2), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    for k in range(2):
        if len(full):
            out[full, k] = np.add.reduceat(mixed(h, 11 + k), starts)
    return out


def minhashes(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of each set that is not empty."""
    sizes = sizes[sizes > 0]
    out = np.empty((len(sizes), len(SALTS)), dtype=np.uint64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):  # as many sets at a time as fit a processor's cache
        lo = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + 32768, side="right")))
        part, starts = h[lo:ends[to - 1]], ends[at:to] - sizes[at:to] - lo
        for k, (salt, factor) in enumerate(zip(SALTS, FACTORS, strict=True)):
            out[at:to, k] = np.minimum.reduceat((part ^ salt) * factor, starts)
        at = to
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    grouped = values.reshape(len(values), BANDS, ROWS)
    key = np.zeros((len(values), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key ^ grouped[:, :, k], 13 + k)
    return key.view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Bitmaps (as 64-bit words) in which every (place, value) flips one bit."""
    bit = mixed(values + np.arange(values.shape[1], dtype=np.uint64) * FACTORS[0], 21) % np.uint64(BITS)
    out = np.empty((len(values), BITS // 64), dtype=np.int64)
    for at in range(0, len(values), 1024):
        part = bit[at:at + 1024].astype(np.int64)
        flips = np.bincount((part + np.arange(len(part))[:, None] * BITS).ravel(), minlength=len(part) * BITS) & 1
        out[at:at + 1024] = np.packbits(flips.reshape(len(part), BITS).astype(np.uint8), axis=1).view(np.int64)
    return out


def most_bits(similarity: float, sigmas: float = 6.0) -> int:
    """Differing bits that sketches of this similarity stay under, but for an error of so many sigmas."""
    k = BANDS * ROWS
    low = max(0.0, similarity - sigmas * math.sqrt(similarity * (1 - similarity) / k))
    flips = 2 * k * (1 - low)
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** flips)
    return math.ceil(expected + 2 * math.sqrt(expected))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, node (the set's identity; null without words or id), n_shingles, bands and odd sketch of each row."""

    def run(batches):
        for part in text_slices(batches, 1, SLICE):
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            h, sizes = shingle_sets(texts, words)
            node = identities(h, sizes)
            values = minhashes(h, sizes)
            full = sizes > 0
            pick = np.cumsum(full) - 1
            bands, odd = band_keys(values), odd_sketches(values)
            use = full & np.asarray(part.column(0).is_valid())
            lists = lambda x: pa.array([x[pick[i]] if use[i] else None for i in range(len(use))], pa.list_(pa.int64()))
            raw = node.astype("<u8")
            names = pa.array([raw[i].tobytes() if use[i] else None for i in range(len(use))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), names, pa.array(sizes), lists(bands), lists(odd)], names=["doc_id", "text_key", "node", "n_shingles", "bands", "odd"])

    docs = docs.withColumn("text_key", F.xxhash64("text"))
    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, node binary, n_shingles bigint, bands array<bigint>, odd array<bigint>")


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, z) for the classes ``wanted`` (node, id): the compressed text of one document that has that set."""

    def press(batches):
        tool = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tool.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    def same(batches):  # an id may stand on several texts
        tool = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                node = identities(*shingle_sets([tool.decompress(z) for z in part.column(1).to_pylist()], words)).astype("<u8")
                yield part.filter(pa.array([x.tobytes() == n for x, n in zip(node, part.column(0).to_pylist(), strict=True)], pa.bool_()))

    texts = docs.where("doc_id is not null").mapInArrow(press, "id bigint, z binary")
    found = texts.join(wanted, "id").select("node", "z").mapInArrow(same, "node binary, z binary")
    return found.groupBy("node").agg(F.min("z").alias("z"))


def _linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _confirm(pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b, za, zb) whose full sets are similar enough."""

    def run(batches):
        tool = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = [tool.decompress(z) for z in part.column(2).to_pylist() + part.column(3).to_pylist()]
                h, sizes = shingle_sets(raw, words)
                ends = np.cumsum(sizes)
                n = part.num_rows
                ok = [_linked(len(np.intersect1d(h[ends[i] - sizes[i]:ends[i]], h[ends[n + i] - sizes[n + i]:ends[n + i]], assume_unique=True)), sizes[i], sizes[n + i], percent) for i in range(n)]
                yield part.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "za", "zb").mapInArrow(run, "a binary, b binary")


def _block_links(rows: pa.Table, percent: int, words: int) -> pa.Table:
    """Links between members of a block that are not yet connected there, on the full sets."""
    tool = zstandard.ZstdDecompressor()
    node, star = rows.column("node").to_pylist(), np.array(rows.column("linked").to_pylist(), dtype=bool)
    h, sizes = shingle_sets([tool.decompress(z) for z in rows.column("z").to_pylist()], words)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(h, kind="stable")
    value, owner = h[order], owner[order]
    group = np.where(star, 0, np.arange(1, len(star) + 1))  # those linked with the bucket's smallest are connected by it
    found: list[tuple[bytes, bytes]] = []
    for x in np.flatnonzero(~star):  # of any two that are not connected, one is not in that group
        own = h[ends[x] - sizes[x]:ends[x]]
        lo, hi = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        inter = np.bincount(owner[at], minlength=len(sizes))
        hits = np.flatnonzero(_linked(inter, sizes[x], sizes, percent) & (group != group[x]))
        for g in np.unique(group[hits]):
            y = hits[group[hits] == g][0]
            found.append((node[x], node[y]))
        group[np.isin(group, group[hits])] = group[x]
    return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs``.

    Words part at ASCII blanks, A-Z are lower-cased; a set are the distinct shingles of ``words``
    words, with fewer words the whole sequence as one.  Documents are linked if
    intersection / union of their sets is at least ``percent`` per cent;
    component_id is the smallest id that links reach, kept says if it is the row's own.  No words, null
    text or a null id: linked with nothing (null id: null component, kept).  Rows
    with equal sets are in one component, also repeated rows; each row gives one
    row.  An empty table gives an empty result; further columns are ignored.

    Two sets of similarity 0.8 miss all 40 bands with a probability of 5e-6, more
    similar ones with less."""
    return _components(text_rows(docs, doc_id, text), percent, words, block).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` does not keep, and repeated rows of one id and text once.

    Rows without an id stay."""
    found = _components(text_rows(docs, doc_id, text), percent, words, BLOCK)
    kept = found.where("kept and doc_id is not null").select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"))
    again = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(F.lit(1)))
    with_id = rows.where("doc_id is not null").join(kept, ["doc_id", "text_key"], "left_semi").withColumn("again", again).where("again = 1")
    return with_id.select("row.*").union(rows.where("doc_id is null").select("row.*"))


def _components(rows: DataFrame, percent: int, words: int, block: int) -> DataFrame:
    """What :func:`near_duplicates` gives for rows (doc_id, text), with a hash of each text beside it."""
    spark = rows.sparkSession
    signed = written(spark, _signatures(rows, words), "signatures")
    classes = written(spark, signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("id"), *(F.first(k).alias(k) for k in ("n_shingles", "bands", "odd"))), "classes")

    keys = classes.select(F.explode("bands").alias("key"), "node")
    buckets = checkpointed(spark, keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).where("members > 1"))
    members = written(spark, keys.join(buckets, "key"), "members")

    # all members against the bucket's smallest
    sketch = lambda side: classes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("odd").alias(f"odd{side}"))
    pairs = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(sketch("a"), "a").join(sketch("b"), "b")
    pairs = checkpointed(spark, pairs.where(_may_link(percent)).select("a", "b"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    failing = lambda links: members.where("node <> pivot").join(links.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("linked")), ["node", "pivot"], "left")
    # buckets with a pair that the sketches rule out are compared completely, too, so their texts are wanted as well
    open_ = failing(pairs).where("linked is null").select("key").distinct()
    more = members.join(checkpointed(spark, open_), "key", "left_semi").select("node").distinct()
    wanted = classes.join(ends.union(more).distinct(), "node", "left_semi").select("node", "id")
    texts = written(spark, _texts(rows, wanted, words), "texts")
    text_of = lambda side: texts.select(F.col("node").alias(side), F.col("z").alias(f"z{side}"))
    links = checkpointed(spark, _confirm(pairs.join(text_of("a"), "a").join(text_of("b"), "b"), percent, words))

    # buckets that are not connected by their smallest, completely
    open_ = checkpointed(spark, failing(links).where("linked is null").select("key").distinct())
    rest = members.join(open_, "key", "left_semi")
    star = links.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("star"))
    rest = rest.join(star, ["node", "pivot"], "left").withColumn("linked", F.coalesce("star", F.col("node") == F.col("pivot"))).drop("star")
    blocks = F.ceil(F.col("members") / block).cast("bigint")
    own = F.pmod(F.xxhash64("node"), blocks)
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rest = rest.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "linked")
    more = rest.join(texts, "node").groupBy("key", "lo", "hi").applyInArrow(released(lambda t: _block_links(t, percent, words)), "a binary, b binary")

    label = components(links.union(more))
    named = checkpointed(spark, classes.select("node", "id").join(label, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label")))
    least = checkpointed(spark, named.groupBy("label").agg(F.min("id").alias("component_id")))
    place = checkpointed(spark, named.join(least, "label").select("node", "component_id"))
    out = signed.select("doc_id", "text_key", "node", "n_shingles").join(place, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _may_link(percent: int) -> Column:
    """Set sizes and sketches of a pair do not rule the similarity out."""
    differing = F.aggregate(F.zip_with("odda", "oddb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differing <= most_bits(percent / 100))
