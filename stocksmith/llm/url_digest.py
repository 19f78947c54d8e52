"""URL rules by a sorted digest array (operator 4).

A rule list becomes one sorted array of 64-bit xxhash keys with the rules' full
strings beside it.  Workers memory-map that file, cut each URL's host and path
to the lengths that rules have (longest first), probe the keys of a whole batch
by binary search and confirm each hit on the stored string, so a digest
collision changes nothing.
"""

from __future__ import annotations

import os
import struct
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rule lists up to this many bytes are sent to the workers; larger ones are joined.
INDEX_BYTES = 256 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and the path up to ``?`` or ``#``; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build(rules: list[tuple[str, str, str]]) -> bytes:
    """The index file of (host, path, verdict) rules: counts, keys, offsets, length pairs, strings.

    A rule given twice keeps its first verdict in sorted order."""
    verdict: dict[tuple[str, str], str] = {}
    for host, path, v in sorted(rules):
        verdict.setdefault((host, path), v)
    found = sorted((xxhash.xxh64_intdigest((h + p).encode()), h, p, v) for (h, p), v in verdict.items())
    keys = np.array([f[0] for f in found], dtype="<u8")
    texts = [f"{h}{p}\0{v}".encode() for _, h, p, v in found]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)].astype("<i8")
    # the longest rule wins; of equal length the one with the longer host
    pairs = np.array(sorted({(len(h), len(p)) for _, h, p, _ in found}, key=lambda x: (-x[0] - x[1], -x[0])), dtype="<i8").reshape(-1, 2)
    return struct.pack("<qq", len(keys), len(pairs)) + keys.tobytes() + offsets.tobytes() + pairs.tobytes() + b"".join(texts)


class DigestArray:
    """An index file, memory-mapped."""

    def __init__(self, path: str):
        n, m = np.memmap(path, dtype="<i8", mode="r", shape=2)
        at = 16
        self.keys = np.memmap(path, dtype="<u8", mode="r", offset=at, shape=n) if n else np.zeros(0, "<u8")
        at += 8 * n
        self.offsets = np.memmap(path, dtype="<i8", mode="r", offset=at, shape=n + 1)
        at += 8 * (n + 1)
        self.pairs = np.memmap(path, dtype="<i8", mode="r", offset=at, shape=(m, 2)).tolist() if m else []
        at += 16 * m
        self.texts = np.memmap(path, dtype=np.uint8, mode="r", offset=at) if self.offsets[-1] else np.zeros(0, np.uint8)

    def lookup(self, wanted: list[str]) -> list[tuple[str, str] | None]:
        """(rule, verdict) of each string that is a rule."""
        raw = [w.encode() for w in wanted]
        probe = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        lo, hi = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        out: list[tuple[str, str] | None] = [None] * len(raw)
        for i in np.flatnonzero(lo < hi):
            for k in range(lo[i], hi[i]):  # more than one only if digests collide
                rule, verdict = self.texts[self.offsets[k]:self.offsets[k + 1]].tobytes().split(b"\0")
                if rule == raw[i]:
                    out[i] = rule.decode(), verdict.decode()
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest fitting rule of each URL and its verdict."""
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        for in_host, in_path in self.pairs:
            rows = [i for i, (h, p) in enumerate(zip(hosts, paths, strict=True)) if rules[i] is None and len(p) >= in_path
                    and (len(h) == in_host or len(h) > in_host and (not in_host or h[-in_host - 1] == "."))]
            found = self.lookup([hosts[i][len(hosts[i]) - in_host:] + paths[i][:in_path] for i in rows])
            for i, hit in zip(rows, found, strict=True):
                if hit:
                    rules[i], verdicts[i] = hit
        return rules, verdicts


_OPEN: dict[int, DigestArray] = {}


def _mapped(index: bytes) -> DigestArray:
    """The worker's own copy of the index, written once and memory-mapped from then on."""
    key = xxhash.xxh64_intdigest(index)
    if key not in _OPEN:
        fd, path = tempfile.mkstemp(suffix=".digests")
        with os.fdopen(fd, "wb") as f:
            f.write(index)
        _OPEN[key] = DigestArray(path)
        os.unlink(path)  # the mapping stays
    return _OPEN[key]


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains if
    the URL's path starts with the rule's path; the longest wins, of equal
    length the one with the longer host.  No rule: null and ``default``.  Null
    URLs and URLs without ``://`` have an empty host and path.  A rule with a null
    host or path is ignored, one given twice keeps its smallest verdict.  Each
    row of ``pages``, also a repeated one or one with a null id, gives one row.

    Rule lists of up to ``index_bytes`` are made into one index file and sent
    to the workers; beyond it, URLs are joined to the rules on the digest."""
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + F.octet_length("verdict") + 24), F.lit(0))).first()[0]
    if size > index_bytes:
        return _joined(rows, rules, default)
    ship(rows.sparkSession)
    index = rows.sparkSession.sparkContext.broadcast(build([tuple(r) for r in rules.collect()]))

    def run(batches):
        array = _mapped(index.value)
        for b in batches:
            rule, verdict = array.judge(b.column(1).to_pylist(), b.column(2).to_pylist())
            verdict = [v or default for v in verdict]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equi-join of the distinct (host, path) on digest and string."""
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rules = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("in_host"), F.length("path").alias("in_path"), "verdict")
    lengths = rules.agg(F.collect_set(F.struct("in_host", "in_path")).alias("lengths"))  # no more than there are length pairs
    urls = rows.select("host", "path").distinct()
    cut = F.expr("explode(filter(lengths, x -> x.in_path <= length(path) and (x.in_host = length(host) or x.in_host < length(host) and (x.in_host = 0 or substring(host, length(host) - x.in_host, 1) = '.'))))")
    probes = urls.join(lengths).select("host", "path", cut.alias("cut"))
    key = F.concat(F.expr("substring(host, length(host) - cut.in_host + 1, cut.in_host)"), F.expr("substring(path, 1, cut.in_path)"))
    probes = probes.select("host", "path", key.alias("rule"), F.xxhash64(key).alias("digest"))
    hits = probes.join(rules.withColumn("digest", F.xxhash64("rule")), ["digest", "rule"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "in_host", "rule", "verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
