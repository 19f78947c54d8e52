"""Token counts by rank-synchronous merging of byte pairs (operator 10).

The merge rules of a byte-level BPE file are held as sorted arrays.  A task takes
a slice of documents, splits the texts into pre-tokens, keeps each distinct
pre-token once and holds those as one ragged numpy array of symbols.  In each
round every sequence applies its own lowest-rank pair at all its places at
once; a sequence without a known pair is finished.  The symbols that survive
are the tokens.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import distinct, text_rows, text_slices

# Fixed values of the byte-level format: the split pattern, and which bytes stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = r"\t-\r \x85\xa0  -     　"
SELF_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_FULL = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
#: For texts of Latin letters without superscripts and fractions, the same split by the faster module.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile(r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")

#: A worker forgets its known pre-tokens beyond this many.
KNOWN_LIMIT = 400_000


def pre_tokens(text: str) -> list[str]:
    return (_FULL if _NOT_LATIN.search(text) else _LATIN).findall(text)


class Merges:
    """The merge table of a byte-level BPE file in the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        of_byte = {b: chr(b) for b in SELF_BYTES}
        of_byte |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in of_byte)}
        self.byte_symbol = np.array([vocab[of_byte[b]] for b in range(256)], dtype=np.int64)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        to = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.to = key[order], order.astype(np.int64), to[order]
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the sorted table; -1: no rule."""
        k = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, at, -1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, by merging all of them together."""
        raw = [w.encode("utf-8") for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_symbol[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(raw)), lens)
        done = np.zeros(len(raw), dtype=np.int64)
        none = np.iinfo(np.int64).max
        while len(sym):
            rule = np.full(len(sym), -1)
            inner = seq[:-1] == seq[1:]
            rule[:-1][inner] = self._pairs(sym[:-1][inner], sym[1:][inner])
            rank = np.where(rule >= 0, self.rank[rule], none)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(seq)])
            live = best < none
            done[seq[first[~live]]] = size[~live]  # finished: what is left are its tokens
            chosen = (rank == np.repeat(best, size)) & (rank < none)
            # of overlapping places (a a a) the first, third, ... merge
            at = np.flatnonzero(chosen)
            if len(at):
                new_run = np.r_[True, at[1:] != at[:-1] + 1]
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            sym[at] = self.to[rule[at]]
            keep = np.repeat(live, size)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return done

    def count_texts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), dtype=np.int64)
        words: list[str] = []
        ends = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                parts = [text]
                if self.special is not None and self.special.search(text):
                    parts = self.special.split(text)
                    extra[i] = len(parts) - 1
                for part in parts:
                    words += pre_tokens(part)
            ends[i] = len(words)
        if not words:
            return extra
        codes, unique = distinct(words, any("\0" in t for t in texts if t))
        if len(self.known) > KNOWN_LIMIT:
            self.known.clear()
        new = [w for w in unique if w not in self.known]
        if new:
            self.known.update(zip(new, self.count(new).tolist(), strict=True))
        per_word = np.fromiter((self.known[w] for w in unique), np.int64, len(unique))
        total = np.r_[0, np.cumsum(per_word[codes])]
        return extra + total[ends] - total[np.r_[0, ends[:-1]]]


_LOADED: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _LOADED:
        _LOADED[path] = Merges(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level BPE file, the same on every worker.
    Special strings of the file inside a text count as one token each.  Null or
    empty text: 0 bytes, 0 tokens.  Null ids and repeated rows pass through, one
    row out for each row in; an empty table gives an empty result; further
    columns of any name are ignored.  No shuffle: each task counts its own rows."""
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches):
        table = merges(vocabulary)
        for part in text_slices(batches, 1):
            size = pa.compute.binary_length(part.column(1)).fill_null(0).cast(pa.int64())
            n = table.count_texts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_rows(docs, doc_id, text).mapInArrow(run, schema)
