"""Operator 12 against the two libraries on whole texts, and plain Python."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from tokenizers import Tokenizer

from stocksmith.llm import token_align
from stocksmith.llm.catalog import QUERIES
from stocksmith.llm.rank_merge import SELF_BYTES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        rest = iter(range(256, 512))
        self.byte = {chr(b) if b in SELF_BYTES else chr(next(rest)): b for b in range(256)}

    def spans(self, text):
        """[(id, start, end)] of both tokenizers; None where their bytes are not the text's."""
        out = []
        raw = (" " + text).encode()
        for pairs in ([(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids],
                      [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in ((i, self.b.id_to_piece(i)) for i in self.b.encode(text))]):
            if b"".join(x for _, x in pairs) != raw:
                return None
            at, spans = 0, []
            for i, x in pairs:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    def align(self, texts):
        """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
        rows, held = [], Counter()
        for t in texts:
            both = self.spans(t) if t else None
            if both is None:
                rows.append(None)
                continue
            a, b = both
            links = Counter((i, j) for i, s, e in a for j, x, y in b if s < y and x < e) if len(a) < 300 else self.near(a, b)
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            names, before = [], 0
            for c in cuts:
                names.append("|".join(",".join(str(i) for i, s, e in side if before <= s and e <= c) for side in both) if len(cuts) < 300 else (before, c))
                before = c
            if len(cuts) >= 300:
                names = self.names(both, cuts)
            held.update(links.keys())
            rows.append((len(a), len(b), len(cuts), links, ";".join(names)))
        most = {}
        for (i, _), n in held.items():
            most[i] = max(most.get(i, 0), n)
        zero = (0, 0, 0, 0, 0, 0, "")
        return [zero if r is None else (*r[:3], sum(r[3].values()), sum(n for p, n in r[3].items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in r[3].items()), r[4]) for r in rows]

    @staticmethod
    def near(a, b):
        links, k = Counter(), 0
        for i, s, e in a:
            while b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links[i, b[j][0]] += 1
                j += 1
        return links

    @staticmethod
    def names(both, cuts):
        out = [[[], []] for _ in cuts]
        for side in (0, 1):
            k = 0
            for i, _, e in both[side]:
                while e > cuts[k]:
                    k += 1
                out[k][side].append(str(i))
        return ["|".join(map(",".join, g)) for g in out]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    signs = "ab cd  e\n\t'sS.,!?0123▁ éßñ漢字‍́אב🙂\0\xa0　<|endoftext|><s></s><unk>"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", "a", "▁", " ", "  ", "<|endoftext|>", "<s>x</s>", "x" * 5000, "the harbour " * 3000]


def test_random_texts(spark):
    texts = odd_texts(400)
    df = spark.createDataFrame([(i, t, 7, "chunk") for i, t in enumerate(texts)], "doc_id bigint, text string, n_a int, chunk string").repartition(3)
    want = Brute().align(texts)
    got = {r.doc_id: tuple(r)[1:] for r in token_align.align(df, A, B, slice_bytes=2000).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] > 0 for w in want) > 100


def test_query(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: w for r, w in zip(rows, Brute().align([r["text"] for r in rows]), strict=True)}
    got = QUERIES["op12_token_align"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[1:] == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")


def test_repeated_rows_and_nulls(spark):
    texts = ["the cat", "the cat", None, "", "▁", "the dog"]
    ids = [1, 1, 2, None, None, None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    want = Brute().align(texts)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, token_align.align(df, A, B).collect()), key=key) == sorted(((i, *w) for i, w in zip(ids, want)), key=key)
    assert token_align.align(df.limit(0), A, B).collect() == []
    assert [tuple(r) for r in token_align.align(df.where("text is null"), A, B).collect()] == [(2, 0, 0, 0, 0, 0, 0, "")]


def test_coalesce():
    starts, ends = np.array([0, 0, 2, 3, 5, 5, 9]), np.array([2, 3, 5, 5, 9, 6, 10])
    assert token_align.coalesce(starts, ends).tolist() == [0, 0, 0, 0, 1, 1, 2]
    a, b = token_align.overlaps(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)]
    assert [x.tolist() for x in token_align.groups_of(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))] == [[0, 0, 1], [0, 0, 1, 1]]
