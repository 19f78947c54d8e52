"""Operators 3, 6 and 7 against brute force on random texts with repeats, ties, nulls and clashing columns."""
import random

import pytest
from brute import WORD, near_duplicates, repeats

from stocksmith.llm import cover_anchors, induced_suffix, odd_sketch
from stocksmith.llm.components import components

SCHEMA = "doc_id bigint, text string, node string, chunk int, kept boolean, z binary, n_words bigint"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "n", 1, True, None, None) for d, t in docs], SCHEMA)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def pieces(rng, alphabet, n, joiner):
    base = [rng.choice(alphabet) for _ in range(500)]
    docs = []
    for i in range(n):
        part = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(500)
            part += base[a:a + rng.randint(1, 120)] + [rng.choice("xyz") for _ in range(rng.randint(0, 2))]
        docs.append((rng.choice([i, i, i, 7, None]), joiner(rng).join(part)))
    return docs + [(99, None), (None, None), (100, ""), (3, joiner(rng).join(base)), (3, joiner(rng).join(base)), (200, " \n\t "), (201, "a" * 400), (202, "a" * 90)]


@pytest.mark.parametrize("seed", [1, 2])
def test_cover_anchors(spark, seed):
    docs = pieces(random.Random(seed), "abé", 60, lambda r: r.choice([" ", "\t", "\n "]))
    got = cover_anchors.remove_repeats(frame(spark, docs), length=20, period=7, chunk_bytes=2000).collect()
    want = [(d, len(u), sum(g), " ".join(x for x, y in zip(u, g) if not y)) for (d, _), (u, g) in zip(docs, repeats(docs, 20, lambda t: WORD.findall(t or "")))]
    assert order(map(tuple, got)) == order(want)
    assert sum(w[2] for w in want) > 0


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_sums_confuse(spark, n):
    """A Thue-Morse word and its complement have equal sums of letter * base**place modulo 2**64 for any odd base."""
    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    rest = [f"w{i}" for i in range(60)]
    docs = [(1, one), (2, two), (3, " ".join([*rest[:30], one, *rest[30:]])), (4, " ".join([*rest[:30], two, *rest[30:]])), (5, " ".join([one] * 25 + [two] * 30)), (6, " ".join([two] * 25 + [one] * 30)),
            (7, thue_morse(64, "a ", "b ")), (8, thue_morse(64, "b ", "a "))]
    got = cover_anchors.remove_repeats(frame(spark, docs)).collect()
    assert order((r.doc_id, r.n_removed) for r in got) == [(d, sum(g)) for (d, _), (_, g) in zip(docs, repeats(docs, 50, lambda t: WORD.findall(t)))]
    for words in (2, 5):
        got = odd_sketch.near_duplicates(frame(spark, docs), words=words).collect()
        assert order(map(tuple, got)) == order(near_duplicates(docs, words))
    got = induced_suffix.remove_repeats(frame(spark, docs)).collect()
    assert order((r.doc_id, r.n_removed) for r in got) == [(d, sum(g)) for (d, _), (_, g) in zip(docs, repeats(docs, 50, lambda t: t.encode()))]


def test_run_hashes():
    """Runs have the same hash exactly if they have the same bytes, wherever they lie."""
    import numpy as np

    from stocksmith.llm.shards import run_hashes, window_hashes
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 2, 3000).astype(np.uint8)
    start = rng.integers(0, 2700, 20_000)
    size = rng.integers(0, 300, 20_000) * (rng.random(20_000) < 0.3) + rng.integers(0, 20, 20_000) % (3000 - start)
    size = np.minimum(size, 3000 - start)
    h = run_hashes(raw, start, size)
    of = {}
    for k, (a, n) in enumerate(zip(start.tolist(), size.tolist())):
        assert of.setdefault(raw[a:a + n].tobytes(), h[k]) == h[k]
    assert len(set(of.values())) == len(of)
    x = rng.integers(0, 2, 500).astype(np.uint64)
    for n in (1, 2, 5, 20, 50):
        w = window_hashes(x, n)
        same = {x[i:i + n].tobytes(): w[i] for i in range(501 - n)}
        assert len(w) == 501 - n and len(set(w.tolist())) == len(same) == len(set(same.values()))
    assert len(window_hashes(x[:3], 5)) == 0 == len(window_hashes(x[:0], 1))


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21, 31, 40])
def test_difference_cover(period):
    places = cover_anchors.difference_cover(period)
    assert {(a - b) % period for a in places for b in places} == set(range(period))
    assert period != 31 or len(places) == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_induced_suffix(spark, seed):
    docs = pieces(random.Random(seed), "abé", 70, lambda r: "")
    got = induced_suffix.remove_repeats(frame(spark, docs), length=24, gram=11, chunk_bytes=2000).collect()
    want, cut = [], []
    for (d, t), (u, g) in zip(docs, repeats(docs, 24, lambda t: (t or "").encode())):
        spans = sum(y and not (i and g[i - 1]) for i, y in enumerate(g))
        want.append((d, len(u), sum(g), spans, bytes(x for x, y in zip(u, g) if not y)))
        at, left = 0, ""
        for c in t or "":
            n = len(c.encode())
            left += "" if any(g[at:at + n]) else c
            at += n
        cut.append((d, left))
    assert order((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == order(want)
    assert sum(w[2] for w in want) > 0
    df = frame(spark, docs)
    out = induced_suffix.cut_repeats(df, length=24, gram=11, chunk_bytes=2000)
    assert out.dtypes == df.dtypes
    rows = out.collect()
    assert order((r.doc_id, r.text) for r in rows) == order(cut)
    assert all((r.node, r.chunk, r.kept, r.z, r.n_words) == ("n", 1, True, None, None) for r in rows)


def test_induced_suffix_splits_hot_keys(spark):
    """Hot keys: the same bytes go, and no bucket gets most runs of a shared passage."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    from stocksmith.llm.shards import hot_keys
    docs = pieces(random.Random(3), "abé", 70, lambda r: "")
    want = [(d, len(u), sum(g), bytes(x for x, y in zip(u, g) if not y)) for (d, _), (u, g) in zip(docs, repeats(docs, 24, lambda t: (t or "").encode()))]
    for hot_runs in (0, 8):
        got = induced_suffix.remove_repeats(frame(spark, docs), length=24, gram=11, chunk_bytes=2000, hot_runs=hot_runs).collect()
        assert order((r[0], r[1], r[2], bytes(r[4])) for r in got) == order(want)

    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 200, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 123, 60, dtype=np.uint8).tobytes() + passage + rng.integers(97, 123, 60, dtype=np.uint8).tobytes() for _ in range(2000)]
    press = zstandard.ZstdCompressor()
    chunks = [pa.table({"chunk": pa.array([c] * 200, pa.int32()), "doc_id": pa.array(range(c, 2000, 10), pa.int64()), "z": [press.compress(t) for t in texts[c::10]]}) for c in range(10)]
    packets = pa.concat_tables(induced_suffix._send_keys(t, 50, 27, 40) for t in chunks).to_pandas()
    most = {}
    for hot_runs in (100, 10**9):
        replies = pa.concat_tables(hot_keys(pa.Table.from_pandas(p, preserve_index=False), hot_runs) for _, p in packets.groupby("bucket"))
        runs = pa.concat_tables(induced_suffix._send_runs(t, replies.filter(pa.compute.equal(replies["chunk"], c)), 50, 27, 40) for c, t in enumerate(chunks)).to_pandas()
        counts = runs.groupby("bucket")["count"].sum()
        most[hot_runs] = counts.max() / counts.sum()
    assert most[100] < 0.05 < 0.2 < most[10**9]


@pytest.mark.parametrize("recur", [1, 2, 256])
def test_suffix_array(recur, monkeypatch):
    import numpy as np
    monkeypatch.setattr(induced_suffix, "RECUR", recur)
    rng = random.Random(recur)
    for k in range(400):
        t = [rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 60))]
        t += t[:rng.randint(0, 60)] if k % 2 else []
        got = induced_suffix.suffix_array(np.array(t, dtype=np.int64), 256).tolist()
        assert got == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("words,block", [(2, 4), (5, 512)])
def test_odd_sketch(spark, words, block):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 20, 60, 150]))]
        for i in range(rng.choice([1, 3, 40])):
            b = list(base)
            for _ in range(rng.randint(0, max(1, len(b) // 12))):
                b[rng.randrange(len(b))] = rng.choice(vocabulary)
            docs.append((len(docs) * 3 % 101 + len(docs), " ".join(b).upper() if i % 5 == 0 else "\n".join(b)))
    docs += [(9000, None), (9001, ""), (9002, "  "), (None, "x y z"), (None, docs[0][1]), (9003, docs[5][1]), (9003, docs[5][1])]
    df = frame(spark, docs)
    got = odd_sketch.near_duplicates(df, words=words, block=block).collect()
    want = near_duplicates(docs, words)
    assert order(map(tuple, got)) == order(want)
    assert sum(not w[3] for w in want) > 20
    left = odd_sketch.one_of_each(df, words=words)
    assert left.dtypes == df.dtypes
    once = {(d, t) for (d, t), w in zip(docs, want) if w[3] and d is not None}
    assert order((r.doc_id, r.text) for r in left.collect()) == order([*once, *((d, t) for d, t in docs if d is None)])


def test_sketch_estimates():
    """Sets of a known similarity stay under the bits allowed for it, dissimilar ones do not."""
    import numpy as np
    rng = np.random.default_rng(3)
    for similar in (0.85, 0.4):
        n, shared = 1000, round(2000 * similar / (1 + similar))
        h = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
        both = np.concatenate([np.sort(h[:n]), np.sort(h[n - shared:])])
        sketch = odd_sketch.odd_sketches(odd_sketch.minhashes(both, np.array([n, n]))).view(np.uint64)
        assert (int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) <= odd_sketch.most_bits(0.8)) == (similar > 0.8)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == least and len(got) == len(least)


def test_empty(spark):
    none = frame(spark, []).where("false")
    assert cover_anchors.remove_repeats(none).count() == 0
    assert induced_suffix.remove_repeats(none).count() == 0
    assert induced_suffix.cut_repeats(none).count() == 0
    assert odd_sketch.near_duplicates(none).count() == 0
    assert odd_sketch.one_of_each(none).count() == 0
