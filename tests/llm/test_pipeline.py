"""The pipeline against a plain Python version, stage by stage, and the SQL of the corpus queries."""
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import base_spans, near_duplicates, quality, repeats
from tokenizers import Tokenizer

import corpus_pipeline
from stocksmith.llm import quality_mcd as Q
from stocksmith.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(1)
    long = max(rows, key=lambda r: len(r[1]))
    passage = " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(60))
    extra = [(1000 + i, f"{r[1]} {passage} ending {i}", r[2], r[3], 0) for i, r in enumerate(rows[:25])]
    extra += [(2000, long[1], "en", "src0", 1), (2000, long[1], "en", "src0", 1), (2001, long[1] + " x", None, None, None), (2002, None, "en", "src0", 0), (2003, "", None, "", None), (None, rows[3][1], "en", "src0", 7)]
    return rows + extra


def by_hand(rows):
    """Each stage's rows, in plain Python."""
    stages = []
    kept = quality([(r[2], r[3], r[1]) for r in rows], Q.LEAST_SPREAD, Q.chi2_quantile(1 - Q.TAIL), Q.chi2_quantile(0.975), Q.consistency(0.75), Q.consistency(0.975))
    rows = [r for r, k in zip(rows, kept) if k]
    stages.append(rows)
    near = near_duplicates([(r[0], r[1]) for r in rows], 5)
    seen, left = set(), []
    for r, n in zip(rows, near):
        if n[3] and (r[0] is None or (r[0], r[1]) not in seen):
            seen.add((r[0], r[1]))
            left.append(r)
    rows = left
    stages.append(rows)
    cut = []
    for r, (_, gone) in zip(rows, repeats([(r[0], r[1]) for r in rows], 50, lambda t: (t or "").encode())):
        at, text = 0, ""
        for c in r[1] or "":
            n = len(c.encode())
            text += "" if any(gone[at:at + n]) else c
            at += n
        cut.append((r[0], text, r[2], r[3], len(text)))
    rows = cut
    stages.append(rows)
    masked = []
    for r in rows:
        text, at, out = r[1], 0, ""
        for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in base_spans(text).split(",") if x)):
            out += text[at:a] + "[secret]" if a >= at else ""
            at = max(at, b)
        text = out + text[at:]
        masked.append((r[0], text, r[2], r[3], len(text)))
    stages.append(masked)
    return stages


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def test_stages(spark, tmp_path):
    rows = documents(spark)
    os.makedirs(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "secret_scans", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    want = by_hand(rows)
    for k, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, want)):
        out = stage(spark, docs, f"{tmp_path}/in")
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert order(docs.collect()) == order(expected), name
    assert len(rows) > len(want[0]) > len(want[1]) and sum(len(r[1]) for r in want[2]) < sum(len(r[1] or "") for r in want[1])
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/in").collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {}
    for p in pieces:
        found.setdefault(p.doc_id, []).append(p)
    for doc_id, text, *_ in want[3]:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        own = sorted(found.pop(doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in own)
    assert not found


def test_empty_tables(spark, tmp_path):
    """No documents: every stage gives none, with its columns."""
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_clashing_columns(spark, tmp_path):
    """Stages carry columns of any name through."""
    rows = [(i, f"document {i} " + " ".join(f"w{j * 7 % (50 + i)}" for j in range(60)), "en", "s", "keep me", 5, i % 2 == 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept string, node int, grp boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "kept", "node", "grp"], name
    assert {(r.kept, r.node) for r in docs.collect()} <= {("keep me", 5)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert order(df.select(*columns).collect()) == order(found.fetchall())


def test_registered():
    from __spark_entry__ import oracle_sql, queries
    names = queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(k) for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(oracle_sql())
