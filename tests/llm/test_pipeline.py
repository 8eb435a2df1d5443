"""The pipeline over a small table against brute force, and the registered queries."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from wayfold.llm import cotrain, mixing
from wayfold.llm.queries import ORACLES, QUERIES

from .test_line_dedup import brute as brute_lines
from .test_near_dup import brute as brute_near

D = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    found = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, D)
        assert i == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found[name] = (before.collect(), docs.collect())

    before, after = found["quality_classifier"]
    good = {r.doc_id for r in cotrain.classify(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")).where("good").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert kept == good and len(kept) < len(before)
    assert sum(labels[i] for i in kept if i in labels) >= 0.98 * sum(labels.values())

    before, after = found["line_dedup"]
    want, _ = brute_lines([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {k: "\n".join(v) for k, v in want.items()}

    before, after = found["minhash_near_dedup"]
    parts = brute_near([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in parts.values()})

    before, after = found["source_mixing"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
    names = sorted(size)
    for s, t in zip(names, mixing.targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True):
        assert abs(taken[s] - t) <= 0.5 + 1e-9

    before, after = found["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 1024):
            part = ids[a : a + 1024]
            want[r.doc_id, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in after) == want
    full = Counter()
    for r in after:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 1024

    ran = corpus_pipeline.run(spark, D).collect()
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert Counter(map(piece, ran)) == want


def test_sequences_hold_their_tokens(spark):
    """The packed sequences can be written out from the last stage's result alone, also where an id repeats."""
    rows = [(1, "a first text"), (1, "another text under the same id"), (2, "long " * 1500), (None, None)]
    got = corpus_pipeline.window_packing(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((k, a, tuple(ids[a : a + 1024])) for a in range(0, len(ids), 1024))
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in got) == want
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids)
            at += r.length
        assert at <= 1024
