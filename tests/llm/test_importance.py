import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm.importance import importance_ranks, rank_best, resample, scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def runs(text, longest):
    words = WORDS.findall((text or "").translate(UPPER))
    out = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(x.encode()) for x in out]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(id, features, weight, score, rank) by counting."""
    own = [(i, t, *runs(t, longest)) for i, t in docs]
    s = Counter(c % buckets for *_, crc in own for c in crc)
    t = Counter(c % buckets for x in target for c in runs(x, longest)[1] for c in [c])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, text, words, crc in own:
        weight = math.floor(sum(gain(c % buckets) for c in crc) / len(crc)) if crc else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(crc), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {}
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        drawn.setdefault(r[0], []).append(n)
    return sorted(((*r[:4], drawn[r[0]].pop(0) if r[4] and drawn.get(r[0]) else None) for r in rows), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_the_ring_sees_every_run(longest):
    for text in ("", "one", "One two  THREE-four4 Été\x00日本 x", "a b " * 300, None):
        n, crc = scan(text, longest)
        words, want = runs(text, longest)
        assert n == words
        assert Counter(crc.tolist()) == Counter(want)


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 512)])
def test_matches_brute_force(spark, docs, longest, buckets):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = importance_ranks(docs, target, longest, buckets, percent=25)
    assert rows_of(got) == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest, buckets, 25)


def test_ranks_of_many_rows_do_not_depend_on_partitions(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat(concat('w', id % 7, ' '), 20) AS text")
    target = spark.createDataFrame([("w1 w2 w2",), (None,)], "text string")
    want = brute([(r.doc_id, r.text) for r in df.collect()], ["w1 w2 w2"])
    assert rows_of(importance_ranks(df.repartition(1), target)) == want
    assert rows_of(importance_ranks(df.repartition(13), target)) == want


def test_ties_go_to_smaller_ids(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 - 1).alias("score"))
    for most in (0, 1, 333, 334, 700, 1000, 2000):
        best, low = rank_best(rows, most, [F.asc("doc_id")])
        want = sorted(range(1000), key=lambda i: (-(i % 3), i))
        assert [r.doc_id for r in best.orderBy("rank").collect()] == want[:most]
        assert sorted(r.doc_id for r in low.collect()) == sorted(want[most:])


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("wort text",), ("",), (None,)], "text string")
    got = importance_ranks(odd_docs, target, percent=50, least_words=1)
    assert rows_of(got) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], ["wort text"], percent=50, least=1)
    assert importance_ranks(no_docs, target).count() == 0
    nothing = importance_ranks(odd_docs, target.limit(0))
    assert nothing.count() == odd_docs.count()


def test_resample_keeps_whole_rows(spark, odd_docs):
    target = spark.createDataFrame([("same words",)], "text string")
    got = resample(odd_docs.withColumnsRenamed({"size": "rank", "shard": "weight"}), target, percent=50, least_words=1)
    want = importance_ranks(odd_docs, target, percent=50, least_words=1).where("rank IS NOT NULL")
    assert sorted((r["rank"], r.doc_id, r.weight) for r in got.collect()) == sorted((r["rank"], r.doc_id, r.weight) for r in want.collect())
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert all((r.doc_id, r.text) in texts for r in got.collect())
    assert "slot" in got.columns


def test_draw_leans_towards_the_target(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat(IF(id % 2 = 0, 'near words here ', 'far things there '), 10) AS text")
    target = spark.createDataFrame([("near words here " * 50,)], "text string")
    got = resample(df, target)
    assert got.count() == 400
    assert np.mean([r.doc_id % 2 == 0 for r in got.collect()]) > 0.7
