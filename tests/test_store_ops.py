import random

import numpy as np
from pyspark.sql import functions as F

from wayfold.operators import batches, namespaces


def log_of(spark, n, seed):
    """Operations on few keys, one of them in a third of all; null keys among them."""
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["get", "put", "delete", "search", "get", "put"]), rng.choice([0, 0, 0, 1, 2, 3, 4, None]), f"v{i}", [rng.random(), rng.random()])
        for i in range(n)
    ]
    held = [(k, f"held{k}", [k / 5, 0.5]) for k in (0, 2, 7)]
    return held, rows, spark.createDataFrame(held, "key long, value string, vector array<double>"), spark.createDataFrame(rows, "seq long, kind string, key long, value string, vector array<double>")


def one_by_one(held, rows, k):
    store = {key: (value, vector) for key, value, vector in held}
    got, found = {}, {}
    for seq, kind, key, value, vector in rows:
        if kind == "get":
            got[seq] = store.get(key, (None,))[0]
        elif kind == "put":
            store[key] = (value, vector)
        elif kind == "delete":
            store.pop(key, None)
        else:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, vector, strict=True)), o) for o, (_, v) in store.items() if o is not None)
            found[seq] = [(round(d, 9), o) for d, o in near[:k]]
    return got, found, store


def test_replay_equals_one_operation_after_the_other(spark, monkeypatch):
    held, rows, table, log = log_of(spark, 300, 1)
    got, found, store = one_by_one(held, rows, 2)
    for run in (batches.RUN, 17):
        monkeypatch.setattr(batches, "RUN", run)
        assert {r.seq: r.value for r in batches.gets(table, log).collect()} == got
        near = {}
        for r in batches.searches(table, log.where("kind <> 'search' OR true"), 2).where("key IS NOT NULL").orderBy("seq", "rank").collect():
            near.setdefault(r.seq, []).append((round(r.distance, 9), r.key))
        if None not in store:
            assert near == {k: v for k, v in found.items() if v}
    assert {r.key: (r.value, r.vector) for r in batches.remaining(table, log).collect()} == store


def test_unknown_kinds_are_told(spark):
    log = spark.createDataFrame([(0, "get", 1), (1, "upsert", 1), (2, None, 1)], "seq long, kind string, key long")
    known, rejected = batches.checked(log)
    assert [r.seq for r in known.collect()] == [0]
    assert sorted(r.reason for r in rejected.collect()) == ["Unknown operation type: undefined", "Unknown operation type: upsert"]


def vectors_of(spark, n, seed, odd=True):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(3))) for i in range(n)]
    if odd:
        rows += [(n, None, 0), (n + 1, [1.0], 0), (n + 2, [float("nan")] * 6, 0)]
    return rows, spark.createDataFrame(rows, "key long, vector array<double>, label int")


def brute(rows, asks, k, keep=lambda r: True):
    ok = [r for r in rows if r[1] and len(r[1]) == 6 and not np.isnan(r[1]).any() and keep(r)]
    out = {}
    for a, v in asks:
        near = sorted((float(np.square(np.array(r[1]) - v).sum()), r[0]) for r in ok)
        out[a] = [key for _, key in near[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("ask", "rank").collect():
        out.setdefault(r.ask, []).append(r.key)
    return out


def test_exact_search_of_many(spark):
    rows, df = vectors_of(spark, 200, 2)
    asks = [(a, rows[a][1]) for a in range(0, 200, 20)]
    asked = spark.createDataFrame(asks, "ask long, vector array<double>")
    for slices in (1, 7):
        assert found(namespaces.search_many(df, asked, 4, {"label": {"!=": 1}}, slices)) == brute(rows, asks, 4, lambda r: r[2] != 1)
    assert namespaces.search_many(df.limit(0), asked, 4).count() == 0


def test_namespace(spark, tmp_path, monkeypatch):
    rows, df = vectors_of(spark, 400, 3)
    asks = [(a, rows[a][1]) for a in range(0, 400, 40)]
    asked = spark.createDataFrame(asks, "ask long, vector array<double>")
    kept = namespaces.VectorNamespace(spark, str(tmp_path))
    kept.build(df, lists=9, sample=100)
    assert kept.rows().count() == len(rows)
    monkeypatch.setattr(namespaces, "SLICE", 10)  # long lists fall into slices
    assert found(kept.search(asked, 5, 9)) == brute(rows, asks, 5)
    some = kept.search(asked, 5, 2)
    r = namespaces.recall(some, namespaces.search_many(df, asked, 5)).first()
    assert r.asks == 10 and r.wanted == 50 and 0.3 < r.recall < 1
    more = [(1000, [9.0] * 6, 1)]
    kept.append(spark.createDataFrame(more, df.schema))
    assert found(kept.search(spark.createDataFrame([(1, [9.0] * 6)], asked.schema), 1, 1)) == {1: [1000]}
    plan = kept.rows().where(F.col("list").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [" in plan and "list" in plan


def test_empty_namespace(spark, tmp_path):
    _, df = vectors_of(spark, 0, 1, odd=False)
    kept = namespaces.VectorNamespace(spark, str(tmp_path))
    kept.build(df)
    assert kept.centroids().shape[0] == 0


def test_a_search_meets_its_own_run_only(spark, monkeypatch):
    """Runs of few spans give what one run of all gives, and a block holds about two copies of a span."""
    held, rows, table, log = log_of(spark, 300, 3)
    log = log.where("key IS NOT NULL")
    sizes, near = [], []
    whole = batches.nearest_in_blocks

    def counted(dealt, asks, *args, **kwargs):
        sizes.append((dealt.count(), dealt.groupBy("run").count().agg({"count": "max"}).first()[0]))
        return whole(dealt, asks, *args, **kwargs)

    monkeypatch.setattr(batches, "nearest_in_blocks", counted)
    for least in (1_000_000, 8):
        monkeypatch.setattr(batches, "LEAST", least)
        near.append(sorted((r.seq, r.rank, r.key, round(r.distance, 9)) for r in batches.searches(table, log, 2).collect()))
    assert near[0] == near[1] and len(near[0]) > 50
    assert sizes[1][0] <= 3 * sizes[0][0] and sizes[1][1] < sizes[0][1] / 4
    assert batches.searches(table, log.where("kind <> 'search'"), 2).count() == 0


def test_parts_of_asks_and_ties(spark, tmp_path, monkeypatch):
    """Asks in parts meet every slice; copies go by key, and rows that a product of matrices cannot tell apart are measured."""
    rng = np.random.default_rng(9)
    near = [[1e6 + float(x), 0.0] for x in rng.normal(scale=1e-3, size=60)]
    vectors = near + [[5.0, 5.0]] * 20 + [[float("inf"), 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "key long, vector array<double>")
    asks = [(i, vectors[i]) for i in range(0, 80, 7)]
    asked = spark.createDataFrame(asks, "ask long, vector array<double>")
    want = {a: [k for _, k in sorted((sum((x - y) ** 2 for x, y in zip(o, v, strict=True)), k) for k, o in enumerate(vectors))[:6]] for a, v in asks}
    monkeypatch.setattr(namespaces, "ASKS", 3)
    for rows in (df, df.where("key < 80")):
        assert found(namespaces.search_many(rows, asked, 6)) == want
        assert found(namespaces.search_many(rows, asked, 6, slices=4)) == want
    blocks = []
    whole = namespaces.nearest_in_blocks
    monkeypatch.setattr(namespaces, "nearest_in_blocks", lambda d, a, on, k: blocks.append(a.groupBy(*on).count().agg({"count": "max"}).first()[0]) or whole(d, a, on, k))
    assert found(namespaces.search_many(df, asked, 6)) == want and blocks[0] < len(asks)
    kept = namespaces.VectorNamespace(spark, str(tmp_path))
    kept.build(df.where("key < 80"), lists=3)
    assert found(kept.search(asked, 6, 3)) == want


def test_searches_alike_are_measured_once(spark, monkeypatch):
    """Searches of few vectors measure a few rows for each vector and not the whole store for each search, and see what one after the other sees."""
    rng = np.random.default_rng(4)
    store, width = 3_000, 8
    m = np.concatenate([rng.normal(size=(store, width)), np.zeros((400, width))])
    m[store:] = m[rng.integers(0, 40, 400)]  # the same rows put again and again
    owner = np.concatenate([np.arange(store), rng.integers(0, 40, 400)])
    since = np.concatenate([np.full(store, -(2**63)), rng.integers(0, 5_000, 400)])
    until = np.concatenate([np.full(store, 2**63 - 1), since[store:] + rng.integers(1, 300, 400)])
    until[:40] = 0
    order = np.argsort(owner, kind="stable")
    owner, m, since, until = owner[order], m[order], since[order], until[order]
    seq = rng.permutation(5_000)[:1_000]
    q = rng.normal(size=(6, width))[rng.integers(0, 6, 1_000)]
    q[::3] = m[:2][rng.integers(0, 2, len(q[::3]))]  # some stand where rows come and go
    measured, whole = [], namespaces._measured
    monkeypatch.setattr(namespaces, "_measured", lambda a, b: measured.append(len(a)) or whole(a, b))
    for cells in (1 << 22, 50_000):
        monkeypatch.setattr(namespaces, "CELLS", cells)
        near = {}
        for asks, rows, d in namespaces._nearest_live(owner, m, since, until, q, seq, 3):
            for a, r, x in zip(asks.tolist(), rows.tolist(), d.tolist(), strict=True):
                near.setdefault(a, []).append((x, int(owner[r])))
        for i in range(len(q)):
            live = np.flatnonzero((since < seq[i]) & (seq[i] < until))
            assert near[i] == sorted(zip(np.square(m[live] - q[i]).sum(axis=1).tolist(), owner[live].tolist(), strict=True))[:3]
    assert sum(measured) < 2 * store  # 2 * 1,000 * 3,000 if every search measured what is held


def test_odd_searches(spark):
    """A store without rows, one without searches, a key held twice, which is one row, a search at the very number of a put, vectors of several lengths."""
    held = spark.createDataFrame([(1, "a", [0.0, 0.0]), (1, "b", [0.0, 0.0]), (2, "c", [3.0, 0.0]), (3, "d", [1.0]), (4, "e", None)], "key long, value string, vector array<double>")
    log = spark.createDataFrame(
        [(5, "search", 9, None, [1.0, 0.0]), (7, "put", 2, "f", [1.0, 0.0]), (7, "search", 9, None, [1.0, 0.0]), (8, "search", 9, None, [1.0, 0.0]), (9, "search", 9, None, [2.0])],
        "seq long, kind string, key long, value string, vector array<double>",
    )
    near = [(r.seq, r["rank"], r.key, r.distance) for r in batches.searches(held, log, 3).orderBy("seq", "rank").collect()]
    assert near == [(5, 1, 1, 1.0), (5, 2, 2, 4.0), (7, 1, 1, 1.0), (8, 1, 2, 0.0), (8, 2, 1, 1.0), (9, 1, 3, 1.0)]
    assert batches.searches(held.limit(0), log.where("kind = 'search'"), 3).count() == 0
    assert batches.searches(held, log.where("kind = 'put'"), 3).count() == 0


def test_many_searches_make_more_runs(spark, monkeypatch):
    """Many searches shorten the runs, and rows are not sent once more for each part of a run's searches."""
    _, _, table, log = log_of(spark, 300, 5)
    whole, blocks, near = batches.nearest_in_blocks, [], []

    def counted(dealt, asks, *args, **kwargs):
        blocks.append(asks.agg(F.countDistinct("run"), F.countDistinct("part")).first())
        return whole(dealt, asks, *args, **kwargs)

    monkeypatch.setattr(batches, "nearest_in_blocks", counted)
    for most in (batches.ASKS, 10):
        monkeypatch.setattr(batches, "ASKS", most)
        near.append(sorted((r.seq, r["rank"], -1 if r.key is None else r.key, round(r.distance, 9)) for r in batches.searches(table, log, 2).collect()))
    assert near[0] == near[1] and tuple(blocks[0]) == (1, 1)
    assert blocks[1][0] >= 4 and blocks[1][1] == 1
