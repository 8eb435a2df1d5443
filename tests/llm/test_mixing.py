import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from wayfold.llm import mixing
from wayfold.llm.mixing import mix, mix_by_row, mixed_documents, split_quotas, targets, with_draws
from wayfold.llm.queries import op4_weighted_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    w = [1 + i % 3 for i in range(len(sizes))]
    t = targets(sizes, w)
    assert sum(t) == pytest.approx(sum(sizes))
    assert all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    free = [x / v for x, s, v in zip(t, sizes, w, strict=True) if x < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def test_split_is_exact():
    q = np.array([0, 5, 1000, 333])
    out = split_quotas(q, 7, 3)
    assert (out.sum(axis=0) == q).all()
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 3
    assert (out == split_quotas(q, 7, 3)).all()


def check(docs):
    rows = mix(docs, shards=4).collect()
    size = lambda t: len(WORD.findall(t or ""))
    src = docs.collect()
    total, taken, target = Counter(), Counter(), {}
    for r in src:
        total[r.source] += size(r.text)
    for r in rows:
        assert r.mix_size == size(r.text) and r.mix_source_size == total[r.source]
        assert 0 <= r.mix_taken <= r.mix_size and (r.mix_taken == 0 or 0 <= r.mix_shard < 4)
        taken[r.source] += r.mix_taken
        target[r.source] = r.mix_target
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    for s, t in zip(order, targets([total[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.5 + 1e-9
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.mix_taken
    assert {r.doc_id for r in rows} == {r.doc_id for r in src}
    return rows, whole


def test_whole_table(docs):
    rows, whole = check(docs)
    size = {r.doc_id: r.mix_size for r in rows}
    assert all(whole[i] <= 3 * size[i] for i in size)
    again = sorted(map(str, mix(docs.repartition(3), shards=4).collect()))
    assert again == sorted(map(str, rows))


def test_mixed_documents(docs):
    drawn = Counter((r.doc_id, r.mix_taken) for r in mix(docs).collect() if r.mix_taken)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r.doc_id, len(WORD.findall(r.text))) for r in got) == drawn
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in got)


def test_odd_rows(odd_docs, no_docs):
    rows, _ = check(odd_docs)
    assert {c for c in odd_docs.columns if not c.startswith("mix_")} <= set(rows[0].asDict())
    assert mix(no_docs).count() == 0
    assert mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixed_documents(odd_docs).count() > 0


def test_registered_mix_tells_shards_and_places(spark, docs):
    """Every draw has a shard, and a shard's places run from 0 without gaps in its local order."""
    got = op4_weighted_mix(spark, "/root/testdata/sf0.001").collect()
    assert all(r.taken == sum(d["taken"] for d in r.draws) for r in got)
    placed = {(d["shard"], d["place"]): (r.doc_id, d["pass"]) for r in got for d in r.draws}
    rows = sorted((r for r in mix(docs).collect() if r.mix_taken), key=lambda r: (r.mix_shard, r.mix_order))
    assert [placed[k] for k in sorted(placed)] == [(r.doc_id, r.mix_pass) for r in rows] and len({s for s, _ in placed}) > 1
    for s in {s for s, _ in placed}:
        assert sorted(p for x, p in placed if x == s) == list(range(sum(x == s for x, _ in placed)))


def test_mixed_documents_lie_in_local_order(docs):
    rows = sorted((r for r in mix(docs).collect() if r.mix_taken), key=lambda r: (r.mix_shard, r.mix_order))
    assert [r.doc_id for r in mixed_documents(docs).collect()] == [r.doc_id for r in rows]


def test_rows_with_repeated_and_null_ids_stay_apart(spark):
    rows = [(1, "a b c", "s"), (1, "a b c d e f", "t"), (None, "a b", "s"), (None, "a b c d", "t"), (1, "a b c", "s")]
    got = with_draws(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id is None, r.size, r.source_size) for r in got) == [(False, 3, 8), (False, 3, 8), (False, 6, 10), (True, 2, 8), (True, 4, 10)]
    by = Counter()
    for r in got:
        by[r.source_size] += r.taken
    assert by == {8: 6, 10: 12}


def test_every_draw_comes_from_the_tree(docs, monkeypatch):
    """What is taken is what the shards' ranges hold: an independent replay of the draw, row by row."""
    rows = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(docs.where("doc_id % 9 = 0").selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "lang", "source", "n_chars"))
    got = mix_by_row(rows, shards=4).selectExpr("doc_id", "text", "source", "mix_size", "mix_target", "mix_draws", "xxhash64(doc_id, crc32(CAST(text AS BINARY)), 29) AS u").collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for own in by.values():
        total, target = sum(r.mix_size for r in own), own[0].mix_target
        passes = min(3, int(target // total))
        rest = max(0, round(target) - passes * total) if passes < 3 else 0
        blocks = -(-len(own) // max(256, int(len(own) ** 0.5) + 1))
        own.sort(key=lambda r: (r.u % blocks, r.u, str(r.doc_id)))
        left = rest
        for r in own:
            want = passes * r.mix_size + min(left, r.mix_size)
            left -= min(left, r.mix_size)
            alike = [x for x in own if (x.u, x.doc_id) == (r.u, r.doc_id)]
            if len(alike) == 1:
                assert sum(d["taken"] for d in r.mix_draws) == want
    monkeypatch.setattr(mixing, "split_quotas", lambda q, shards, seed: np.zeros((shards, len(q)), np.int64))
    assert mix(docs).where("mix_taken > 0").isEmpty()
