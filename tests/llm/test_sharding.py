import heapq
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm.sharding import lpt_counts, lpt_shards


def one_by_one(sizes, counts, shards):
    heap = [(0, j) for j in range(shards)]
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    for i, (s, n) in enumerate(zip(sizes, counts, strict=True)):
        for _ in range(n):
            load, j = heapq.heappop(heap)
            out[i, j] += 1
            heapq.heappush(heap, (load + s, j))
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 200), st.integers(1, 90), max_size=12), st.integers(1, 7))
def test_counts_equal_lpt_one_by_one(classes, shards):
    sizes = sorted(classes, reverse=True)
    counts = [classes[s] for s in sizes]
    assert (lpt_counts(sizes, counts, shards) == one_by_one(sizes, counts, shards)).all()


def check(docs, shards):
    rows = lpt_shards(docs, shards).collect()
    src = Counter((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) == sum(src.values())
    sizes = Counter()
    for r in rows:
        sizes[r.doc_id, r["size"], r.text_crc32] += 1
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    want = Counter()
    for (i, t), n in src.items():
        want[i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())] += n
    assert sizes == want
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    return rows


def test_whole_table(docs):
    rows = check(docs, 5)
    load, of_text = Counter(), {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        load[r.shard] += r["size"]
        assert of_text.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows) * 6


def test_odd_rows(odd_docs, no_docs):
    rows = check(odd_docs, 3)
    assert len({r.shard for r in rows if r.doc_id in (5, 6)}) == 1
    assert lpt_shards(no_docs).count() == 0
