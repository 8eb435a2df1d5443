from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import circulant_minhash as cm


def sets_of(rows, words):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    return out


def brute(rows, words, percent):
    s = sets_of(rows, words)
    up = {i: i for i, _ in s if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in combinations(s, 2):
        if a and b and i is not None and j is not None:
            n = len(a & b)
            if 100 * n >= percent * (len(a) + len(b) - n):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(a), root(i)) for i, a in s if i is not None}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(docs, words, percent):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    rows = cm.near_duplicates(docs, words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_clusters_of_edited_copies(spark):
    """Chains and stars of copies around the threshold, in buckets with many members."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    rows = []
    for i in range(160):
        t = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            t[at] = f"e{rng.integers(0, 40)}"
        rows.append((1000 - i, " ".join(t)))
    got = cm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_odd_rows(odd_docs, no_docs):
    rows = cm.near_duplicates(odd_docs, 3, 85).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert by[None].component_id is None and by[None].kept
    assert [by[i].component_id for i in (5, 6, 7)] == [5, 5, 5] and by[1].n_shingles == 0 and by[2].kept and by[3].kept
    assert by[4].n_shingles == 1
    assert cm.near_duplicates(no_docs).count() == 0
    left = cm.deduplicated(odd_docs, 3, 85)
    assert left.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [None, 1, 2, 3, 4, 5, 8]))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[200:1200]
    same = (cm.signature(a, 352) == cm.signature(b, 352)).mean()
    assert abs(same - 800 / 1200) < 0.1


def test_shingles_do_not_cross_documents():
    got = list(cm.shingle_sets(pa.array(["a b c", "d e f", None, "x", "a b c"]), 3))
    assert [len(x) for x in got] == [1, 1, 0, 1, 1] and got[0] == got[4] and got[0] != got[1]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(i), int(i + 1)) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 160, (30, 2))] + [(500, 500)]
    up = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    got = {r.node: r.component for r in cm.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in up.items() if k not in alone}


def test_bitmaps_never_bound_below_the_intersection():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    count = lambda x: int(np.unpackbits(x.view(np.uint8)).sum())
    for size, moved in ((1, 0), (1, 1), (160, 0), (160, 12), (160, 160), (3000, 300), (3000, 3000)):
        a, b = pool[:size], pool[moved : moved + size]
        x, y = cm.bitmap(a), cm.bitmap(b)
        bound = count(x & y) + min(size - count(x), size - count(y))
        assert size - moved <= bound <= size
        if size == 160 and moved:
            assert bound < size - moved / 2
    assert not cm.bitmap(pool[:0]).any() and len(cm.bitmap(pool)) == cm.BITMAP_WORDS


def test_many_copies_edited_apart(spark):
    """Copies below the threshold whose shingles others have too: bitmaps rule them out, and no link is lost."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(150)]
    rows = []
    for i in range(220):
        t = list(base)
        for at in rng.choice(150, rng.integers(2, 9), replace=False):
            t[at] = f"e{rng.integers(0, 3)}-{at}"
        rows.append((i, " ".join(t)))
    for words, percent in ((3, 85), (5, 80)):
        got = cm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words, percent)


def repeated_ids():
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    return text(), text(), text()


def test_links_of_rows_that_repeat_an_id(spark):
    """A row's links are those of its own text, also where another row has its id."""
    a, b, c = repeated_ids()
    got = cm.near_duplicates(spark.createDataFrame([(3, c), (5, a), (5, c + " more"), (9, a), (5, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [
        (3, 196, 3, True), (5, 196, 5, True), (5, 196, 5, True), (5, 197, 3, False), (9, 196, 5, False),
    ]


def test_no_text_is_lost_where_an_id_repeats(spark):
    a, b, c = repeated_ids()
    rows = [(3, b, "x"), (5, a, "x"), (5, b, "x"), (9, a, "x"), (5, a, "x"), (None, a, "y"), (None, a, "y"), (7, "", "z"), (7, "", "z"), (7, None, "z")]
    left = cm.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, t string"))
    assert left.columns == ["doc_id", "text", "t"]
    want = [(3, b, "x"), (5, a, "x"), (None, a, "y"), (None, a, "y"), (7, "", "z"), (7, None, "z")]
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in spark.createDataFrame(want, left.schema).collect())


def test_repeated_ids_against_brute_force(spark):
    """Every id occurs with several texts, some of them near copies of other ids' texts."""
    rng = np.random.default_rng(7)
    bases = [[f"b{j}-{x}" for x in range(120)] for j in range(6)]
    rows = []
    for i in range(90):
        t = list(bases[rng.integers(0, 6)])
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            t[at] = f"e{rng.integers(0, 2)}-{at}"
        rows.append((int(rng.integers(0, 40)), " ".join(t)))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    up = list(range(len(rows)))
    for _ in rows:  # the least id spreads along links until nothing changes
        for i in range(len(rows)):
            for j in range(len(rows)):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    up[i] = up[j] = min(up[i], up[j], key=lambda k: (rows[k][0], k))
        if all(up[up[i]] == up[i] for i in range(len(rows))):
            break
    want = sorted((d, len(s), rows[up[i]][0]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    got = cm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_documents_joined_only_through_a_row_without_an_id(spark):
    """A-M and M-B are links, A-B is none: 2 reaches 1 through a row without an id."""
    words = [f"w{x}" for x in range(200)]
    change = lambda at: [f"e{i}" if i in at else w for i, w in enumerate(words)]
    a, m, b = words, change({20, 60, 100}), change({20, 60, 100, 140, 160, 180})
    link = lambda x, y: (lambda s, t: 100 * len(s & t) / len(s | t))(*({tuple(w[i : i + 3]) for i in range(198)} for w in (x, y)))
    assert link(a, m) >= 85 and link(m, b) >= 85 and link(a, b) < 85
    rows = [(1, " ".join(a)), (None, " ".join(m)), (2, " ".join(b)), (None, " ".join(m)), (None, "all alone here")]
    got = cm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.component_id) == [(0, 1, True), (0, 1, True), (1, 1, True), (2, 1, False)]
    assert [(r.doc_id, r.kept) for r in got if r.component_id is None] == [(None, True)]
    left = cm.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 0, 1]


def test_missing_ids_against_brute_force(spark):
    """A third of the rows have no id; components are those of all rows."""
    rng = np.random.default_rng(17)
    bases = [[f"b{j}-{x}" for x in range(120)] for j in range(5)]
    rows = []
    for i in range(80):
        t = list(bases[rng.integers(0, 5)])
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            t[at] = f"e{rng.integers(0, 2)}-{at}"
        rows.append((None if rng.random() < 0.34 else i, " ".join(t)))
    own = [(10_000 + n if i is None else i, t) for n, (i, t) in enumerate(rows)]
    want = brute(own, 3, 85)
    got = cm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    named = lambda c: None if c >= 10_000 else c
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(
        str((i, want[j][0], named(want[j][1]))) for (i, _), (j, _) in zip(rows, own, strict=True)
    )
