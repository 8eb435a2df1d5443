import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold import api
from wayfold.operators import asof, decisions, markdown, rules, tabs, trees, upserts, vectors


# ------------------------------------------------------------------------ trees
def edges(spark, pairs):
    return spark.createDataFrame(pairs, "id string, parent_id string")


def test_multi_level_tree(spark):
    got = {r.id: (r.tree_id, r.depth) for r in trees.roots(edges(spark, [("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("x", "gone"), ("s", "s")])).collect()}
    assert got == {"r": ("r", 0), "a": ("r", 1), "b": ("r", 1), "c": ("r", 2), "x": ("x", 0), "s": ("s", 0)}


def test_hundred_nodes_and_a_chain(spark):
    heap = [(f"n{i}", f"n{i // 3}" if i else None) for i in range(100)]
    assert {r.tree_id for r in trees.roots(edges(spark, heap)).collect()} == {"n0"}
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(130)]
    assert {r.id: r.depth for r in trees.roots(edges(spark, chain)).collect()}["c129"] == 129


def test_cycle_raises(spark):
    for cycle in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("r", None)]):
        with pytest.raises(ValueError, match="cycle"):
            trees.roots(edges(spark, cycle)).collect()


def test_empty(spark):
    assert trees.roots(edges(spark, [])).count() == 0


def members(spark):
    rows = [("r", None, "r", "T0"), ("a", "r", "r", "T1"), ("b", "r", "r", "T2"), ("c", "a", "r", "T3"), ("q", None, "q", "T4"), ("z", "lost", "q", "T5")]
    return spark.createDataFrame(rows, "id string, parent_id string, tree_id string, page_loaded_at string")


def test_orders_and_recent(spark):
    m = members(spark)
    walk = [r.id for r in trees.preorder(m.where("id <> 'z'")).orderBy("tree_id", "path").collect()]
    assert walk == ["q", "r", "a", "c", "b"]
    assert [(r.id) for r in trees.orphan_roots(m).collect()] == ["z"]
    assert {r.tree_id for r in trees.recent(m, "q", 5).collect()} == {"r"} and {r.tree_id for r in api.recent_trees(m, limit=1).collect()} == {"q"}


def test_rounds_move_numbers_and_paths_stay_short(spark):
    """Columns ride along, numbers fit the edges, a path is an element a level, and siblings of one moment go by id."""
    rows = [("r", None, "T0"), ("b", "r", "T1"), ("a", "r", "T1"), ("c", "b", "T2"), ("x", "gone", "T3"), ("s", "s", "T4")] + [(f"d{i:03d}", "c" if i == 0 else f"d{i - 1:03d}", "T5") for i in range(70)]
    m = trees.rooted(spark.createDataFrame(rows, "id string, parent_id string, page_loaded_at string"), numbers=True)
    got = {r.id: r for r in m.collect()}
    assert got["d069"].tree_id == "r" and got["d069"].depth == 72 and got["x"].tree_id == "x" and got["s"].depth == 0
    for i, p, at in rows:
        r = got[i]
        assert r.page_loaded_at == at and r.top == got[r.tree_id].n and r.up == (got[p].n if p in got and p != i else None)
    path = {r.id: r.path for r in trees.preorder(m).collect()}
    assert len(path["d069"]) == 73 and path["a"] < path["b"] < path["c"] < path["d000"] < path["d069"] and path["r"] == [0]


VISITS = "id string, url string, referrer string, ts timestamp"


def visits(spark, rows):
    return spark.createDataFrame([(i, u, r, t) for i, u, r, t in rows], "id string, url string, referrer string, t long").select(
        "id", "url", "referrer", F.timestamp_seconds("t").alias("ts")
    )


def test_truncated_referrer_and_both_sides(spark):
    v = visits(spark, [("p", "https://e.com/page?q=1", None, 0), ("l", "https://e.com/page2", None, 420), ("k", "https://e.com/x", "https://e.com/page", 300)])
    assert {r.id: r.parent_id for r in asof.prefix_asof(v).collect()} == {"k": "p"}
    assert asof.nearest_lookup(v, "https://e.com/page", F.timestamp_seconds(F.lit(300))).first().id == "l"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "abc", "b", "bc"]), st.sampled_from([None, "", "a", "ab", "b", "z"]), st.integers(0, 300_000)), max_size=25))
def test_asof_equals_a_scan_in_any_order(spark, rows):
    rows = [(f"v{i:02}", u, r, t) for i, (u, r, t) in enumerate(rows)]
    want = {}
    for i, _, r, t in rows:
        if r:
            before = [(t2, i2) for i2, u2, _, t2 in rows if u2.startswith(r) and (t2, i2) < (t, i)]
            want[i] = max(before)[1] if before else None
    got = {r.id: r.parent_id for r in asof.prefix_asof(visits(spark, rows[::-1])).collect()}
    assert got == want


# ------------------------------------------------------------------------- tabs
def test_tab_zero_counts(spark):
    a = spark.createDataFrame([("c", 5, 0, 1, 1), ("p", 0, None, 2, 2), ("n", -1, 5, 3, 3)], "id string, tab_id long, opener_tab_id long, t long, event_id long").select(
        "id", "tab_id", "opener_tab_id", "event_id", F.timestamp_seconds("t").alias("ts"))
    assert [r.id for r in tabs.orphans(a).collect()] == ["c"]
    assert [tuple(r) for r in tabs.release(a).collect()] == [("c", "p")]


# ------------------------------------------------------------------------ rules
def leaf(field, comparator, value):
    return {"field": field, "comparator": comparator, "value": value}


PAGE = [("https://track.com/page1?x=12", "A Title", 0.9)]


@pytest.mark.parametrize(("condition", "hit"), [
    (leaf("url", "contains", "TRACK.COM"), True), (leaf("url", "starts_with", "http://"), False), (leaf("url", "ends_with", "12"), True),
    (leaf("url", "matches", r"PAGE\d\?x="), True), (leaf("title", "equals", "A Title"), True), (leaf("title", "equals", "a title"), False),
    (leaf("confidence", "greater_than", 0.5), True), (leaf("confidence", "less_than", "0.5"), False), (leaf("title", "greater_than", 1), False),
    (leaf("missing", "contains", "undef"), True), (leaf("missing", "equals", None), True), (leaf("url", "unknown", 1), False),
    ({"operator": "and", "conditions": []}, True), ({"operator": "or", "conditions": []}, False), ({"operator": "not", "conditions": []}, True),
    ({"operator": "not", "conditions": [leaf("url", "contains", "x")]}, False),
    ({"operator": "or", "conditions": [leaf("url", "contains", "no"), {"operator": "and", "conditions": [leaf("url", "contains", "track"), leaf("confidence", "greater_than", 0.1)]}]}, True),
    ({"operator": "and", **leaf("url", "contains", "nowhere")}, False),
])
def test_conditions(spark, condition, hit):
    p = spark.createDataFrame(PAGE, "url string, title string, confidence double")
    assert p.select(rules.compile_condition(json.dumps(condition), p.columns)).first()[0] is hit


def test_compat_leaf(spark):
    p = spark.createDataFrame(PAGE, "url string, title string, confidence double")
    assert p.select(rules.compile_condition({"operator": "and", **leaf("url", "contains", "nowhere")}, p.columns, compat_leaf_and=True)).first()[0]


def test_priority_stops(spark):
    p = spark.createDataFrame(PAGE, "url string, title string, confidence double")
    hit = leaf("url", "contains", ".com")
    rs = [
        {"id": "tag", "priority": 10, "condition": hit, "action": {"type": "tag", "value": "t"}}, {"id": "no", "priority": 100, "condition": hit, "action": {"type": "reject"}},
        {"id": "off", "priority": 200, "enabled": False, "condition": hit, "action": {"type": "accept"}},
        {"id": "early", "priority": 150, "condition": hit, "action": {"type": "tag", "value": "e"}},
    ]
    used = rules.applied(rules.matches(rs, p))
    o = p.select(rules.outcome(used).alias("o")).first().o
    assert (o.action, o.tags, o.boosts) == ("reject", ["e"], 0)
    assert p.select(rules.outcome(rules.applied(rules.matches([], p))).alias("o")).first().o.action is None
    again = rules.import_rules(rules.export_rules(rs))
    assert [r["id"] for r in again] != [r["id"] for r in rs] and all(r["usage_count"] == 0 for r in again)


def test_enhanced_decision(spark):
    cfg = decisions.FilterConfig()
    at = lambda outcome, model, conf, boosts=0: spark.range(1).select(decisions.enhanced_decision(
        F.lit("knowledge"), F.lit(conf), F.lit(model), F.lit(outcome).cast("string"), F.lit(boosts), F.lit(0.0), cfg).alias("d")).first().d
    assert at("reject", True, 0.9).decision is False and at("accept", False, 0.1).decision is True
    assert at(None, False, 0.8).decision is True and at(None, True, 0.65).decision is False and at(None, True, 0.65, 1).decision is True


# ---------------------------------------------------------------------- upserts
def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    want = [(1, "a"), (2, "y"), (3, "z")]
    once = upserts.upsert(t, c, ["k"], ["seq"])
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, upserts.upsert(once, c, ["k"], ["seq"]).collect()))
    assert [r.k for r in upserts.new_keys(t, c, ["k"]).collect()] == [3]
    old = spark.createDataFrame([("t", "10", "20")], "id string, first_load_time string, latest_activity_time string")
    new = spark.createDataFrame([("t", "05", "15"), ("u", "30", "30")], old.schema)
    assert sorted(map(tuple, upserts.upsert_trees(old, new).collect())) == [("t", "10", "20"), ("u", "30", "30")]
    assert [r.k for r in upserts.delete_keys(t, spark.createDataFrame([(1,)], "k int")).collect()] == [2]


# ---------------------------------------------------------------------- vectors
def test_search_and_store(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0], "u1", "t1", "c" * 300), (2, [3.0, 4.0], "u2", "t2", "d"), (3, [1.0, 0.0], "u3", "t3", "e")],
                                 "key long, vector array<double>, url string, title string, page_content string")
    assert [(r.key, r._distance) for r in vectors.search(rows, [0, 0], 2).collect()] == [(1, 0.0), (3, 1.0)]
    assert [r.key for r in vectors.search(rows, [0, 0], 9, {"url": {"!=": "u1"}, "key": {"<": 3}}).collect()] == [2]
    assert [r.key for r in vectors.search(rows, None, 2, {"url": "u3"}).collect()] == [3]
    with pytest.raises(ValueError):
        vectors.predicate({"url": {"like": "x"}})
    hit = api.semantic_search(rows, [0, 0], 1).first()
    assert (hit.id, hit.score, len(hit.preview)) == (1, 0.0, 203)
    w = spark.createDataFrame([(1, 0, False, "old"), (1, 1, False, "new"), (2, 0, False, "x"), (2, 1, True, None)], "key long, seq int, deleted boolean, v string").withColumn("written_at", F.lit(0).cast("timestamp"))
    assert [(r.key, r.v) for r in vectors.latest(w).collect()] == [(1, "new")]
    assert api.webpage_content(w, 1).first().v == "new" and api.webpage_content(w, 2).first() is None
    assert {r.key: r.v for r in vectors.multi_get(w, spark.createDataFrame([(1,), (2,), (9,)], "key long")).collect()} == {1: "new", 2: None, 9: None}
    names = spark.createDataFrame([("a/b/c",), ("a/b/d",), ("x",)], "name string")
    assert [r.name for r in vectors.namespaces(names, prefix="a", depth=2).collect()] == ["a/b"]


# --------------------------------------------------------------------- markdown
def test_markdown(spark):
    docs = spark.createDataFrame([(1, "# L\n## Pages\n\n- a\n  - x\n\n\n- b\n## Other\n- c\n"), (2, "## Pages")], "doc long, text string")
    b = markdown.section_blocks(docs, "## Pages")
    assert [(r.doc, r.position, r.block) for r in b.orderBy("position").collect()] == [(1, 0, "- a\n  - x"), (1, 1, "- b")]
    c = spark.createDataFrame([(1, 0, "- new"), (1, 1, "- b\n  - y")], b.schema)
    up = markdown.upsert_blocks(b, c)
    assert [r.block for r in up.orderBy("position").collect()] == ["- new", "- a\n  - x", "- b\n  - y"]
    again = markdown.section_blocks(markdown.render_section(up, "## Pages"), "## Pages")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, up.collect()))


def test_sql_is_read_only(spark):
    store = api.Store(spark, "/root/testdata/sf0.001")
    assert store.first("SELECT count(*) AS n FROM region WHERE r_regionkey >= ?", [2]).n == 3
    for bad in ("DROP TABLE region", "INSERT INTO region VALUES (1, 'x')", " create table t (a int)"):
        with pytest.raises(PermissionError):
            store.sql(bad)
    with pytest.raises(KeyError):
        store.table("secrets")


def test_no_write_hides_in_a_query(spark, tmp_path):
    """Inserts behind a common table expression, or behind FROM, are refused before they run."""
    from wayfold.api import Store

    store = Store(spark, "/root/testdata/sf0.001")
    out = tmp_path / "out"
    for bad in (
        f"WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT * FROM a",
        f"FROM VALUES (1) t(x) INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT x", "CREATE TABLE t AS SELECT 1 AS x", "SET a = 1",
    ):
        with pytest.raises(PermissionError):
            store.sql(bad)
    assert not out.exists()
    assert store.sql("WITH a AS (SELECT :x AS x) SELECT x FROM a", {"x": 3}).first()[0] == 3


def test_rules_compare_kinds_strictly_and_paths_may_miss(spark):
    p = spark.createDataFrame([("5", 5, {"b": "x"})], "t string, n int, s struct<b:string>")
    hit = lambda field, comparator, value: p.select(rules.compile_condition({"field": field, "comparator": comparator, "value": value}, p.schema)).first()[0]
    assert hit("n", "equals", 5) and hit("t", "equals", "5") and hit("s.b", "equals", "x") and hit("t", "greater_than", 4)
    for other in (("t", "equals", 5), ("n", "equals", "5"), ("s.c", "equals", "x"), ("s.b.d", "equals", "x"), ("t", "greater_than", "many"), ("t", "less_than", [1])):
        assert not hit(*other)


def test_visits_move_no_texts_that_others_make(spark):
    """The id and the time as text are made after the rows have been moved to their tabs, and edges keep wanted columns only."""
    from wayfold.plans import browsing
    from wayfold.sources import tables

    data = "/root/testdata/sf0.001"
    above, below = tables.visits(spark, data)._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)
    assert "md5(" in above and "md5(" not in below and "date_format(" not in below
    assert browsing.edges(spark, data, ["tab_id"]).columns == ["id", "tab_id", "parent_id"]
    want = {r.id: r.parent_id for r in browsing.edges(spark, data).collect()}
    assert {r.id: r.parent_id for r in browsing.edges(spark, data, []).collect()} == want


def test_trees_move_numbers_and_no_ids(spark):
    """Ids are made last: visits are kept without them, and what climbs to the roots are numbers."""
    from wayfold.plans import browsing

    v = browsing.numbered_visits(spark, "/root/testdata/sf0.001", ["tab_id"])
    assert dict(v.dtypes) == {"at": "bigint", "url": "string", "referrer": "string", "tab_id": "bigint", "n": "bigint"}
    found = browsing.links(v)
    assert {t for _, t in found.dtypes} == {t for _, t in trees.climbed(found).dtypes} == {"bigint"}


def test_visits_of_one_id_have_one_parent(spark, tmp_path):
    """Two tabs open one page in the same microsecond, from different pages: each visit is told once, with the latest parent, as in SQL."""
    import duckdb

    from wayfold.plans import browsing

    rows = [(0, 0, 1, "view", 1), (1, 10, 2, "click", 2), (2, 20, 1, "purchase", 3), (3, 20, 2, "purchase", 3), (4, 30, 1, "error", 4)]
    spark.createDataFrame([(i, t, u, k, json.dumps({"k": n})) for i, t, u, k, n in rows], "event_id long, t long, user_id long, event_type string, props string").select(
        "event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(map(repr, c.sql(f"WITH {browsing.EDGES} SELECT id, parent_id, tab_id FROM edges").fetchall()))
    assert sorted(repr(tuple(r)) for r in browsing.edges(spark, str(tmp_path), ["tab_id"]).select("id", "parent_id", "tab_id").collect()) == want
    assert browsing.members(spark, str(tmp_path), ["tab_id"]).count() == 5


def test_pages_are_joined_before_ids_are_made(spark):
    """By tab, visits move what their ids are made of; the ids, which no codec shortens, are made above the join with the pages."""
    from wayfold.plans import browsing

    above, below = browsing.tree_members_meta(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "md5(" in above and "md5(" not in below


@pytest.mark.parametrize("few", [0, 100_000])
def test_texts_by_number_or_as_they_are_give_the_same_parents(spark, monkeypatch, few):
    """Numbers stand for texts where those are few; visits without a URL and referrers that no URL begins with keep their rows."""
    moved = []
    monkeypatch.setattr(asof, "FEW", few)
    monkeypatch.setattr(asof, "kept", lambda df: moved.append(dict(df.dtypes)) or df.localCheckpoint())
    rows = [(1, 5, "a/b", None), (2, 6, "a/c", "a/"), (3, 7, None, "a/c"), (4, 7, "b", "none"), (5, 8, "a/c", ""), (6, 8, "a/d", "a/"), (7, 8, "a/e", "a/")]
    v = spark.createDataFrame(rows, "n long, at long, url string, referrer string")
    got = asof.last_earlier(v, "n", F.md5("url")).collect()
    # at moment 8 a/e, a/c and a/d are in the order of their hashes
    order = sorted(("a/c", "a/d", "a/e"), key=lambda u: hashlib.md5(u.encode()).hexdigest())
    number = {"a/c": 5, "a/d": 6, "a/e": 7}
    before = {number[u]: number[order[i - 1]] if i else 2 for i, u in enumerate(order)}
    assert {r.n: r.parent for r in got} == {2: 1, 3: 2, 4: None, 6: before[6], 7: before[7]} and len(got) == 5
    assert [m["k"] for m in moved if "k" in m] == ["bigint" if few else "string"]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_the_last_rounds_ask_for_few_rows(spark, monkeypatch, few):
    monkeypatch.setattr(trees, "FEW", few)
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100, 7), (101, 100), (201, 200)], "n long, up long")
    got = {r.n: (r.up, r.top, r.far) for r in trees.climbed(links).collect()}
    assert got == {i: (i - 1, 0, i) for i in range(1, 40)} | {100: (7, 0, 8), 101: (100, 0, 9), 201: (200, 200, 1)}
    with pytest.raises(ValueError):
        trees.climbed(links.union(spark.createDataFrame([(200, 201)], "n long, up long")))
