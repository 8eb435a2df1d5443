import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import episodes, order, rules, trees


@pytest.mark.parametrize("descending", [False, True])
def test_numbered(spark, descending):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.choice([*range(40), None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    by = F.desc_nulls_last("t") if descending else F.asc_nulls_last("t")
    got = order.numbered(df, ["k"], F.floor(F.col("t") / 7), [by, F.asc("id")], descending=descending).collect()
    want, turn = {}, -1 if descending else 1
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, turn * (r[1] or 0), r[2]))):
            want[r[2]] = n
    assert {r.id: r.position for r in got} == want


def test_trees_hang_from_their_first_root(spark):
    """Four levels, a second root whose members go, a parent that is no member, and a hundred children of one parent."""
    rows = [("t", "root", None, "10"), ("t", "c2", "root", "30"), ("t", "c1", "root", "20"), ("t", "g", "c1", "40"), ("t", "other", "gone", "15"), ("t", "lost", "other", "16")]
    rows += [("s", "new-root", "not here", "05"), ("s", "kid", "new-root", "06")]
    rows += [("w", f"n{i}", f"n{i // 3}" if i else None, f"{i:03d}") for i in range(100)]
    got = trees.built(spark.createDataFrame(rows, "tree_id string, id string, parent_id string, page_loaded_at string")).collect()
    t = {r.id: (r.root_id, r.parent_id, r.nth) for r in got if r.tree_id == "t"}
    assert t == {"root": ("root", None, 0), "c1": ("root", "root", 0), "c2": ("root", "root", 1), "g": ("root", "c1", 0)}
    assert {r.id: r.root_id for r in got if r.tree_id == "s"} == {"new-root": "new-root", "kid": "new-root"}
    w = [r for r in got if r.tree_id == "w"]
    assert len(w) == 100 and {r.root_id for r in w} == {"n0"}


def test_a_tree_without_a_root_is_an_error(spark):
    rows = [("t", "a", "b", "1"), ("t", "b", "a", "2")]
    with pytest.raises(ValueError, match="cycle"):
        trees.built(spark.createDataFrame(rows, "tree_id string, id string, parent_id string, page_loaded_at string")).collect()


def test_review_without_pages_says_so(spark, tmp_path):
    schema = "id long, url string, domain string, page_type string, confidence double, original_decision boolean, reasoning string, correction_decision boolean, correction_type string, correction_explanation string, correction_timestamp timestamp, timestamp timestamp, title string"
    doc = episodes.review_document(spark.createDataFrame([], schema), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    lines = [r.line for r in doc.orderBy("section", "position").collect()]
    assert "*No accepted pages in the last 7 days*" in lines and "*No filtered pages in the last 48 hours*" in lines
    assert "Stats: 0 total pages | 0 corrections | 0.0% correction rate" in lines and "> Generated: 2024-01-02 03:04:05" in lines
    episodes.written(doc, str(tmp_path / "review"))
    text = [x for f in sorted((tmp_path / "review").glob("part-*")) for x in f.read_text().split("\n")[:-1]]
    assert text == lines


def test_blank_texts_are_zero_on_either_side(spark):
    df = spark.createDataFrame([(0, ""), (1, "  "), (2, "5"), (3, "x"), (4, None), (5, "-1")], "i int, f string")
    hit = lambda comparator, value: {r.i for r in df.where(rules.compile_condition({"field": "f", "comparator": comparator, "value": value}, df.schema)).collect()}
    assert hit("less_than", 1) == {0, 1, 5} and hit("greater_than", -1) == {0, 1, 2}
    assert hit("greater_than", "") == {2} and hit("less_than", " ") == {5} and hit("less_than", "many") == set()


def test_preceding_rows(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.randrange(30), i, f"p{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t int, id int, said string")
    got = {}
    for r in order.preceding(df, ["k"], F.floor(F.col("t") / 7), [F.asc("t"), F.asc("id")], 3, "id", ["said"]).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.said)
    want = {}
    for k, t, i, _ in rows:
        before = sorted(((r[1], r[2], r[3]) for r in rows if r[0] == k and (r[1], r[2]) < (t, i)), reverse=True)[:3]
        if before:
            want[i] = [b[2] for b in before]
    assert got == want


def test_only_numbers_climb_in_trees_from_their_first_root(spark):
    """Roots of one moment are told apart by the tie, and only (n, up) of visits of one tree are taken."""
    m = spark.createDataFrame([(1, "t", 5, "b"), (2, "t", 5, "a"), (3, "t", 6, "c"), (4, "t", 7, "d"), (5, "s", 1, "e")], "n long, tree_id string, at long, id string")
    got = trees.hung(m, spark.createDataFrame([(3, 2), (4, 1)], "n long, up long"), F.col("at"), ["at", "id"]).collect()
    assert sorted((r.n, r.up, r.root, r.nth) for r in got) == [(2, None, 2, 0), (3, 2, 2, 0), (5, None, 5, 0)]
