import pytest
from pyspark.sql import functions as F

from wayfold.llm import cotrain


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    teach, hold = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = cotrain.classify(docs, teach).join(hold, "doc_id").select("good", "quality", "score").collect()
    assert len(got) > 100
    assert sum(r.good == (r.quality == 1) for r in got) / len(got) >= 0.97
    assert sum(r.good for r in got if r.quality) / sum(r.quality for r in got) >= 0.99


def test_pseudo_labels_teach_the_other_view(spark):
    rows = [(i, ("@@ ## $$ " if i % 2 else "plain words of prose ") * (3 + i % 7), "en", "bad" if i % 2 else "fine", 50) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    one, more = cotrain.fit(docs, labels, rounds=0), cotrain.fit(docs, labels, rounds=2)
    assert one.fitted and more.fitted
    assert (one.weights[1] != more.weights[1]).any()
    got = cotrain.classify(docs, labels).collect()
    assert all(r.good == (r.doc_id % 2 == 0) for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 0, 0), (1, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = cotrain.classify(odd_docs, labels)
    assert rows.columns == [c for c in odd_docs.columns if c not in ("score", "good")] + ["content_score", "meta_score", "score", "good"]
    assert all(r.good and r.score == 0.5 for r in rows.collect())  # one class only: unfitted
    both = labels.union(spark.createDataFrame([(i, i % 2, 0) for i in range(9)], labels.schema))
    assert cotrain.classify(odd_docs, both).count() == odd_docs.count()
    assert cotrain.classify(no_docs, both).count() == 0
    assert all(r.score == 0.5 for r in cotrain.classify(odd_docs, labels.limit(0)).collect())


@pytest.mark.parametrize("side", [0, 1])
def test_a_class_on_one_side_of_the_hold_out(spark, side):
    """Labels of both classes are enough, also where no row (0) or every row (1) of the rare class is held out."""
    rows = [(i, ("@@ ## $$ " if i % 2 else "plain words of prose ") * (3 + i % 7), "en", "bad" if i % 2 else "fine", 50) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held = {r[0] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).select("doc_id").collect()}
    rare = [i for i in range(1, 400, 2) if (i in held) == bool(side)][:6]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(i, 0, 0) for i in rare], "doc_id long, quality int, toxic int")
    assert cotrain.fit(docs, labels).fitted
    assert all(r.good == (r.doc_id % 2 == 0) for r in cotrain.classify(docs, labels).collect())


def test_warns_without_both_classes(spark, odd_docs):
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="both classes"):
        assert not cotrain.fit(odd_docs, labels).fitted
