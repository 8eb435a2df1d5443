import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.functions import codec, providers
from wayfold.operators import documents
from wayfold.sources import bucketed, frames
from wayfold.streaming.replay import run_through


# ---------------------------------------------------------------------- frames
def framed(*bodies):
    return b"".join(struct.pack("<I", len(b)) + b for b in bodies)


@given(st.lists(st.binary(max_size=20), max_size=5), st.integers(0, 12))
def test_split_frames(bodies, cut):
    content = framed(*bodies)
    whole = list(frames.split_frames(content))
    assert len(whole) == len(bodies)
    for (value, reason), body in zip(whole, bodies, strict=True):
        assert reason == "frame is not UTF-8" if value is None else value.encode() == body
    part = list(frames.split_frames(content[: max(0, len(content) - cut)]))
    assert [x for x in part if x[1] not in ("frame cut short", "frame without a length")] == whole[: len(part) - (1 if part and part[-1][1] in ("frame cut short", "frame without a length") else 0)]


def test_frames_as_files_and_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(framed(b'{"a": 1}', "é日".encode(), b"\xff", b"") + b"\x05\x00")
    (folder / "b").write_bytes(struct.pack("<I", frames.MOST + 1) + b"x" * 50)
    (folder / "c").write_bytes(b"")
    want = sorted([(0, '{"a": 1}', None), (1, "é日", None), (2, None, "frame is not UTF-8"), (3, "", None), (4, None, "frame without a length"), (0, None, "frame too long")], key=str)
    got = frames.read_frames(spark, str(folder))
    assert sorted(((r.nth, r.value, r.reason) for r in got.collect()), key=str) == want
    streamed = run_through(frames.stream_frames(spark, str(folder), 1), str(tmp_path))
    assert sorted(((r.nth, r.value, r.reason) for r in streamed.collect()), key=str) == want


def test_written_frames_come_back(spark, tmp_path):
    texts = ["{}", "é 日本 \U0001f600", "x" * 70_000, "", "a\nb"]
    frames.write_frames(spark.createDataFrame([(t,) for t in [*texts, None]], "value string"), str(tmp_path / "f"))
    assert sorted(r.value for r in frames.read_frames(spark, str(tmp_path / "f")).collect()) == sorted(t + "\n" for t in texts)


def test_payloads_too_large_stay_packed(spark, monkeypatch):
    import base64

    import zstandard

    packed = base64.b64encode(zstandard.compress(b"a" * 5000)).decode()
    assert codec._decode(packed) == "a" * 5000
    monkeypatch.setattr(codec, "MOST", 4999)
    assert codec._decode(packed) == packed
    assert codec._decode("no base64!") == "no base64!" and codec._decode(None) is None


# ------------------------------------------------------------------- documents
def rewrite(text, heading, edits, between, at_end):
    """The edits one by one, a line at a time."""
    lines = text.split("\n")
    for kind, block, at_start in edits:
        start = next(i for i, x in enumerate(lines) if x.strip() == heading) + 2
        end = next((i for i in range(start, len(lines)) if lines[i].strip().startswith(("## ", "##\t")) and lines[i].strip() != heading), max(start, len(lines)))
        blocks, now, inside = [], None, False
        for x in lines[start:end]:
            if x.startswith("- ["):
                blocks += [now] if now else []
                now, inside = [x], True
            else:
                inside = inside and x.strip() != ""
                if inside:
                    now.append(x)
        blocks += [now] if now else []
        blocks = ["\n".join(b) for b in blocks]
        new = block.split("\n")[0]
        if kind == "delete":
            blocks = [b for b in blocks if b != block]
        elif kind == "upsert" and any(b.split("\n")[0] == new for b in blocks):
            blocks = [block if b.split("\n")[0] == new else b for b in blocks]
        else:
            blocks = [block, *blocks] if at_start else [*blocks, block]
        edits_of = [x for b in blocks for x in (*b.split("\n"), *([""] if between else []))]
        lines = [*lines[:start], *([""] if blocks else []), *edits_of, *([""] if at_end else []), *lines[end:]]
    return "\n".join(lines)


TEXTS = [
    "# T\n\n## Notes\n\n- [[a]]\n- [[b]]\n  - more\n\nloose line\n- [[a]]\n  - second\n\n## Next\n  tail  \n",
    "## Notes", "## Notes\n", "  ## Notes  \n\n- [x] y\nz\n## Notes\n- [[c]]\n##\tOther\n", "a\r\n## Notes\n\n\n### Sub\n- [[d]]",
]
EDITS = [("insert", "- [[new]]\n  - line", True), ("insert", "- [[end]]", False), ("upsert", "- [[a]]\n  - changed", True), ("upsert", "- [[fresh]]", False), ("delete", "- [[b]]\n  - more", True), ("delete", "- [[b]]", True)]


@pytest.mark.parametrize(("between", "at_end"), [(False, True), (True, False), (True, True), (False, False)])
def test_single_edits_line_by_line(spark, between, at_end):
    rows = [(f"{i}-{j}", t, e) for i, t in enumerate(TEXTS) for j, e in enumerate(EDITS)]
    docs = spark.createDataFrame([(d, t, 1) for d, t, _ in rows], "doc string, text string, keep int")
    edits = spark.createDataFrame([(d, 1, *e) for d, _, e in rows], "doc string, seq int, kind string, block string, at_start boolean")
    got = {r.doc: r.text for r in documents.edit_documents(docs, edits, "## Notes", between, at_end).collect()}
    assert got == {d: rewrite(t, "## Notes", [e], between, at_end) for d, t, e in rows}


def test_several_edits_and_untouched_documents(spark):
    docs = spark.createDataFrame([("a", TEXTS[0], 1), ("b", "no heading", 2), ("c", None, 3)], "doc string, text string, keep int")
    edits = spark.createDataFrame([("a", 2, "delete", "- [[a]]", True), ("a", 1, "insert", "- [[a]]", False), ("c", 1, "insert", "- [[x]]", None)], "doc string, seq int, kind string, block string, at_start boolean")
    got = {r.doc: (r.text, r.keep) for r in documents.edit_documents(docs, edits, "## Notes").collect()}
    assert got["b"] == ("no heading", 2) and got["c"] == (None, 3)
    section = documents.section_blocks(spark.createDataFrame([("a", got["a"][0])], "doc string, text string"), "## Notes").first().blocks
    assert section == ["- [[b]]\n  - more", "- [[a]]\n  - second"]


def test_missing_headings_and_unknown_edits_raise(spark):
    docs = spark.createDataFrame([("b", "no heading")], "doc string, text string")
    edit = lambda kind: spark.createDataFrame([("b", 1, kind, "- [[x]]", True)], "doc string, seq int, kind string, block string, at_start boolean")
    with pytest.raises(Exception, match="Section '## Notes' not found in b"):
        documents.edit_documents(docs, edit("insert"), "## Notes").collect()
    assert documents.edit_documents(docs, edit("insert"), "## Notes", required=False).first().text == "no heading"
    with pytest.raises(Exception, match="Unknown edit: move"):
        documents.edit_documents(docs, edit("move"), "## Notes", required=False).collect()
    with pytest.raises(Exception, match="not found"):
        documents.section_blocks(docs, "## Notes", required=True).collect()
    assert documents.section_blocks(docs, "## Notes").first().blocks is None


def test_documents_as_files(spark, tmp_path):
    rows = [(f"d{i}", t) for i, t in enumerate([*TEXTS, "", "\n\n", "é日"])]
    documents.save(spark.createDataFrame(rows, "doc string, text string"), str(tmp_path / "notes"))
    assert sorted(map(tuple, documents.load(spark, str(tmp_path / "notes")).collect())) == sorted(rows)


def test_files_of_frames_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    from wayfold.sources import frames

    monkeypatch.setattr(frames, "FRAMES", 10)
    frames.write_frames(spark.range(35).coalesce(1).selectExpr("concat('\"', id, '\"') AS value"), str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("part-*"))) == 4
    assert sorted(int(r.value.strip().strip('"')) for r in frames.read_frames(spark, str(tmp_path / "in")).collect()) == list(range(35))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    with frames.small_batches(spark, 1000):
        assert spark.conf.get(key).rstrip("b") == "1000"
    assert spark.conf.get(key) == old


def test_many_documents_share_files(spark, tmp_path):
    """Files do not grow with documents; names, line ends and line feeds of any kind come back, and so does the form of a file each."""
    rows = [(f"d/{i}", f"# {i}\r\n\n" * (i % 3)) for i in range(300)] + [("null", None)]
    docs = spark.createDataFrame(rows, "doc string, text string").repartition(3)
    documents.save(docs, str(tmp_path / "notes"))
    assert len(list((tmp_path / "notes").rglob("part-*"))) <= 3
    want = sorted((d, t or "") for d, t in rows)
    assert sorted(map(tuple, documents.load(spark, str(tmp_path / "notes")).collect())) == want
    documents.save_files(docs.where("doc < 'd/11'"), str(tmp_path / "each"))
    assert sorted(map(tuple, documents.load_files(spark, str(tmp_path / "each")).collect())) == [r for r in want if r[0] < "d/11"]


# ------------------------------------------------------------------- providers
class Counting:
    """Tells how often it was loaded in this worker, and fails on one page."""

    loaded = 0
    width = 2

    def __init__(self):
        type(self).loaded += 1

    def embed(self, texts):
        return np.array([[len(t or ""), type(self).loaded] for t in texts], dtype=float)

    def classify(self, urls, titles, contents):
        if any("bad" in c for c in contents):
            raise RuntimeError("no answer")
        return [("knowledge", 7.0, True, f"{len(c)}") for c in contents]


def test_providers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["x" * 3000, None, "bad", "words"])], "i long, t string").coalesce(1)
    one = {r.i: r.v for r in df.select("i", providers.embedding(spark, F.col("t"), Counting).alias("v")).collect()}
    assert [one[i][0] for i in range(4)] == [3000, 0, 3, 5] and len({v[1] for v in one.values()}) == 1
    c = {r.i: r.c for r in df.select("i", providers.classification(spark, F.lit("u"), F.lit(None).cast("string"), F.col("t"), Counting).alias("c")).collect()}
    assert (c[0].confidence, c[0].reasoning, c[1].reasoning) == (1.0, "2000", "0")
    assert (c[2].page_type, c[2].confidence, c[2].should_process) == ("other", 0.0, False) and "no answer" in c[2].reasoning
    assert c[3].page_type == "knowledge"
    assert df.limit(0).select(providers.embedding(spark, F.col("t")).alias("v")).count() == 0


def test_records_of_a_put(spark):
    values = spark.createDataFrame([("k", "Name", "about", ["A", "B"], "body"), ("l", None, None, None, None)], "key string, name string, description string, sections array<string>, body string")
    got = {r.key: r for r in providers.records(values, now=F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got["k"].sections_string == "A|||B" and got["k"].embedded_text == "Name about A|||B body"
    assert abs(sum(x * x for x in got["k"].vector) - 1) < 1e-9 and sum(got["l"].vector) == 0
    assert got["k"].created_at == got["k"].updated_at and got["l"].sections_string == ""


def test_buckets_are_not_shuffled(spark, tmp_path):
    a = spark.range(1000).select(F.when(F.col("id") % 9 != 0, F.col("id") % 50).alias("k"), "id")
    try:
        n = bucketed.save(a, "left_of_buckets", ["k"], 3, path=str(tmp_path / "a"))
        bucketed.save(a.withColumnRenamed("k", "k2"), "right_of_buckets", ["k2"], n, path=str(tmp_path / "b"))
        left, right = spark.table("left_of_buckets"), spark.table("right_of_buckets").groupBy("k2").agg(F.count("*").alias("n"))
        joined = left.join(right.hint("merge"), F.col("k") == F.col("k2"))
        assert bucketed.exchanges(joined) == [] and bucketed.exchanges(a.groupBy("k").count()) != []
        assert joined.count() == a.where("k IS NOT NULL").count()
    finally:
        bucketed.drop(spark, "left_of_buckets", "right_of_buckets")
