import base64
import json
import time

import zstandard
from pyspark.sql import functions as F

from wayfold.sources.ingest import parse_visits
from wayfold.sources.notes import note_table, read_notes
from wayfold.streaming import ingest, orphans


def message(url, at, **more):
    return json.dumps({"url": url, "page_loaded_at": at, **more})


def test_accepts_and_rejects(spark):
    packed = base64.b64encode(zstandard.compress(b"<p>hi</p>")).decode()
    rows = [message("https://e.com/", "2024-01-01T00:00:00Z", content=packed, tab_id=0), message("", "2024-01-01T00:00:00Z"), message("u", "soon"), "{broken"]
    good, bad = parse_visits(spark.createDataFrame([(r,) for r in rows], "value string"))
    g = good.collect()
    assert [(r.url, r.content, r.tab_id) for r in g] == [("https://e.com/", "<p>hi</p>", 0)]
    assert sorted(r.reason for r in bad.collect()) == ["not a visit object", "page_loaded_at is no time", "url is missing"]


def test_stream_is_idempotent_and_ordered(spark, tmp_path):
    for n in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(message(f"https://e.com/{i}", f"2024-01-01T00:0{5 - i}:00Z") for i in range(n, n + 3)))
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    good, _ = parse_visits(raw, decode=False)
    run = ingest.start(ingest.deduplicated(good), str(tmp_path / "out"), str(tmp_path / "log"))
    assert run.awaitTermination(120)
    assert sorted(r.url[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list("01234")
    seen = []
    run = ingest.each_batch(good, lambda b, n: seen.append([r.ts for r in b.collect()]), str(tmp_path / "log2"))
    assert run.awaitTermination(120)
    assert sum(map(len, seen)) == 9 and all(x == sorted(x) for x in seen)


def orphan_rows(spark, path, rows, n):
    spark.createDataFrame(rows, "id string, tab_id long, opener_tab_id long, t long").select(
        "id", "tab_id", "opener_tab_id", F.timestamp_seconds("t").alias("ts")
    ).coalesce(1).write.parquet(f"{path}/{n}.parquet")


def test_children_wait_for_parents(spark, tmp_path):
    orphan_rows(spark, tmp_path / "in", [("c0", 5, 0, 1), ("c1", 6, 9, 2)], 0)
    orphan_rows(spark, tmp_path / "in", [("p0", 0, None, 3), ("c2", 7, 0, 4)], 1)
    stream = spark.readStream.schema("id string, tab_id long, opener_tab_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    run = ingest.start(orphans.attach_orphans(stream), str(tmp_path / "out"), str(tmp_path / "log"))
    assert run.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.read.schema(orphans.OUT).parquet(str(tmp_path / "out")).collect())
    assert got == [("c0", "p0", "attached", 0), ("c2", "p0", "attached", 0)]


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, x):
        self.value = x

    update = put

    def clear(self):
        self.value = None


class Clock:
    now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_expiry_on_a_clock():
    """Timers with a clock under control: 60 s are not too old, more are; five retries are the last."""
    b, clock = orphans.OrphanBuffer(timers=True), Clock()
    b.parent, b.waiting, timers = State(), State(), []
    b.handle = type("H", (), {"registerTimer": lambda self, t: timers.append(t)})()
    b.waiting.put([("old", 0, 0), ("young", 59_000, 0), ("tired", 59_000, 4)])
    clock.now = 60_000
    assert [tuple(r)[:3] for r in next(b.handleExpiredTimer(None, clock, None)).itertuples(index=False)] == [("tired", None, "expired")]
    clock.now = 60_001
    assert [r.id for r in next(b.handleExpiredTimer(None, clock, None)).itertuples()] == ["old"]
    assert [w[0] for w in b.waiting.get()] == ["young"] and timers == [65_000, 65_001]


def test_windowed_counts(spark):
    v = spark.createDataFrame([(1,), (2,), (4000,)], "t long").select(F.timestamp_seconds("t").alias("ts"))
    assert sorted(r.n for r in ingest.windowed_counts(v).collect()) == [1, 2]


def test_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "old.md").write_text("# Old\nFirst note\n## A\n## B\n")
    time.sleep(1.1)
    (tmp_path / "sub" / "new.md").write_text("no heading " * 200)
    (tmp_path / "skip.txt").write_text("x")
    notes = {r.name: r for r in read_notes(spark, str(tmp_path)).collect()}
    assert set(notes) == {"old", "new"} and notes["old"].sections == ["A", "B"] and notes["old"].description == "First note"
    newest = read_notes(spark, str(tmp_path), limit=1)
    assert [r.name for r in newest.collect()] == ["new"]
    stored = note_table(newest).first()
    assert len(stored.body) == 1000 and stored.sections_string == "General"
