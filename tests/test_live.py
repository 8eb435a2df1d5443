"""Streams over several micro-batches: trees, orphans on event time, joins, merges."""

import random

import pandas as pd
from pyspark.sql import functions as F

from wayfold.operators.asof import prefix_nearest
from wayfold.streaming import ingest, orphans, trees
from wayfold.streaming.replay import replayed, rocksdb, run_through


def brute_trees(rows):
    """Visits one by one in time order, each owner's apart: id to (parent, tree)."""
    out, seen = {}, {}
    for visit, owner, t, url, referrer in sorted(rows, key=lambda r: (r[2], r[0])):
        if visit in out:
            continue
        past = seen.setdefault(owner, [])
        near = max(((-abs(t - p[2]), p[2], p[0]) for p in past if referrer and p[3].startswith(referrer)), default=None)
        out[visit] = (near[2], out[near[2]][1]) if near else (None, visit)
        past.append((visit, owner, t, url))
    return out


def visits_of(spark, rows):
    return spark.createDataFrame(rows, "id string, tab_id long, t long, url string, referrer string").select("id", "tab_id", "url", "referrer", F.timestamp_seconds("t").alias("ts"))


def browsing(n, seed):
    rng = random.Random(seed)
    urls = [f"https://{h}.org{p}" for h in ("a", "ab", "b") for p in ("", "/", "/x", "/x/y", "/xz?q=1")]
    return [(f"v{i:04d}", rng.randrange(3), 1000 + i // 2, rng.choice(urls), rng.choice([None, "", "https://a", "https://q.org/", *urls])) for i in range(n)]


def test_trees_by_micro_batches_and_after_a_restart(spark, tmp_path):
    """The first half, a restart from the checkpoint, the second half: the trees are those of all visits at once."""
    rows = browsing(120, 1)
    rows += [(*r[:2], r[2] + 500, *r[3:]) for r in rows[:5]]  # the same ids again, much later
    schema = visits_of(spark, rows).schema
    with rocksdb(spark):
        for half in (rows[:60], rows[60:]):
            for part in (half[:30], half[30:]):
                visits_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            ingest.start(trees.insert_into_trees(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.id: (r.parent_id, r.tree_id) for r in got.collect()} == brute_trees(rows)
    assert got.where("is_new").count() == 120 and got.where("NOT is_new").count() == 5
    times = {r.tree_id: (r.first_at, r.latest_at, r.members) for r in trees.kept_trees(got).collect()}
    for tree, (first, latest, members) in times.items():
        own = [r[2] for r in rows[:120] if brute_trees(rows)[r[0]][1] == tree]
        assert (first, latest, members) == (min(own) * 1_000_000, max(own) * 1_000_000, len(own))


def test_nodes_of_a_tree_of_several_levels(spark, tmp_path):
    """A root, two children, a grandchild; a referrer that nobody visited roots a tree of its own."""
    e = "https://example.com"
    rows = [("root", 1, 10, f"{e}/", None), ("c1", 1, 20, f"{e}/1", f"{e}/"), ("c2", 1, 30, f"{e}/2", f"{e}/"), ("g", 1, 40, "https://x.org/", f"{e}/1"), ("p", 1, 50, f"{e}/9", "https://phantom.net/")]
    with rocksdb(spark):
        got = run_through(trees.insert_into_trees(replayed(visits_of(spark, rows), str(tmp_path / "in"), "ts", 5)), str(tmp_path))
    # the referrer of c2 is a prefix of c1, which is nearer in time than the root
    assert {r.id: (r.parent_id, r.tree_id) for r in got.collect()} == {
        "root": (None, "root"), "c1": ("root", "root"), "c2": ("c1", "root"), "g": ("c1", "root"), "p": (None, "p"),
    }


class Held:
    """A state variable in memory that counts the calls it gets."""

    def __init__(self, calls):
        self.calls, self.rows, self.map = calls, [], {}

    def _call(self, result=None):
        self.calls.append(1)
        return result

    def exists(self):
        return self._call(bool(self.rows))

    def get(self):
        return self._call(iter(list(self.rows)))

    def appendValue(self, row):
        self._call(self.rows.append(row))

    def put(self, rows):
        self.rows = self._call(list(rows))

    def containsKey(self, key):
        return self._call(key in self.map)

    def getValue(self, key):
        return self._call(self.map[key])

    def updateValue(self, key, value):
        self._call(self.map.update({key: value}))

    def keys(self):
        return self._call(iter(list(self.map)))


class Handle:
    def __init__(self, calls):
        self.calls = calls

    def getListState(self, *_):
        return Held(self.calls)

    getMapState = getListState


def placed_in(rows, batches):
    """What the operator answers to one group's visits in so many micro-batches, and the calls to the state store that each takes."""
    got, calls, operator = {}, [], trees.TreeInsert()
    operator.init(Handle(calls))
    taken = []
    for i in range(batches):
        part = pd.DataFrame(rows[i * len(rows) // batches : (i + 1) * len(rows) // batches], columns=["id", "owner", "at", "url", "referrer"]).astype({"owner": str})
        before = len(calls)
        for out in operator.handleInputRows((0,), iter([part[:3], part[3:]]), None):
            for r in out.astype(object).where(out.notna(), None).itertuples():
                assert r.is_new == (r.id not in got)
                got.setdefault(r.id, (r.parent_id, r.tree_id))
        taken.append(len(calls) - before)
    return got, taken


def test_calls_to_the_state_store_do_not_grow_with_the_visits():
    for n in (60, 600):
        got, taken = placed_in(browsing(n, 6), 3)
        assert max(taken) <= 3 and got == brute_trees(browsing(n, 6))


def test_pieces_of_a_state_are_made_one():
    """More micro-batches than pieces, with ids that come again after that."""
    rows = browsing(3 * trees.PIECES, 7)
    got, taken = placed_in(rows + rows[:6], len(rows) // 2 + 3)
    assert got == brute_trees(rows) and max(taken) <= 3


def test_nearest_on_both_sides(spark):
    rng = random.Random(4)
    rows = [(f"v{i:03d}", 0, rng.randrange(0, 400_000, 1000), u, r) for i, (_, _, _, u, r) in enumerate(browsing(150, 3))]
    rows += [("same1", 0, 5000, "https://s.org/1", "https://s.org/"), ("same2", 0, 5000, "https://s.org/2", "https://s.org/"), ("same3", 0, 5000, "https://s.org/3", None)]
    want = {}
    for visit, _, t, _, referrer in rows:
        near = min(((abs(t - o[2]) * 1_000_000, o[0]) for o in rows if referrer and o[0] != visit and o[3].startswith(referrer)), default=None)
        if near:
            want[visit] = near
    for seconds in (86_400, 3_600, 10_000_000):
        got = {r.id: (r.gap_micros, r.parent_id) for r in prefix_nearest(visits_of(spark, rows), seconds).collect()}
        assert got == want
    assert prefix_nearest(visits_of(spark, rows).limit(0)).count() == 0


def lived(spark, tmp_path, rows, slices, **knobs):
    df = spark.createDataFrame(rows, "id string, tab_id long, opener_tab_id long, t long").select("id", "tab_id", "opener_tab_id", F.timestamp_millis(F.col("t") + 1_000_000_000).alias("ts"))
    with rocksdb(spark):
        got = run_through(orphans.orphan_timeline(replayed(df, str(tmp_path / "in"), "ts", slices), "1 second", **knobs), str(tmp_path))
    return sorted((r.id, r.parent_id, r.state, r.retries) for r in got.collect())


def test_sixty_seconds_are_not_too_old_and_more_are(spark, tmp_path):
    """Tabs 0 and -1 are tabs like others; a child of its parent's very moment is no orphan."""
    rows = [("c0", 50, 0, 0), ("p0", 0, None, 60_000), ("c1", 51, -1, 0), ("p1", -1, None, 60_001), ("now", 52, 7, 30_000), ("p7", 7, None, 30_000), ("late", 53, 8, 190_000), ("end", 99, None, 200_000)]
    got = lived(spark, tmp_path, rows, 5, ttl_ms=60_000, retry_ms=20_000, max_retries=9)
    assert got == [("c0", "p0", "attached", 3), ("c1", None, "expired", 3), ("now", "p7", "attached", 0)]


def test_five_retries_are_the_last(spark, tmp_path):
    rows = [("a", 50, 1, 0), ("pa", 1, None, 24_999), ("b", 51, 2, 0), ("pb", 2, None, 25_000), ("c", 52, 3, 0), ("pc", 3, None, 25_001), ("end", 99, None, 90_000)]
    assert lived(spark, tmp_path, rows, 6) == [("a", "pa", "attached", 4), ("b", "pb", "attached", 5), ("c", None, "expired", 5)]


def test_a_parent_is_forgotten_in_time(spark, tmp_path):
    rows = [("p", 1, None, 0), ("a", 50, 1, 5_000), ("b", 51, 1, 5_001), ("q", 2, None, 50_000), ("end", 99, None, 90_000)]
    assert lived(spark, tmp_path, rows, 4, parent_ttl_ms=5_000) == [("a", "p", "attached", 0), ("b", None, "expired", 5)]


def test_the_moment_after_the_last_expires(spark, tmp_path):
    """The watermark is one millisecond past the patience of a and at that of b."""
    rows = [("a", 50, 1, 0), ("b", 51, 2, 1), ("end", 99, None, 26_001)]
    assert lived(spark, tmp_path, rows, 3) == [("a", None, "expired", 5)]


def test_milliseconds_are_rounded(spark, tmp_path):
    """Half a millisecond goes up: 500 microseconds late is a retry's moment, and the child of the same millisecond is no orphan."""
    rows = [("p", 1, None, 10_000_400), ("c", 50, 1, 10_000_500), ("d", 51, 2, 10_000_499), ("q", 2, None, 10_000_501), ("e", 52, 3, 10_000_600), ("r", 3, None, 10_000_500)]
    df = spark.createDataFrame(rows, "id string, tab_id long, opener_tab_id long, t long").select("id", "tab_id", "opener_tab_id", F.timestamp_micros("t").alias("ts"))
    assert [r[0] for r in df.orderBy("id").select(orphans.millis(F.col("ts"))).collect()] == [10_001, 10_000, 10_001, 10_000, 10_001, 10_001]
    with rocksdb(spark):
        got = run_through(orphans.orphan_timeline(replayed(df, str(tmp_path / "in"), "ts", 1)), str(tmp_path))
    assert sorted((r.id, r.parent_id, r.retries, r.at) for r in got.collect()) == [("c", "p", 0, 10_001), ("d", "q", 0, 10_000), ("e", "r", 0, 10_001)]


def test_stats_after_eviction(spark):
    waiting = spark.createDataFrame([(0, 100), (0, 400), (-1, 399), (5, 1000)], "tab long, at long")
    got = {r.tab: (r.orphans, r.oldest_age_ms) for r in orphans.waiting_stats(waiting, F.lit(1000), 600).collect()}
    assert got == {0: (1, 600), 5: (1, 0)}


def test_a_replayed_batch_and_repeats_days_apart_change_nothing(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 0, 0), ("b", 1, 5), (None, 2, 6), (None, 2, 6), ("a", 9, 9_000_000), ("c", 3, 9_000_001)]
    df = spark.createDataFrame(rows, "id string, v long, t long").select("id", "v", F.timestamp_seconds("t").alias("ts"))
    stream = replayed(df, str(tmp_path / "in"), "ts", 4)
    out = str(tmp_path / "out")
    want = sorted([("None", 2), ("None", 2), ("a", 0), ("b", 1), ("c", 3)])
    for log in ("log", "log", "other"):  # another log: every batch runs once more
        ingest.merge_once(stream, out, str(tmp_path / log)).awaitTermination()
        assert sorted((str(r.id), r.v) for r in spark.read.parquet(out).collect()) == want


def test_late_rows_are_counted_and_the_queue_is_told(spark, tmp_path):
    for part in ([(1, 100), (2, 100_000)], [(3, 5), (4, 100_001)], [(5, 6), (6, 7)]):
        spark.createDataFrame(part, "id long, t long").select("id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = ingest.start(ingest.windowed_counts(stream, "1 hour", "10 minutes", "30 minutes"), str(tmp_path / "out"), str(tmp_path / "log"))
    run.awaitTermination()
    stats = ingest.queue_statistics(spark, run).agg(F.sum("rows_in").alias("rows"), F.max("dropped_late").alias("late"), F.max("state_rows").alias("held")).first()
    assert stats.rows == 6 and stats.late > 0 and stats.held >= 2
    # what is late for a batch was passed by the watermark before the last one: 1 and 3 count in two windows each, 5 and 6 do not
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 4


def test_held_rows_come_back_as_they_were():
    """Missing parents and URLs stay None, and moments whole numbers, as columns are made Python's at once."""
    import pyarrow as pa

    from wayfold.streaming import trees

    held = [("1", "a", None, "a", 1_704_067_211_172_425, "https://a/"), ("1", "b", "a", "a", -1, None), ("2", "é", None, "é", 0, None)]
    got = list(trees.rows_of(pa.table([pa.array(c, f.type) for c, f in zip(zip(*held), trees._HELD)], schema=trees._HELD)))
    assert got == held and {type(r[4]) for r in got} == {int}
    assert list(trees.rows_of(trees._HELD.empty_table())) == []
