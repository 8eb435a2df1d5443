import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import line_dedup
from wayfold.llm.line_dedup import SQL, dedup_lines, dedup_passages


def brute(rows, least=50):
    """The definition, position by position: (key, text) -> cleaned lines."""
    lines = {k: t.split("\n") for k, t in rows if t is not None}
    weight = lambda x: max(1, len(x.encode().split()))
    windows = {}
    for k in sorted(lines):
        own = lines[k]
        for i in range(len(own)):
            total, j = 0, i
            while j < len(own) and total < least:
                total += weight(own[j])
                j += 1
            if total >= least:
                windows.setdefault(tuple(own[i:j]), []).append((k, i, j))
    gone = set()
    for places in windows.values():
        fk, fi, fj = places[0]
        for k, i, j in places[1:]:
            a, b, x, y = i, j, fi, fj
            total = 0
            while a > 0 and x > 0 and lines[k][a - 1] == lines[fk][x - 1] and total + weight(lines[k][a - 1]) < least:
                total += weight(lines[k][a - 1])
                a, x = a - 1, x - 1
            total = 0
            while b < len(lines[k]) and y < len(lines[fk]) and lines[k][b] == lines[fk][y] and total + weight(lines[k][b]) < least:
                total += weight(lines[k][b])
                b, y = b + 1, y + 1
            gone |= {(k, p) for p in range(a, b)}
    return {k: [x for p, x in enumerate(own) if (k, p) not in gone] for k, own in lines.items()}, gone


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 20, 34, 55, 70) for _ in range(3)] + [""]
    runs = [[rng.choice(pool) for _ in range(rng.randint(1, 8))] for _ in range(6)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 5)):
            own += rng.choice(runs) if rng.random() < 0.5 else [" ".join(f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, 40)))]
        rows.append((i, "\n".join(own)))
    return rows + [(60, "x\n" * 300), (61, "x\n" * 80)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_the_definition(spark, seed):
    rows = corpus(seed)
    want, gone = brute(rows)
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.text for k, r in got.items()} == {k: "\n".join(v) for k, v in want.items()}
    assert sum(r.n_removed for r in got.values()) == len(gone) > 0


def test_no_long_run_is_left(spark):
    """No line goes for good, and no repeated run of 50 words stays."""
    rows = corpus(4)
    out = [(r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    before, after = ({x for _, t in side for x in t.split("\n")} for side in (rows, out))
    assert before - {""} == after - {""}
    long = [x for _, t in out for x in t.split("\n") if len(x.split()) >= 50]
    assert len(long) == len(set(long))


def test_against_sql(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}'")
    want = sorted(c.sql(SQL).fetchall())
    got = sorted(tuple(r) for r in dedup_lines(spark.read.parquet(d)).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = dedup_lines(odd_docs)
    assert rows.columns == [c for c in odd_docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    got = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == odd_docs.count() and got[1].text is None and got[1].n_lines == 0 and got[2].text == "" and got[2].n_lines == 1
    assert dedup_lines(no_docs).count() == 0
    line = " ".join(f"v{i}" for i in range(60))
    again = [(None, line), (None, line), (3, line), (3, line), (3, f"{line}\nmore"), (4, f"a\n{line}\nb")]
    out = sorted((str(r.doc_id), r.text) for r in dedup_lines(spark.createDataFrame(again, "doc_id long, text string")).collect())
    assert out == sorted([("None", line), ("None", line), ("3", ""), ("3", ""), ("3", "more"), ("4", "a\nb")])


def brute_passages(rows, least=50):
    """The definition, word by word: (key, text) -> words that stay."""
    words = {k: t.split() for k, t in rows if t is not None}
    first, gone = {}, set()
    for k in sorted(words):
        for i in range(len(words[k]) - least + 1):
            fk, fi = first.setdefault(tuple(words[k][i : i + least]), (k, i))
            if fk != k or i - fi >= least:
                gone |= {(k, p) for p in range(i, i + least)}
    return {k: [w for p, w in enumerate(own) if (k, p) not in gone] for k, own in words.items()}, gone


@pytest.mark.parametrize("least", [50, 16, 5])
def test_passages_against_the_definition(spark, least):
    rng = random.Random(least)
    shared = [[f"w{rng.randint(0, 500)}" for _ in range(n)] for n in (4, 20, 49, 50, 51, 70, 130)] + [["x"] * 170, ["x", "y", "z"] * 60]
    rows = []
    for i in range(80):
        own = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(shared)
            a = rng.randint(0, len(part) // 4)
            own += part[a:] if rng.random() < 0.6 else [f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, 40))]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t "]) for w in own)))
    want, gone = brute_passages(rows, least)
    got = {r.doc_id: r for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
    assert {k: r.text.split() for k, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) == len(gone) > 0
    assert all(r.text == dict(rows)[k] for k, r in got.items() if not r.n_removed)


def test_a_passage_inside_lines_goes(spark):
    """Which line deduplication alone leaves: it shares its lines with other text."""
    passage = [f"p{i}" for i in range(60)]
    spread = " ".join(passage[:20]) + "\n" + " ".join(passage[20:])
    rows = [(1, f"one {' '.join(passage)} uno"), (2, f"two {spread} due\nend \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in dedup_lines(docs).collect()) == rows
    assert sorted(tuple(r) for r in dedup_passages(docs).collect()) == [(1, rows[0][1], 0), (2, "two due\nend \n", 60)]


def test_passages_odd_rows(spark, odd_docs, no_docs):
    rows = dedup_passages(odd_docs)
    assert rows.columns == [*odd_docs.columns, "n_removed"] and rows.count() == odd_docs.count()
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].text is None and got[2].text == "" and got[4].text == "wort " * 50
    assert dedup_passages(no_docs).count() == 0


def test_fewer_fingerprints_than_windows(spark):
    """Windows select lines, and neighbours share them; each window's own line of least hash is among those selected."""
    rng = np.random.default_rng(9)
    text = "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 9)) for _ in range(400))
    frame = spark.createDataFrame([(1, text), (2, "x\n" * 300), (3, "one " * 60)], "_id long, _text_ string")
    lines = frame.select("_id", F.xxhash64("_text_").alias("_text"), F.posexplode(F.split("_text_", "\n")).alias("pos", "line")).select(
        "_id", "_text", "pos", F.xxhash64("line").alias("h"), F.greatest(F.lit(1), F.size(F.split("line", " "))).alias("weight")
    )
    windows = line_dedup._windows(lines, 50).collect()
    picked = {(r._id, r["at"]): r.mark for r in line_dedup.selected(line_dedup._windows(lines, 50)).collect()}
    assert 0 < sum(i == 1 for i, _ in picked) < 0.5 * sum(w._id == 1 for w in windows)
    hashes = {(r._id, r.pos): r.h for r in lines.collect()}
    for w in windows:
        own = [hashes[w._id, w.pos + i] for i in range(len(w.run))]
        assert own == w.run and hashes[w._id, w["at"]] == min(own) == picked[w._id, w["at"]]
        assert w["at"] == w.pos + max(i for i, h in enumerate(own) if h == min(own))
