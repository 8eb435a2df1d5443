import base64
import hashlib

import pytest

from wayfold.llm import arc_convert as arc


@pytest.mark.parametrize("version", [1, 2])
def test_parse_both_versions(version):
    blocks = [arc.http_block(1, b"<p>\n\nhttp://x 1.1.1.1 2 text/html 5\nWARC/1.1\r\n\r\n</p>"), b"", arc.http_block(None, "é".encode())]
    content = arc.arc_header("f.arc", version) + b"\n" + b"".join(
        arc.arc_record(b"http://a b/\n", "20200102030405", b, version, "f.arc") + b"\n" for b in blocks
    )
    got = list(arc.parse_arc(content))
    assert [b for _, b in got] == blocks
    assert got[0][0]["URL"] == b"http://a%20b/%0A" and got[0][0]["Archive-date"] == b"20200102030405"
    assert set(got[0][0]) == set(arc.ARC_FIELDS[version])


@pytest.mark.parametrize("broken", [
    b"http://x 0.0.0.0 2020 text/html 3\nabc\n",
    arc.arc_header("f", 1) + b"\nhttp://x 0.0.0.0 2020 text/html 30\nabc\n",
    arc.arc_header("f", 1) + b"\nhttp://x 2020 text/html 3\nabc\n",
    arc.arc_header("f", 2) + b"\nhttp://x 0.0.0.0 2020 text/html 3\nabc\n",
    arc.arc_header("f", 1) + b"\nhttp://x 0.0.0.0 2020 text/html x\nabc\n",
])
def test_refuses_broken_files(broken):
    with pytest.raises(ValueError):
        list(arc.parse_arc(broken))


def test_dates_and_ids():
    assert arc.warc_date("20200102030405") == "2020-01-02T03:04:05Z"
    assert arc.warc_date("2020") == "2020-01-01T00:00:00Z"
    assert arc.warc_id(b"u", "d", "x", 1) == arc.warc_id(b"u", "d", "x", 1) != arc.warc_id(b"u", "d", "x", 2)


def check(pages):
    src = pages.select("page_id", "html").collect()
    largest = {}
    for r in src:
        p = (r.html or "").encode()
        if r.page_id is not None:
            largest[p] = max(r.page_id, largest.get(p, r.page_id))
    want = []
    for r in src:
        p = (r.html or "").encode()
        first = largest.get(p) if r.page_id is not None else None
        kind = "response" if first in (None, r.page_id) else "revisit"
        want.append((r.page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, first if kind == "revisit" else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in arc.archive_round_trip(pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_whole_table(spark, monkeypatch, most):
    monkeypatch.setattr(arc, "BROADCAST_BYTES", most)
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    check(p.unionByName(p.where("page_id < 9").selectExpr("page_id + 5000 AS page_id", "url", "html")))


def test_odd_rows(spark):
    rows = [
        (1, None, None), (2, "http://x y\n", ""), (None, "u", "h"), (3, "u", "h"), (4, "u", "h"), (4, "u", "h"), (5, "ü", "<b>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
        (-7, "u", "filedesc://x 1 2 3 4\n" * 50), (6, "u", "日本" * 70_000),
    ]
    odd = spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id long, url string, html string, record string, payload binary")
    check(odd)
    assert arc.archive_round_trip(odd.limit(0)).count() == 0


def archive(version=1, url=b"http://a b/\xc3\xbc"):
    blocks = [arc.http_block(i, f"page {i % 2}".encode()) for i in range(3)]
    head = arc.arc_header("f.arc", version)
    lines = [arc.arc_record(url, "20200102030405", b, version, "f.arc").replace(b"0.0.0.0", b"10.1.2.3") for b in blocks]
    dns = b"dns:a.org 10.1.2.3 20200102030405 text/dns 5\nA 1 2"
    return [head, *lines, *([dns] if version == 1 else [])]


@pytest.mark.parametrize("members", [1, 2, 9])
def test_gzip_of_any_number_of_members(spark, tmp_path, members):
    import gzip

    parts = archive()
    size = -(-len(parts) // members)
    data = b"".join(gzip.compress(b"".join(p + b"\n" for p in parts[i : i + size])) for i in range(0, len(parts), size))
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc.gz").write_bytes(data)
    assert arc.read_arc(spark, f"{tmp_path}/arc").count() == 4
    for bad in (data[:-3], data + b"xx"):
        with pytest.raises(ValueError):
            arc.unzip(bad)
    assert arc.unzip(data + b"\0" * 9) == b"".join(p + b"\n" for p in parts)


def test_warc_headers(spark, tmp_path):
    """Records open members of their own; other than ASCII URLs, IP addresses, dns records and what a file comes from are kept."""
    import zlib

    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc").write_bytes(b"".join(p + b"\n" for p in archive()))
    arc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    (file,) = [f for f in (tmp_path / "warc").glob("part-*") if f.stat().st_size]
    rest, starts = file.read_bytes(), []
    while rest:
        z = zlib.decompressobj(31)
        starts.append(z.decompress(rest)[:8])
        rest = z.unused_data
    assert starts == [b"WARC/1.1", b"\r\n\r\n"] * 5
    records = list(arc.parse_warc(arc.unzip(file.read_bytes())))
    assert [h["warc-type"] for h, _ in records] == [b"warcinfo", b"revisit", b"response", b"response", b"resource"]
    revisit, response = records[1][0], records[3][0]
    assert revisit["warc-refers-to-target-uri"] == response["warc-target-uri"] == b"http://a%20b/\xc3\xbc"
    assert revisit["warc-refers-to"] == response["warc-record-id"] and response["warc-ip-address"] == b"10.1.2.3"
    assert b"part-0.arc" in records[0][1] and "warc-ip-address" not in records[0][0]
    assert records[4][0]["content-type"] == b"text/dns" and records[4][1] == b"A 1 2"


def test_spaces_in_the_url_of_a_line():
    content = arc.arc_header("f", 1) + b"\nhttp://x/a b c 1.2.3.4 2020 text/html 3\nabc\n"
    assert next(arc.parse_arc(content))[0]["URL"] == b"http://x/a b c"


@pytest.mark.parametrize("name", ["IAH-20080430-00000-host.arc.gz", "a.arc", "deep/er/B.ARC.GZ", "part-00000"])
def test_archives_by_any_name(spark, tmp_path, name):
    records = [arc.arc_header("f.arc", 2), *(arc.arc_record(b"http://x/%d" % i, "20080430000000", arc.http_block(i, b"p%d" % (i // 2)), 2, "f.arc") for i in range(3))]
    content = b"\n".join(records) if name.endswith("arc") else b"".join(arc.member(r + b"\n") for r in records)
    file = tmp_path / "in" / name
    file.parent.mkdir(parents=True)
    file.write_bytes(content)
    (tmp_path / "in" / "index.cdx").write_text("not an archive")
    assert sorted(r.page_id for r in arc.read_arc(spark, str(tmp_path / "in")).collect()) == [0, 1, 2]
    arc.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in arc.read_warc(spark, str(tmp_path / "out")).collect())
    assert got == [(0, "revisit", 1), (1, "response", None), (2, "response", None)]


def test_a_folder_without_archives(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    for read in (arc.read_arc, arc.read_warc):
        with pytest.raises(FileNotFoundError, match="no archive"):
            read(spark, str(tmp_path))


def test_files_are_closed_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arc, "FILE_BYTES", 10_000)
    monkeypatch.setattr(arc, "RECORDS", 4)
    sizes = [9_000, 3_000, 30_000, 10, 20, 30, 40, 50, 60]
    rows = [(i, "http://x/", "x" * n) for i, n in enumerate(sizes)]
    arc.write_arc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "arc"))
    got = arc.read_arc(spark, str(tmp_path / "arc"))
    held = {}
    for r in got.collect():
        held.setdefault(r.path, []).append((r.nth, r.page_id, r.payload_bytes))
    assert sorted([p for _, p, _ in sorted(v)] for v in held.values()) == [[0], [1], [2], [3, 4, 5, 6], [7, 8]]
