"""Conversion of legacy ARC archives to WARC, and readers and writers for both."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove, scratch, ship

# Fixed values of the ARC file format: the field names of a record line, by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Records of an ARC file, and bytes of records after which it is closed.
RECORDS = 2048
FILE_BYTES = 32 << 20
#: Bytes up to which what revisits refer to is sent to every executor.
BROADCAST_BYTES = 64 << 20
# Fixed values of the file formats: how archives are named. Spark's own files have no suffix.
ARC_NAMES = "{part-*,*.[aA][rR][cC],*.[aA][rR][cC].[gG][zZ]}"
WARC_NAMES = "{part-*,*.[wW][aA][rR][cC],*.[wW][aA][rR][cC].[gG][zZ]}"
#: Compression of archives.
LEVEL = 3
ID_HEADER = "X-Page-Id"
HTTP = b"application/http; msgtype=response"
_BLANK = re.compile(rb"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------------ ARC
def arc_header(name: str, version: int) -> bytes:
    """The record that opens an ARC file and declares its version and fields."""
    body = f"{version} 0 wayfold\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line = [f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain"]
    line += ["200", "-", "-", "0", name] if version == 2 else []
    return " ".join([*line, str(len(body))]).encode() + b"\n" + body


def plain_url(url: bytes) -> bytes:
    """The URL with its white space and control bytes percent-encoded."""
    return _BLANK.sub(lambda m: b"%%%02X" % m[0][0], url)


def arc_record(url: bytes, date: str, block: bytes, version: int, name: str) -> bytes:
    """One record. The line needs a URL without white space and control bytes."""
    url = plain_url(url)
    middle = f" 0.0.0.0 {date} text/html"
    if version == 2:
        middle += f" 200 {hashlib.md5(block).hexdigest()} - 0 {name}"
    return url + f"{middle} {len(block)}\n".encode() + block


def parse_arc(content: bytes):
    """Yield (fields, block) of an ARC file's records, without the opening one.

    The opening record declares the version, 1 or 2, and so the fields of all lines
    after it. Fields are parted from the right, so a URL may hold spaces. A block is the
    declared number of bytes; line feeds between records are skipped. A line that does
    not fit its version, or a length beyond the file, raises ValueError.
    """
    at, version = 0, 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC record line without an end at {at}")
        line = content[at:end].rstrip(b"\r")
        try:
            length = int(line.rpartition(b" ")[2])
        except ValueError as e:
            raise ValueError(f"ARC record line without a length at {at}") from e
        block = content[end + 1 : end + 1 + length]
        if length < 0 or len(block) < length:
            raise ValueError(f"ARC record at {at} declares {length} bytes and has {len(block)}")
        opening = line.startswith(b"filedesc://")
        if opening:
            version = int(block.split(b" ", 1)[0])
        parts = line.rsplit(b" ", len(ARC_FIELDS.get(version, ())) - 1)
        if version not in ARC_FIELDS or len(parts) != len(ARC_FIELDS[version]):
            raise ValueError(f"ARC record line at {at} does not fit version {version}")
        if not opening:
            yield dict(zip(ARC_FIELDS[version], parts, strict=True)), block
        at = end + 1 + length


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"{ID_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def parse_http(block: bytes) -> tuple[int | None, bytes, bytes]:
    """(page id, header with its blank line, payload)."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    m = re.search(rf"(?mi)^{ID_HEADER}: (-?\d+)\r?$".encode(), head)
    return int(m[1]) if m else None, head + blank, payload


# ----------------------------------------------------------------------- WARC
def warc_id(url: bytes, date: str, payload_digest: str, page_id: int | None) -> str:
    """An identifier synthesised from what the ARC record says, so that reruns agree."""
    name = b"|".join([url, date.encode(), payload_digest.encode(), str(page_id).encode()])
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name.decode('latin-1'))}>"


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss as the WARC timestamp; shorter dates count from their start."""
    full = arc_date + "00000101000000"[len(arc_date) :]
    return datetime.strptime(full[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(kind: str, url: bytes, date: str, content_type: bytes, block: bytes, extra: list[tuple[str, str | bytes]]) -> bytes:
    """A record without the two line ends that close it; no URL, no target URI."""
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Date: {date}".encode()]
    if url:
        lines.append(b"WARC-Target-URI: " + url)
    lines += [k.encode() + b": " + (v if isinstance(v, bytes) else v.encode()) for k, v in extra]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}".encode(), b"Content-Type: " + content_type, f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def warc_info(arc_name: str) -> bytes:
    """The record that opens a WARC file's part: which ARC file the next ones come from."""
    body = f"software: wayfold\r\nformat: WARC File Format 1.1\r\nconverted-from: {arc_name}\r\n".encode()
    extra = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, arc_name)}>")]
    return warc_record("warcinfo", b"", "2024-01-01T00:00:00Z", b"application/warc-fields", body, extra)


def parse_warc(content: bytes):
    """Yield (headers, block) of a WARC file's records, by their declared lengths."""
    at = 0
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at {at}")
        headers = {}
        for line in content[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            headers[k.decode().lower()] = v.strip()
        length = int(headers[b"content-length".decode()])
        block = content[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"WARC record at {at} declares {length} bytes and has {len(block)}")
        yield headers, block
        at = end + 4 + length


# ----------------------------------------------------------------------- gzip
def member(data: bytes) -> bytes:
    """One gzip member. LEVEL trades time for size: pages come out 3 % larger than at 6, in 60 % of the time."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def unzip(content: bytes) -> bytes:
    """All members of a gzip file, one after the other; what is not gzip stays as it is.

    A member that is cut short, or other bytes than zeros after the last one, raise ValueError.
    """
    if content[:2] != b"\x1f\x8b":
        return content
    out, at, view = [], 0, memoryview(content)
    while at < len(content) and content[at : at + 1] != b"\0":
        z = zlib.decompressobj(31)
        while not z.eof:
            part = view[at : at + (1 << 14)]
            if not len(part):
                raise ValueError("gzip member cut short")
            try:
                out.append(z.decompress(part))
            except zlib.error as e:
                raise ValueError(f"no gzip member at {at}") from e
            at += len(part) - len(z.unused_data)
    if content[at:].strip(b"\0"):
        raise ValueError(f"no gzip member at {at}")
    return b"".join(out)


# ---------------------------------------------------------------------- Spark
def _write(records: DataFrame, path: str, end: bytes, rows_per_file: int = 0) -> None:
    """Write rows of gzip members; Spark's text writer reaches any store.

    What closes a row is a constant member after it, the writer's line separator; the
    writer turns its characters into bytes one by one.
    """
    (
        records.select(F.col("record").cast("string").alias("value")).write
        .option("lineSep", member(end).decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none")
        .option("maxRecordsPerFile", rows_per_file).text(path)
    )


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(path, content) of the archives in a folder and those below it, or of one file.

    Other files beside them are passed over. Without any archive FileNotFoundError is raised, unless a job of Spark wrote the folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)
    if files.select("path").isEmpty():
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
            raise FileNotFoundError(f"no archive named {names} in {path}")
    return files.select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int | None = None) -> None:
    """Write (page_id, url, html) as ARC files; without a version, tasks alternate between 1 and 2.

    A row is a whole file: it is closed by `RECORDS` records or once its records hold `FILE_BYTES` bytes, so
    only a single page larger than that makes a larger file. A page that holds `FILE_BYTES` alone has a file of its own.
    """
    ship(pages.sparkSession)
    out = pa.schema([("record", pa.binary())])
    end = member(b"\n")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        v = version or 1 + task % 2
        files, held, size, name = 0, [], 0, ""
        close = lambda: pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], schema=out)
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                block = http_block(page_id.as_py(), (html.as_py() or "").encode())
                if held and (len(held) > RECORDS or size + len(block) > FILE_BYTES):
                    yield close()
                    held, size = [], 0
                if not held:
                    name = f"wayfold-{task:05d}-{files:05d}.arc"
                    files += 1
                    held.append(member(arc_header(name, v)))
                size += len(block)
                held.append(member(arc_record((url.as_py() or "urn:wayfold:no-url").encode(), "20240101000000", block, v, name)))
        if held:
            yield close()

    _write(pages.select("page_id", "url", "html").mapInArrow(run, "record binary"), path, b"\n", 1)


def _converted(content: bytes):
    """Yield (page_id, url, date, payload_digest, warc_id, head, payload, content type, IP) of each record of an ARC file."""
    for fields, block in parse_arc(unzip(content)):
        page_id, head, payload = parse_http(block) if block.startswith(b"HTTP/") else (None, b"", block)
        date, own, url = fields["Archive-date"].decode(), digest(payload), plain_url(fields["URL"])
        yield page_id, url, warc_date(date), own, warc_id(url, date, own, page_id), head, payload, fields["Content-type"], fields["IP-address"]


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """path, nth, page_id, url, date, payload_digest, payload_bytes, warc_id of each ARC record, with `payloads` also head and payload.

    Archives go by any name that ends in .arc or .arc.gz, in the folder or below it, or are Spark's part files; a folder without any raises
    FileNotFoundError. Files are gzip of any number of members, or plain. A block that is no HTTP response,
    as of dns and ftp records, is all payload and has a null page_id. Records that repeat are rows of their own, an empty
    block is an empty payload, and an archive without records gives no rows.
    """
    ship(spark)
    fields = [
        ("path", pa.string()), ("nth", pa.int32()), ("page_id", pa.int64()), ("url", pa.binary()), ("date", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("warc_id", pa.string()),
        *([("head", pa.binary()), ("payload", pa.binary())] if payloads else []),
    ]
    out = pa.schema(fields)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for nth, (page_id, url, date, own, record_id, head, payload, _, _) in enumerate(_converted(content.as_py())):
                    row = (name, nth, page_id, url, date, own, len(payload), record_id)
                    rows.append((*row, head, payload) if payloads else row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    kinds = "path string, nth int, page_id long, url binary, date string, payload_digest string, payload_bytes long, warc_id string"
    return _files(spark, path, ARC_NAMES).mapInArrow(run, kinds + (", head binary, payload binary" if payloads else ""))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_revisit: int = 0) -> None:
    """Write the WARC equivalent of the ARC files.

    Identifiers, timestamps and digests are synthesised from the ARC records. Of the
    records with equal payloads of `least_revisit` bytes or more, that with the largest
    page id becomes the response, the others revisits of it; all smaller ones
    are responses. HTTP records without a page id are responses, others are resources.
    Each ARC file's part of a WARC file opens with a warcinfo record. An IP address
    that the ARC file states becomes WARC-IP-Address. Of equal payloads whose largest id repeats, each record with that id is a response. Empty
    payloads count as equal; archives without records, and a folder of empty ones, give WARC files without records.

    Payloads stay in the files. A first pass reads off a narrow row a record; the largest id
    of each payload is found with map-side aggregation, and what each revisit refers to
    goes to its file as one array. A second pass converts files, moved as they are,
    compressed, and only where what the revisits refer to, measured first, is more than `BROADCAST_BYTES`. The narrow rows of a payload that a third of the records share are
    a skewed join key, which adaptive execution splits.
    """
    records = cut(read_arc(spark, arc_path, payloads=False))
    keyed = records.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_revisit))
    first = (
        keyed.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url", "date", "warc_id")).alias("first"))
        .where("n > 1").select("payload_digest", "first")
    )
    refers = cut(
        keyed.select("path", "nth", "page_id", "payload_digest").join(first, "payload_digest").where("page_id <> first.page_id")
        .groupBy("path").agg(F.collect_list(F.struct("nth", "first.*")).alias("refers"))
    )
    out = pa.schema([("record", pa.binary())])

    def run(batches):
        for batch in batches:
            for name, content, refers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                origin = {r["nth"]: r for r in refers or ()}
                done = [member(warc_info(name.rpartition("/")[2]))]
                for nth, (_, url, date, own, record_id, head, payload, kind, ip) in enumerate(_converted(content.as_py())):
                    extra = [("WARC-Record-ID", record_id), ("WARC-Payload-Digest", f"sha1:{own}")]
                    if ip not in (b"0.0.0.0", b"-", b""):
                        extra.append(("WARC-IP-Address", ip))
                    if nth in origin:
                        r = origin[nth]
                        extra += [
                            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                            ("WARC-Refers-To", r["warc_id"]), ("WARC-Refers-To-Target-URI", r["url"]), ("WARC-Refers-To-Date", r["date"]),
                            ("X-Refers-To-Page-Id", str(r["page_id"])),
                        ]
                        done.append(member(warc_record("revisit", url, date, HTTP, head, extra)))
                    elif head:
                        done.append(member(warc_record("response", url, date, HTTP, head + payload, extra)))
                    else:
                        done.append(member(warc_record("resource", url, date, kind, payload, extra)))
                    if len(done) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], schema=out)
                        done = []
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], schema=out)

    # where what revisits refer to is small, files stay where they are; else they are the streamed side: a sort would have to hold and spill them
    size = refers.select(F.explode("refers").alias("r"), "path").agg(F.sum(F.length("r.url") + F.length("path") + 200)).first()[0] or 0
    refers = refers.hint("broadcast" if size <= BROADCAST_BYTES else "shuffle_hash")
    joined = _files(spark, arc_path, ARC_NAMES).join(refers, "path", "left").select("path", "content", "refers")
    _write(joined.mapInArrow(run, "record binary"), warc_path, b"\r\n\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, warc_id of each WARC record but warcinfo.

    A revisit keeps the original HTTP header, which declares the payload's length; a
    response's payload is measured and must have the declared digest.
    """
    ship(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_id"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    out = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(unzip(content.as_py())):
                    kind = h["warc-type"].decode()
                    if kind == "warcinfo":
                        continue
                    page_id, head, payload = parse_http(block) if kind != "resource" else (None, b"", block)
                    own = h["warc-payload-digest"].decode().removeprefix("sha1:")
                    if kind != "revisit":
                        size, refers = len(payload), None
                        if digest(payload) != own:
                            raise ValueError(f"payload of {h['warc-record-id']} does not have its digest")
                    else:
                        size = int(re.search(rb"(?mi)^Content-Length: (\d+)", head)[1])
                        refers = int(h["x-refers-to-page-id"])
                    rows.append((page_id, size, own, kind, refers, h["warc-record-id"].decode()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=out)

    return _files(spark, path, WARC_NAMES).select("content").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_id string"
    )


def archive_round_trip(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Write `pages` as ARC files, convert those to WARC, and read the WARC files back.

    A null html is an empty payload, a null URL becomes urn:wayfold:no-url, and white
    space in URLs is percent-encoded. Rows that repeat a page id and html are records of
    their own: all that hold the largest id are responses. A null id is a response with a null id. A page
    is held whole by a task, with its archive file of up to 2,048 pages or 32 MB of records, or of that page alone if it is longer. Other
    columns are ignored. An empty table gives an empty result. The archives live in
    the shared folder and are deleted once the result is checkpointed.
    """
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    try:
        write_arc(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), arc)
        convert(spark, arc, warc, least_revisit)
        remove(spark, arc)
        return cut(read_warc(spark, warc))
    finally:
        remove(spark, arc)
        remove(spark, warc)
