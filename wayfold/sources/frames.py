"""Length-prefixed messages: a little-endian 32-bit length, then as many bytes of UTF-8 JSON, again and again.

Files are read by Spark's own binary file source, as a batch or as a stream, so any store works, files are the
partitions, and a stream's offsets are the files that it has seen.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of the longest message that is taken; a length beyond it is no length.
MOST = 64 << 20
#: Frames of a file that is written, at most: a file is read whole by a task.
FRAMES = 1_000
_KINDS = "path string, nth long, value string, reason string"


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Batches of at most about `size` bytes to Python while it holds: unpacked, a batch is many times as large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def split_frames(content: bytes | memoryview, most: int = MOST):
    """Yield (message, reason) of each frame; one of both is null.

    A frame that is no UTF-8 is told and passed over. After a length that is too long, or that the file does not
    hold, no frame's place is known, so what is left is told once.
    """
    at = 0
    while at < len(content):
        if at + 4 > len(content):
            yield None, "frame without a length"
            return
        (n,) = struct.unpack_from("<I", content, at)
        if n > most:
            yield None, "frame too long"
            return
        body = content[at + 4 : at + 4 + n]
        if len(body) < n:
            yield None, "frame cut short"
            return
        try:
            yield str(body, "utf-8"), None
        except UnicodeDecodeError:
            yield None, "frame is not UTF-8"
        at += 4 + n


def _split(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    out = pa.schema([("path", pa.string()), ("nth", pa.int64()), ("value", pa.string()), ("reason", pa.string())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for nth, (value, reason) in enumerate(split_frames(memoryview(content.as_buffer()))):
                    rows.append((path, nth, value, reason))
                    held += len(value or "")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return files.select("path", "content").mapInArrow(run, _KINDS)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, value, reason): each message of the files in a folder, and what could not be read."""
    return _split(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def stream_frames(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The same as a stream of the files as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _split(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path))


def write_frames(messages: DataFrame, path: str, value: str = "value") -> None:
    """Write JSON texts as frames by Spark's text writer.

    A frame holds its message and a line feed, which JSON allows after it and the writer puts there; the
    writer takes the bytes of a text as they are.
    """
    body = F.encode(F.col(value), "UTF-8")
    n = F.octet_length(body) + 1
    size = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(255).cast("long")), 2, "0") for i in range(4)]))
    frame = F.concat(size, body).cast("string")
    messages.where(F.col(value).isNotNull()).select(frame.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FRAMES).text(path)
