"""Payload decoding."""

from __future__ import annotations

import base64
import binascii

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a payload that are unpacked at most; a larger one stays packed.
MOST = 64 << 20


def _decode(x: str | None) -> str | None:
    import zstandard

    if x is None:
        return None
    try:
        raw = base64.b64decode(x, validate=True)
        out = zstandard.ZstdDecompressor().stream_reader(raw).read(MOST + 1)  # so a small text cannot fill the memory
        return x if len(out) > MOST else out.decode()
    except (binascii.Error, ValueError, zstandard.ZstdError):
        return x


def decode_payload(x: Column) -> Column:
    """Base64 of zstd of UTF-8; what does not decode, or is larger than `MOST` unpacked, stays as it is.

    Spark has no zstd function, so this is an Arrow-batched UDF.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_decode(t.as_py()) for t in texts], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(x)
