"""JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_list(items: Column) -> Column:
    """A list of texts as JSON."""
    return F.to_json(items)


def decode_list(x: Column) -> Column:
    """The inverse of encode_list; null becomes an empty list."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def lenient(x: Column) -> Column:
    """A variant from model output: the whole text, else a fenced block, else the first braces.

    The braces match up to the nearest closing one, so nested objects need a fence.
    """
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)\{.*?\}", 0)
    attempt = lambda c: F.try_parse_json(F.nullif(F.trim(c), F.lit("")))
    return F.coalesce(attempt(x), attempt(fenced), attempt(braces))
