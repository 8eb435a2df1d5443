"""Models behind protocols: what embeds texts and what classifies pages, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# Characters of a page's text that a classifier sees, and its answer's fields.
CONTENT_CHARS = 2000
ANSWER = "page_type string, confidence double, should_process boolean, reasoning string"


class Embedder(Protocol):
    """Texts to vectors of one length; a null or empty text may be given."""

    width: int

    def embed(self, texts: Sequence[str | None]) -> np.ndarray: ...


class Classifier(Protocol):
    """Pages to (page_type, confidence, should_process, reasoning)."""

    def classify(self, urls: Sequence[str | None], titles: Sequence[str | None], contents: Sequence[str]) -> list[tuple[str, float, bool, str]]: ...


class HashingEmbedder:
    """Counts of word hashes by cell, scaled to length 1: needs no model and gives the same vector everywhere."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: Sequence[str | None]) -> np.ndarray:
        import re
        from zlib import crc32

        out = np.zeros((len(texts), self.width))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                out[i, crc32(word.encode()) % self.width] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class KeywordClassifier:
    """The offline default: a page is knowledge by the share of its words that its rules name, else another type."""

    def __init__(self, words: Sequence[str] = ("how", "what", "why", "guide", "introduction", "the", "of"), least: float = 0.05):
        self.words, self.least = frozenset(words), least

    def classify(self, urls, titles, contents):
        out = []
        for content in contents:
            words = content.lower().split()
            share = sum(w.strip(".,!?") in self.words for w in words) / len(words) if words else 0.0
            known = bool(words) and share >= self.least
            confidence = min(1.0, 0.5 + share) if known else 0.5
            out.append(("knowledge" if known else "other", round(confidence, 6), known, f"{share:.4f} of its words are named"))
        return out


def embedding(spark: SparkSession, text: Column, make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """The vector of a text (array of double) by the embedder that `make` loads, once for each task's worker."""
    ship(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in batches:
            got = np.asarray(model.embed(texts.to_pylist()), dtype=np.float64) if len(texts) else np.zeros((0, 1))
            if len(texts) and got.shape != (len(texts), model.width):
                raise ValueError(f"the embedder gave {got.shape} for {len(texts)} texts of width {model.width}")
            yield pa.array(list(got), pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<double>")(text)


def classification(spark: SparkSession, url: Column, title: Column, content: Column, make: Callable[[], Classifier] = KeywordClassifier) -> Column:
    """A struct of page_type, confidence (held to 0..1), should_process and reasoning; a page that makes the model fail is other, with 0 and the error.

    The classifier sees the first `CONTENT_CHARS` characters, as the data model says.
    """
    ship(spark)
    kinds = [pa.string(), pa.float64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make()
        for urls, titles, contents in batches:
            pages = [x.to_pylist() for x in (urls, titles, contents)]
            pages[2] = [x or "" for x in pages[2]]
            try:
                got = model.classify(*pages) if len(urls) else []
            except Exception:  # one bad page must not cost its batch
                got = []
                for one in zip(*pages, strict=True):
                    try:
                        got += model.classify(*([x] for x in one))
                    except Exception as e:
                        got.append(("other", 0.0, False, f"classification failed: {e}"))
            got = [(t, min(1.0, max(0.0, float(c))), bool(p), r) for t, c, p, r in got]
            columns = zip(*got, strict=True) if got else [[] for _ in kinds]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_type", "confidence", "should_process", "reasoning"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ANSWER)(url, title, F.substring(content, 1, CONTENT_CHARS))


def records(values, make: Callable[[], Embedder] = HashingEmbedder, now: Column | None = None):
    """What a put stores of rows (key, name, description, sections, body): sections as one text, the text that is embedded,
    its vector, and created_at and updated_at, both the time of the put. Missing parts count as empty."""
    now = F.current_timestamp() if now is None else now
    stored = values.withColumn("sections_string", F.array_join(F.coalesce("sections", F.array().cast("array<string>")), "|||")).drop("sections")
    text = F.concat_ws(" ", "name", "description", "sections_string", "body")
    return stored.withColumn("embedded_text", text).withColumn("vector", embedding(values.sparkSession, F.col("embedded_text"), make)).withColumns({"created_at": now, "updated_at": now})
