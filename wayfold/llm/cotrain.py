"""Quality classification by co-training a text view and a metadata view."""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_chunks, neutral, ship, text_buffers, word_hashes

PUNCTUATION = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
SURFACE = 11 + len(PUNCTUATION)
#: Cells that the words of a text are hashed to; a power of two.
WORD_CELLS = 128
CONTENT = SURFACE + WORD_CELLS
LANGS, SOURCES, LENGTHS = 8, 32, 16
META = LANGS + SOURCES + LENGTHS + 1


# -------------------------------------------------------------------- features
def content_features(texts: pa.Array) -> np.ndarray:
    """Per text: roots of byte class shares, how its words repeat, and roots of the shares of its words by hash cell."""
    data, offsets = text_buffers(texts)
    out = np.zeros((len(texts), CONTENT), dtype=np.float32)
    for a, b in doc_chunks(offsets):
        own = offsets[a : b + 1]
        words, at = word_hashes(data[own[0] : own[-1]], own - own[0])
        again = np.concatenate([[False], words[1:] == words[:-1]])
        for i in range(a, b):
            n = int(offsets[i + 1] - offsets[i])
            w = words[at[i - a] : at[i - a + 1]]
            if not n or not len(w):
                out[i, 10] = 1.0
                continue
            c = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256) / n
            out[i, :6] = np.sqrt([c[97:123].sum(), c[65:91].sum(), c[48:58].sum(), c[32], c[:32].sum(), c[128:].sum()])
            out[i, 6] = again[at[i - a] + 1 : at[i - a + 1]].mean() if len(w) > 1 else 0.0
            out[i, 7] = len(np.unique(w)) / len(w)
            out[i, 8] = min(2.0, n / len(w) / 10)
            out[i, 9] = 1 / (1 + len(w))
            out[i, 11:SURFACE] = np.sqrt(c[PUNCTUATION])
            out[i, SURFACE:] = np.sqrt(np.bincount((w >> np.uint64(65 - WORD_CELLS.bit_length())).astype(np.int64), minlength=WORD_CELLS) / len(w))
    return out


def _cell(values: list, cells: int) -> np.ndarray:
    return np.array([0 if v is None else 1 + zlib.crc32(str(v).encode()) % (cells - 1) for v in values], dtype=np.int64)


def meta_cells(langs: list, sources: list, chars: list) -> np.ndarray:
    """Per document the three cells it occupies: language, source, length."""
    length = np.array([0 if n is None else 1 + min(LENGTHS - 2, max(0, int(n)).bit_length() * 3 // 4) for n in chars], dtype=np.int64)
    return np.column_stack([_cell(langs, LANGS), LANGS + _cell(sources, SOURCES), LANGS + SOURCES + length])


def _views(content: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Design matrices of both views, each with a constant."""
    meta = np.zeros((len(cells), META))
    np.put_along_axis(meta, cells, 1.0, axis=1)
    meta[:, -1] = 1.0
    return np.column_stack([content.astype(np.float64), np.ones(len(content))]), meta


# ---------------------------------------------------------------------- models
def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; x has a constant column, a row counts `weight` times."""
    w = np.zeros(x.shape[1])
    weight = np.broadcast_to(weight, len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _line(s: np.ndarray) -> np.ndarray:
    return np.column_stack([s, np.ones(len(s))])


@dataclass
class CoTrained:
    """Both views' linear scores, their calibrations, and how the views combine."""

    weights: list[np.ndarray] = field(default_factory=lambda: [np.zeros(CONTENT + 1), np.zeros(META)])
    calibration: list[np.ndarray] = field(default_factory=lambda: [np.zeros(2), np.zeros(2)])
    combine: np.ndarray = field(default_factory=lambda: np.zeros(3))
    fitted: bool = False

    def logits(self, content: np.ndarray, cells: np.ndarray) -> np.ndarray:
        views = _views(content, cells)
        return np.column_stack([_line(v @ w) @ c for v, w, c in zip(views, self.weights, self.calibration, strict=True)])

    def calibrate(self, content: np.ndarray, cells: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
        for i, v in enumerate(_views(content, cells)):
            self.calibration[i] = logistic(_line(v @ self.weights[i]), y, weight=weight)
        self.combine = logistic(np.column_stack([self.logits(content, cells), np.ones(len(y))]), y, weight=weight)
        self.fitted = True

    def scores(self, content: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Columns: probability by content, by metadata, and combined."""
        z = self.logits(content, cells)
        both = np.column_stack([z, np.ones(len(z))]) @ self.combine
        return 1 / (1 + np.exp(-np.clip(np.column_stack([z, both]), -30, 30)))


# ------------------------------------------------------------------------ Spark
def _features(docs: DataFrame) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), ("content", pa.list_(pa.float32())), ("cells", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            content = content_features(b.column(1))
            cells = meta_cells(*(b.column(i).to_pylist() for i in (2, 3, 4))) if b.num_rows else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(content), pa.list_(pa.float32())), pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))], schema=out
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars").mapInArrow(
        run, "doc_id long, content array<float>, cells array<int>"
    )


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    content = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, CONTENT)
    cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, 3).astype(np.int64)
    return content, cells, batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)


def _sums(rows: DataFrame, model: CoTrained, confident: float, pseudo_weight: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Normal equations of both views over all training rows, summed in the cluster.

    Labelled rows teach both views. Of the others, a row that one view is confident of
    teaches the other view, with `pseudo_weight`.
    """
    widths = [CONTENT + 1, META]

    def run(batches):
        total = [np.zeros((w, w + 1)) for w in widths]
        for batch in batches:
            if not batch.num_rows:
                continue
            content, cells, y = _read(batch)
            views = _views(content, cells)
            known = ~np.isnan(y)
            teach = [(np.where(known, 1.0, 0.0), np.where(known, 2 * y - 1, 0.0)) for _ in widths]
            if model.fitted:
                p = model.scores(content, cells)[:, :2]
                for mine, other in ((0, 1), (1, 0)):
                    sure = ~known & ((p[:, other] >= confident) | (p[:, other] <= 1 - confident))
                    teach[mine][0][sure] = pseudo_weight
                    teach[mine][1][sure] = np.where(p[sure, other] > 0.5, 1.0, -1.0)
            for t, v, (w, target) in zip(total, views, teach, strict=True):
                t[:, :-1] += (v * w[:, None]).T @ v
                t[:, -1] += v.T @ (w * target)
        flat = np.concatenate([t.ravel() for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    got = rows.select("content", "cells", "y").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(sum(w * (w + 1) for w in widths))
    flat[got["i"].to_numpy()] = got["x"].to_numpy()
    out, at = [], 0
    for w in widths:
        t = flat[at : at + w * (w + 1)].reshape(w, w + 1)
        out.append((t[:, :-1], t[:, -1]))
        at += w * (w + 1)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", rounds: int = 2, confident: float = 0.97,
    pseudo_weight: float = 0.25, calibration_rows: int = 20_000, ridge: float = 1.0,
) -> CoTrained:
    """Co-train on all documents.

    Every fifth labelled document by hash is held out; of each class at most
    `calibration_rows` of these, those of least hash, reach the driver to calibrate and
    to combine the views, weighted to the class's share. For a class of which none is
    held out, its training rows stand in, and if all are, they teach as well. That
    sample of labelled rows is the only bounded one. Each round fits both views on all
    labelled rows and on what the other view is confident of among all unlabelled ones,
    as sums taken in the cluster.

    Without labels of both classes the model stays unfitted, scores 0.5 and warns.
    """
    ship(docs.sparkSession)
    truth = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    )
    order = F.xxhash64("doc_id", F.lit(5))
    rows = cut(_features(docs).join(truth, "doc_id", "left").withColumn("held", F.col("y").isNotNull() & (F.pmod(order, F.lit(5)) == 0)))
    known = {(r[0], r[1]): r[2] for r in rows.where(F.col("y").isNotNull()).groupBy("y", "held").count().collect()}
    if len({y for y, _ in known}) < 2:
        warnings.warn("labels of both classes are needed: the classifier stays unfitted and scores 0.5", stacklevel=2)
        return CoTrained()
    parts, weight = [], []
    for y in (0.0, 1.0):
        held = (y, True) in known
        some = rows.where((F.col("y") == y) & (F.col("held") == held)).orderBy(order, "doc_id").limit(calibration_rows)
        parts.append(_read(some.select("content", "cells", "y").toArrow().combine_chunks().to_batches()[0]))
        n = known[y, held] / (1 if held else 4)  # of five rows four teach
        weight.append(np.full(len(parts[-1][2]), n / len(parts[-1][2])))
    content, cells, y = (np.concatenate(x) for x in zip(*parts, strict=True))
    weight, model = np.concatenate(weight), CoTrained()
    training = rows.where(~F.col("held")) if {(0.0, False), (1.0, False)} <= set(known) else rows
    for _ in range(rounds + 1):
        for i, (a, b) in enumerate(_sums(training, model, confident, pseudo_weight)):
            model.weights[i] = np.linalg.solve(a + ridge * np.eye(len(b)), b)
        model.calibrate(content, cells, y, weight)
    return model


def score_column(model: CoTrained, text="text", lang="lang", source="source", chars="n_chars") -> Column:
    """A struct of content_score, meta_score and score: probabilities of good quality."""

    def run(texts: pa.Array, langs: pa.Array, sources: pa.Array, n: pa.Array) -> pa.Array:
        if not len(texts):
            p = np.zeros((0, 3))
        elif model.fitted:
            p = model.scores(content_features(texts), meta_cells(langs.to_pylist(), sources.to_pylist(), n.to_pylist()))
        else:
            p = np.full((len(texts), 3), 0.5)
        return pa.StructArray.from_arrays([pa.array(c.round(6)) for c in p.T], names=["content_score", "meta_score", "score"])

    run.__annotations__ = {"texts": pa.Array, "langs": pa.Array, "sources": pa.Array, "n": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "content_score double, meta_score double, score double")(text, lang, source, chars)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Score all documents: the columns of `docs` plus content_score, meta_score, score and good.

    The content view reads the whole text, however long: its words by hash cell, its bytes by class, and
    how words repeat. The metadata view reads lang, source and n_chars.
    Null metadata has cells of its own; a null text and a text without words share the
    "empty" feature. Labels for unknown or null ids and null labels teach nothing,
    repeated labels are averaged, repeated rows teach as often as they occur.
    good is score >= threshold, so an unfitted model keeps all. Columns of `docs` with
    the new names are replaced. An empty table gives an empty result.
    """
    new = ["content_score", "meta_score", "score", "good"]
    plain = docs.drop(*new)
    rows, name = neutral(plain)
    model = fit(plain, labels, **options)
    return (
        rows.withColumn("_s", score_column(model, name["text"], name["lang"], name["source"], name["n_chars"]))
        .select(*[F.col(v).alias(k) for k, v in name.items()], "_s.content_score", "_s.meta_score", "_s.score")
        .withColumn("good", F.col("score") >= threshold)
    )
