"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, neutral, ship

#: Cells that n-grams are hashed to; a power of two. One more is the constant.
CELLS = 1 << 16
#: Longest n-gram.
LONGEST = 3
#: Code points of which n-grams are taken at a time.
SPAN = 1 << 20
UNKNOWN = "und"
_TABLE: dict[str, np.ndarray] = {}


# -------------------------------------------------------------------- features
def _classes() -> np.ndarray:
    """By code point: 2 a letter, 1 a mark, 0 anything else. No letters lie beyond the table."""
    if not _TABLE:
        kinds = {"L": 2, "M": 1}
        _TABLE["class"] = np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x40000)], dtype=np.uint8)
    return _TABLE["class"]


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with one space for each run of other characters, and at both ends; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype="<u4")
    kind = _classes()[np.minimum(points, 0x3FFFF)]
    if not (kind == 2).any():
        return np.zeros(0, np.uint32)
    ink = kind > 0
    out = np.where(ink, points, np.uint32(32))
    keep = ink.copy()
    keep[1:] |= ink[:-1]  # the first of a run of others
    out = out[keep]
    head = [] if out[0] == 32 else [32]
    tail = [] if out[-1] == 32 else [32]
    return np.concatenate([np.array(head, np.uint32), out, np.array(tail, np.uint32)])


def _cells(points: np.ndarray) -> list[np.ndarray]:
    """The cell of each n-gram that begins among the first `SPAN` code points, an array for each n."""
    own, out = points[: SPAN + LONGEST - 1].astype(np.uint64), []
    h = np.zeros(min(SPAN, len(points)), dtype=np.uint64)
    for n in range(LONGEST):
        fit = max(0, min(len(h), len(own) - n))
        h = (h[:fit] + own[n : n + fit] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((h ^ (h >> np.uint64(29))) >> np.uint64(7) & np.uint64(CELLS - 1)).astype(np.int64))
    return out


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(cells, times) of all n-grams of 1 to `LONGEST` characters of the whole text; ascending."""
    points = letters(text)
    if len(points) * LONGEST < CELLS // 8:
        return np.unique(np.concatenate(_cells(points)), return_counts=True)
    total = np.zeros(CELLS, dtype=np.int64)
    for at in range(0, len(points), SPAN):
        for part in _cells(points[at : at + SPAN + LONGEST - 1]):
            total += np.bincount(part, minlength=CELLS)
    at = np.flatnonzero(total)
    return at, total[at]


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, values): log counts times inverse document frequency, of length 1, and the constant; empty without letters."""
    at, times = grams(text)
    if not len(at):
        return at, np.zeros(0)
    x = (1 + np.log(times)) * idf[at]
    return np.append(at, CELLS), np.append(x / math.sqrt(float(x @ x)), 1.0)


# ----------------------------------------------------------------------- model
@dataclass(frozen=True)
class Ftrl:
    """Step size and smoothing of the adaptive rates, and the two penalties."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What minimises the regularised linearised loss: zero where |z| is within l1."""
        out = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        out[np.abs(z) <= self.l1] = 0.0
        return out

    def step(self, z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """Learn one row of class `y` in place; `z` and `n` have a row a cell and a column a class."""
        zs, ns = z[at], n[at]
        w = self.weights(zs, ns)
        p = softmax(x @ w)
        p[y] -= 1.0
        g = x[:, None] * p
        more = ns + g * g
        z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / self.alpha * w
        n[at] = more


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one divisor of all logits under which the classes of the rows are likeliest, by golden sections between e^-4 and e^4.

    One more row, of all classes in equal parts, spread over the others keeps the divisor from 0 where the model makes no mistake.
    """
    all_but_one = len(y) / (len(y) + 1)

    def loss(t: float) -> float:
        log_p = np.log(np.maximum(softmax(logits / math.exp(t)), 1e-300))
        return float(-(all_but_one * log_p[np.arange(len(y)), y] + (1 - all_but_one) * log_p.mean(axis=1)).mean())

    lo, hi, golden = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


@dataclass
class LanguageModel:
    """Languages in order, inverse document frequencies, weights by cell and language, and the temperature."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(CELLS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((CELLS + 1, 0)))
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        """None without letters."""
        at, x = features(text, self.idf)
        return x @ self.weights[at] if len(at) else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if self.languages else None
        if z is None:
            return UNKNOWN, 0.0
        p = softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


# ----------------------------------------------------------------------- Spark
def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """(texts with letters, in how many of them each cell occurs). A task adds up its partition; the driver gets a number a cell."""
    ship(docs.sparkSession)
    out = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(CELLS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                at, _ = grams(text.as_py())
                total[at] += 1
                total[CELLS] += len(at) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=out)

    df = np.zeros(CELLS + 1, dtype=np.int64)
    for cell, n in docs.select(F.col(text_col).cast("string")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        df[cell] = n
    return int(df[CELLS]), df[:CELLS]


def training_sample(docs: DataFrame, per_language: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text, h): of each language the `per_language` different texts of least hash.

    The number of different texts is estimated by a sketch with map-side merging, and only rows
    below the hash that some more than `per_language` of them lie under are shuffled.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).withColumn("h", F.xxhash64("text"))
    about = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    share = F.least(F.lit(1.0), (1.2 * per_language + 200) / F.col("n"))
    near = rows.join(F.broadcast(about.select(F.col("lang").alias("_l"), share.alias("share"))), F.col("lang") == F.col("_l")).where(
        F.col("h") / F.lit(2.0**64) + F.lit(0.5) <= F.col("share")
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return near.select("lang", "text", "h").dropDuplicates(["lang", "h"]).withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")


def fit(
    docs: DataFrame, per_language: int = 1500, shards: int = 8, rounds: int = 3, steps: int = 500, ftrl: Ftrl | None = None,
    text_col: str = "text", lang_col: str = "lang",
) -> LanguageModel:
    """Learn the languages of the texts of `docs`.

    Inverse document frequencies count all texts of `docs`. The weights are learned on a sample, at most
    `per_language` different texts of each language (the only bound; documented and a parameter), of which every fifth by hash
    is kept back. Rows are dealt into `shards` by hash; in each round every shard goes over its rows with
    follow-the-regularised-leader from the common state, again and again until it has made `steps` steps, and the states
    are averaged cell by cell in the cluster, each by its rows, so the result does not depend on partitions. What was kept back then fits the temperature; if nothing was, the
    temperature stays 1. The driver holds the state: cells x languages.

    Null texts, texts without letters and null languages teach nothing. A text that stands under two languages teaches
    both. Without any training text the model knows no language.
    """
    ftrl = ftrl or Ftrl()
    sample = cut(training_sample(docs, per_language, text_col, lang_col))
    languages = [r[0] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return LanguageModel()
    n, df = document_frequencies(docs, text_col)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    number, k = {x: i for i, x in enumerate(languages)}, len(languages)
    rows = sample.select("lang", "text", "h", (F.pmod("h", F.lit(5)) == 0).alias("held"), F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    train, held = rows.where(~F.col("held")), rows.where("held")
    total = train.count()
    states = pa.schema([("at", pa.int32()), ("z", pa.float64()), ("n", pa.float64())])
    z, n_ = np.zeros((CELLS + 1, k)), np.zeros((CELLS + 1, k))

    def learn(start):
        def run(table: pa.Table) -> pa.Table:
            z, n = start[0].copy(), start[1].copy()
            table = table.sort_by([("h", "ascending"), ("lang", "ascending")])
            # made anew each round: as features the sample takes ten times the room that it takes as texts
            own = [(*features(text.as_py(), idf), number[lang.as_py()]) for lang, text in zip(table.column("lang"), table.column("text"), strict=True)]
            for _ in range(-(-steps // len(own))):
                for at, x, y in own:
                    ftrl.step(z, n, at, x, y)
            cells = np.flatnonzero(n)
            share = len(own) / total  # a shard counts by its rows
            return pa.table([pa.array(cells, pa.int32()), z.ravel()[cells] * share, n.ravel()[cells] * share], schema=states)

        return run

    for _ in range(rounds):
        got = train.groupBy("shard").applyInArrow(learn((z, n_)), "at int, z double, n double")
        got = got.groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        z, n_ = np.zeros((CELLS + 1) * k), np.zeros((CELLS + 1) * k)
        at = got.column("at").to_numpy()
        z[at], n_[at] = got.column("z").to_numpy(), got.column("n").to_numpy()
        z, n_ = z.reshape(-1, k), n_.reshape(-1, k)
    model = LanguageModel(languages, idf, ftrl.weights(z, n_))

    def outputs(batches):
        for b in batches:
            logits = [model.logits(text.as_py()) for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(logits, pa.list_(pa.float64())), pa.array([number[x] for x in b.column(0).to_pylist()], pa.int32())], names=["logits", "y"])

    held = held.select("lang", "text").mapInArrow(outputs, "logits array<double>, y int").toArrow()
    if held.num_rows:
        logits = held.column("logits").combine_chunks().flatten().to_numpy().reshape(-1, k)
        model.temperature = temperature(logits, held.column("y").to_numpy())
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The columns of `docs` plus lang_pred and score, the calibrated probability of that language.

    The text alone is read, whole, however long: n-gram counts of a very long one are taken
    a span at a time. A null text and a text without any letter are `und` with score 0, as is every text
    under a model that knows no language. Equal probabilities go to the first language by name. Repeated
    rows are answered alike. Columns of `docs` with the new names are replaced. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    new = ["lang_pred", "score"]
    rows, name = neutral(docs.drop(*(c for c in docs.columns if c in new)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        got = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], names=new)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, "lang_pred string, score double")
    return rows.withColumn("_p", udf(F.col(name[text_col]).cast("string"))).select(*[F.col(v).alias(k) for k, v in name.items()], "_p.*")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether the CRC-32 of an id's decimal digits leaves the remainder `part`; a null id has no digits."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part
