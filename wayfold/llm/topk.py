"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .common import finite_vectors, strangers, top_k_in_blocks

QUERIES_AT_ONCE = 64
LONG = (1 << 63) - 1


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as integers. Values whose sum of products a long might not hold are refused."""
    q = np.floor(256.0 * x)
    if q.size and np.abs(q).max() >= 2.0**31 / max(1.0, x.shape[1]) ** 0.5:
        raise ValueError("components too large: an integer inner product would not fit a long")
    return q.astype(np.int64)


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Per term the rows that hold it and their weights; a term in every row needs no row list."""
    out = []
    for term in range(rows.shape[1]):
        held = np.flatnonzero(rows[:, term])
        out.append((slice(None) if len(held) == len(rows) else held, rows[held, term]))
    return out


def _large(x: np.ndarray) -> np.ndarray:
    """The rows of x with a component that `quantise` refuses."""
    limit = 2.0**31 / max(1.0, x.shape[1]) ** 0.5
    return np.abs(np.floor(256.0 * x)).max(axis=1, initial=0.0) >= limit


def _wide(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as integers without a limit."""
    return np.array([[math.floor(v * 256) if abs(v) < 2.0**1000 else math.floor(v) * 256 for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def accumulate(ids, rows, query_ids, queries, k):
    """Scatter each query's weighted postings into dense arrays of scores, then select.

    Terms are taken one at a time for some queries together. Selection partitions a
    query's scores at the k-th, keeps all rows that tie with it, and orders those.
    Rows and queries with components whose products a long might not hold are
    scored with integers of any size.
    """
    original, asked = rows, queries
    big, grand = _large(rows), _large(queries)
    lists = postings(quantise(np.where(big[:, None], 0.0, rows)))
    queries = quantise(np.where(grand[:, None], 0.0, queries))
    wide = _wide(rows if grand.any() else rows[big])
    at, near, score = [], [], []
    for first in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries[first : first + QUERIES_AT_ONCE]
        dense = np.zeros((len(ids), len(part)), dtype=np.int64)
        for term, (held, weights) in enumerate(lists):
            asking = np.flatnonzero(part[:, term])
            if not len(asking) or not len(weights):
                continue
            if len(asking) == len(part):
                dense[held] += weights[:, None] * part[:, term]
            elif isinstance(held, slice):
                dense[:, asking] += weights[:, None] * part[asking, term]
            else:
                dense[np.ix_(held, asking)] += weights[:, None] * part[asking, term]
        for i, sums in enumerate(np.ascontiguousarray(dense.T), start=first):
            others = np.flatnonzero(strangers(ids, original, query_ids[i], asked[i]))
            if grand[i] or big.any():
                exact = sums.astype(object)
                exact[slice(None) if grand[i] else big] = (wide if grand[i] or not grand.any() else wide[big]) @ _wide(asked[i : i + 1])[0]
                order = sorted(others, key=lambda j: (-exact[j], ids[j]))[:k]  # noqa: B023
                best, s = np.array(order, dtype=np.int64), [min(LONG, max(-LONG - 1, int(exact[j]))) for j in order]
                near.append(ids[best])
            else:
                s = sums[others]
                if len(s) > k:
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    others, s = others[keep], s[keep]
                best = np.lexsort((ids[others], -s))[:k]
                near.append(ids[others[best]])
                s = s[best]
            at.append(np.full(len(best), i))
            score.append(np.array(s, dtype=np.int64))
    return np.concatenate(at), np.concatenate(near), np.concatenate(score)


def exact_top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k highest integer inner products for each row whose id `every` divides.

    Components become floor(256 * x); zeros are absent from the postings. Ties go to
    the smaller id. Null ids, null vectors and vectors with null or non-finite
    components take no part; a zero vector does. Rows that repeat both id and vector are one,
    rows that repeat only the id are rows of their own. Vectors of different lengths are not
    compared. Products are exact at any size; a score that no long can hold is given as the
    nearest long. Other columns are ignored. An empty table gives an empty result.
    """
    return top_k_in_blocks(finite_vectors(vectors, id_col, vector_col, nonzero=False), every, k, accumulate, "long")
