"""Approximate nearest neighbours with a forest of hash-prefix trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import finite_vectors, strangers, top_k_in_blocks

BITS = 64
#: Queries whose ranges in all trees are held at once.
QUERIES_AT_ONCE = 1024
#: Candidates scored for each neighbour asked for, at least.
PER_NEIGHBOUR = 10


class PrefixForest:
    """Sorted arrays of 64-bit hash strings, one per tree, over one block of rows.

    A bit is the side of a random hyperplane. For inner products the rows get one
    more component that brings all to the same length, the queries a zero there.
    """

    def __init__(self, rows: np.ndarray, trees: int, seed: int):
        self.n, width = rows.shape
        self.planes = np.random.default_rng([seed, width]).standard_normal((width + 1, trees * BITS))
        self.trees = trees
        self.scale = np.abs(rows).max() if self.n else 1.0
        unit = rows / (self.scale or 1.0)
        square = np.einsum("ij,ij->i", unit, unit)
        lift = np.sqrt(np.maximum(0.0, square.max(initial=0.0) - square))
        strings = self._strings(np.column_stack([unit, lift]))
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def _strings(self, lifted: np.ndarray) -> np.ndarray:
        out = np.zeros((self.trees, len(lifted)), dtype=np.uint64)
        for t in range(self.trees):
            bits = np.packbits(lifted @ self.planes[:, t * BITS : (t + 1) * BITS] > 0, axis=1)
            out[t] = bits.view(">u8").ravel().astype(np.uint64)
        return out

    def ranges(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query the range of the sorted array to examine.

        Each query descends to its longest matching prefix over all trees. Then all
        trees ascend together to the deepest level at which they hold `wanted` candidates.
        Levels hold more the higher they are, so that level is found by halving. A tree's
        queries are searched in the order of their strings, which keeps its array in the cache.
        """
        peak = np.abs(queries).max(axis=1, keepdims=True)
        asked = self._strings(np.column_stack([queries / np.where(peak > 0, peak, 1.0), np.zeros(len(queries))]))
        by_string = np.argsort(asked, axis=1)
        at = np.empty(asked.shape, dtype=np.int64)
        for t, o in enumerate(by_string):
            at[t, o] = np.searchsorted(self.strings[t], asked[t, o])
        longest = np.zeros(len(queries), dtype=np.int64)
        for near in (np.maximum(at - 1, 0), np.minimum(at, self.n - 1)):
            differ = np.take_along_axis(self.strings, near, axis=1) ^ asked
            # the float exponent gives the leading zeros, at most one too few
            lead = np.where(differ == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64))
            longest = np.maximum(longest, np.clip(lead, 0, BITS).max(axis=0))
        low = np.zeros(asked.shape, dtype=np.int64)  # the roots hold all rows
        high = np.full(asked.shape, self.n, dtype=np.int64)
        held, below = np.zeros(len(queries), dtype=np.int64), longest
        first, end = np.zeros_like(low), np.zeros_like(low)
        while (open_ := held < below).any():
            depth = (held + below + 1) // 2
            rest = (np.uint64(1) << np.where(open_, BITS - depth, 0).astype(np.uint64)) - np.uint64(1)
            for t, o in enumerate(by_string):
                o = o[open_[o]]
                prefix = asked[t, o] & ~rest[o]
                first[t, o] = np.searchsorted(self.strings[t], prefix)
                end[t, o] = np.searchsorted(self.strings[t], prefix | rest[o], side="right")
            enough = open_ & ((end - first).sum(axis=0) >= wanted)
            low[:, enough], high[:, enough] = first[:, enough], end[:, enough]
            held = np.where(enough, depth, held)
            below = np.where(open_ & ~enough, depth - 1, below)
        return low, high


def most_voted(votes: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` highest votes, ascending; of equal votes the first ones. Rows without a vote are left out."""
    c = np.flatnonzero(votes)
    if len(c) <= most:
        return c
    least = len(c) - np.cumsum(np.bincount(votes[c]))  # how many have more votes than this
    edge = int(np.flatnonzero(least < most)[0])
    keep = votes[c] > edge
    keep[np.flatnonzero(votes[c] == edge)[: most - int(keep.sum())]] = True
    return c[keep]


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(rows * query, axis=1)[:, -1]


def forest_search(trees: int, effort: float, seed: int, scored: float = 1.0):
    """The block search: forest candidates, those that most trees agree on, then exact scores.

    Equal vectors are indexed once with their k + 1 smallest ids, which are all that
    can be among k neighbours; a group of thousands of copies costs one entry.
    """

    def search(ids, rows, query_ids, queries, k):
        _, first, group = np.unique(np.ascontiguousarray(rows + 0.0).view(f"V{8 * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by_group = np.argsort(group, kind="stable")  # ids ascend within a group, as the rows do
        starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
        distinct, copies = rows[first], np.diff(starts)
        forest = PrefixForest(distinct, trees, seed)
        most = max(PER_NEIGHBOUR * k, int(np.ceil(scored * len(distinct))))
        slack = 1e-11 * rows.shape[1] * (np.abs(distinct).max() or 1.0)
        hits: list[tuple[int, np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            part = queries[at : at + QUERIES_AT_ONCE]
            low, high = forest.ranges(part, int(np.ceil(effort * len(distinct))))
            for i, (me, q) in enumerate(zip(query_ids[at : at + QUERIES_AT_ONCE], part, strict=True)):
                held = np.concatenate([o[a:b] for o, a, b in zip(forest.order, low[:, i].tolist(), high[:, i].tolist(), strict=True)])
                c = most_voted(np.bincount(held, minlength=len(distinct)), most)
                if copies[c].sum() <= k:  # too few however far the trees agree: ascend to the roots
                    c = np.arange(len(distinct))
                rough = distinct[c] @ q
                if len(c) > k + 1:  # the query's own vector may be one of them
                    edge = np.partition(rough, len(c) - k - 1)[len(c) - k - 1]
                    c = c[rough >= edge - slack * np.abs(q).max()]
                score = exact_products(distinct[c], q)
                own, mine = [], []
                for g, s in zip(c, score, strict=True):
                    some = by_group[starts[g] : min(starts[g + 1], starts[g] + k + 1)]
                    near = ids[some][strangers(ids[some], rows[some], me, q)]
                    own.append(near)
                    mine.append(np.full(len(near), s))
                near, score = (np.concatenate(own), np.concatenate(mine)) if own else (np.zeros(0, np.int64), np.zeros(0))
                best = np.lexsort((near, -score))[:k]
                hits.append((at + i, near[best], score[best]))
        return (
            np.concatenate([np.full(len(x[1]), x[0]) for x in hits]),
            np.concatenate([x[1] for x in hits]),
            np.concatenate([x[2] for x in hits]),
        )

    return search


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 256, effort: float = 4.0, scored: float = 0.25, seed: int = 17,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest rows found for each row whose id `every` divides, by inner product.

    Every row is indexed, in blocks of about 16,384 rows of width 64. Trees ascend together
    until they hold `effort` entries for each row of the block, counted once in each tree that
    yields them. The candidates that most trees yield are scored exactly, at most the share `scored`
    of the block or ten for each neighbour asked for: more of either gives more recall. Neighbours are ranked by exact
    scores, ties by the smaller id.

    Vectors that are null, zero, or hold null or non-finite components, and null ids,
    take no part; rows that repeat both id and vector are one, rows that repeat only the id
    are rows of their own, each a query if the id is one; vectors of different lengths
    are not compared. Other columns are ignored. An empty table gives an empty result.
    """
    return top_k_in_blocks(
        finite_vectors(vectors, id_col, vector_col, nonzero=True), every, k, forest_search(trees, effort, seed, scored), "double"
    )
