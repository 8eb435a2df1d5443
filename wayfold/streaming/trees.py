"""Navigation trees kept while visits arrive."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

OUT = "owner string, id string, parent_id string, tree_id string, at long, is_new boolean"
_COLUMNS = ["owner", "id", "parent_id", "tree_id", "at", "is_new"]
#: Groups of owners, each with a state of its own. Fixed, as a restarted stream must find its owners where they were.
GROUPS = 1024
#: Pieces of a group's state, one for each micro-batch that brought something, before they are made one.
PIECES = 64
_HELD = pa.schema([("owner", pa.string()), ("id", pa.string()), ("parent", pa.string()), ("tree", pa.string()), ("at", pa.int64()), ("url", pa.string())])


class PrefixIndex:
    """The pages of one owner: their URLs in order, and for each URL its visits in time order."""

    def __init__(self, visits: Iterable[tuple[str, int, str, str]] = ()):
        self.visits: dict[str, list] = {}
        for url, at, visit, tree in visits:
            self.visits.setdefault(url, []).append((at, visit, tree))
        for times in self.visits.values():
            times.sort()
        self.urls = sorted(self.visits)

    def add(self, url: str, at: int, visit: str, tree: str) -> None:
        if url not in self.visits:
            insort(self.urls, url)
            self.visits[url] = []
        insort(self.visits[url], (at, visit, tree))

    def nearest(self, beginning: str, at: int) -> tuple[str, str] | None:
        """(id, tree) of the visit nearest in time whose URL begins so; equal gaps go to the later visit, then the larger id."""
        best = None
        for i in range(bisect_left(self.urls, beginning), len(self.urls)):
            if not self.urls[i].startswith(beginning):
                break
            visits = self.visits[self.urls[i]]
            j = bisect_right(visits, (at, "\U0010ffff"))
            around = [visits[j - 1]] if j else []
            if j < len(visits):
                last = bisect_right(visits, (visits[j][0], "\U0010ffff")) - 1
                around.append(visits[last])
            for when, visit, tree in around:
                found = (-abs(when - at), when, visit, tree)
                best = found if best is None or found > best else best
        return None if best is None else best[2:]


def rows_of(piece: pa.Table) -> Iterator[tuple]:
    """A table's rows as Python values, made a column at a time by NumPy: `to_pylist` makes a scalar of each value first and is slow."""
    return zip(*(c.to_numpy().tolist() for c in piece.columns), strict=True)


class TreeInsert(StatefulProcessor):
    """Keyed by a group of owners: gives each arriving visit its parent and its tree.

    An owner's visits of a micro-batch are taken by time, then id. A visit with a referrer joins the tree of the nearest visit
    so far whose URL begins with it; any other, and one whose referrer nobody has seen, roots a tree under its own id. An
    id that has been seen is answered as before, with is_new false, and changes nothing. A micro-batch reads a group's state once and adds
    one piece to it, in Arrow's stream format, so calls to the state store are as many as groups and not as visits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["owner", "at", "id"])
        pieces = [pa.ipc.open_stream(bytes(p[0])).read_all() for p in self.held.get()] if self.held.exists() else []
        past: dict[str, list] = {owner: [] for owner in got["owner"]}
        for piece in pieces:
            for owner, *visit in rows_of(piece):
                if owner in past:
                    past[owner].append(visit)
        arriving = zip(got["owner"], got["at"].tolist(), got["id"], got["url"], got["referrer"], strict=True)
        out, fresh = [], []
        for owner, visits in groupby(arriving, itemgetter(0)):
            known = {visit: (parent, tree, at) for visit, parent, tree, at, _ in past[owner]}
            index = PrefixIndex((url, at, visit, tree) for visit, _, tree, at, url in past[owner] if url is not None)
            for _, at, visit, url, referrer in visits:
                if visit in known:
                    out.append((owner, visit, *known[visit], False))
                    continue
                near = index.nearest(referrer, at) if referrer else None
                parent, tree = near or (None, visit)
                if url is not None:
                    index.add(url, at, visit, tree)
                known[visit] = (parent, tree, at)
                fresh.append((owner, visit, parent, tree, at, url))
                out.append((owner, visit, parent, tree, at, True))
        self._keep(pieces, fresh)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _keep(self, pieces: list[pa.Table], fresh: list[tuple]) -> None:
        if not fresh:
            return
        piece = pa.table([pa.array(c, f.type) for c, f in zip(zip(*fresh, strict=True), _HELD, strict=True)], schema=_HELD)
        whole = len(pieces) >= PIECES
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(pa.concat_tables([*pieces, piece]).combine_chunks() if whole else piece)
        row = (sink.getvalue().to_pybytes(),)
        if whole:
            self.held.put([row])
        else:
            self.held.appendValue(row)

    def close(self) -> None:
        pass


def insert_into_trees(visits: DataFrame, owner: str | Column = "tab_id", groups: int = GROUPS) -> DataFrame:
    """A stream of visits (id, url, referrer, ts and an owner) to a stream of their places in trees.

    The owner is whose browsing it is: parents are looked for among the owner's visits only, so owners are dealt into `groups`, which
    bound the tasks and spread over the cluster; a micro-batch reads the state of the groups that it touches. Visits without an id,
    a time or an owner are left out. Rows are owner, id, parent_id, tree_id, at (microseconds) and is_new.
    """
    ship(visits.sparkSession)
    own = (F.col(owner) if isinstance(owner, str) else owner).cast("string")
    rows = visits.select(own.alias("owner"), "id", F.unix_micros("ts").alias("at"), "url", "referrer").where(
        "owner IS NOT NULL AND id IS NOT NULL AND at IS NOT NULL"
    ).withColumn("grp", F.pmod(F.xxhash64("owner"), F.lit(groups)).cast("int"))
    return rows.groupBy("grp").transformWithStateInPandas(TreeInsert(), outputStructType=OUT, outputMode="Append", timeMode="None")


def kept_trees(placed: DataFrame) -> DataFrame:
    """(owner, tree_id, first_at, latest_at, members) of what `insert_into_trees` has written; repeats count once."""
    return placed.where("is_new").groupBy("owner", "tree_id").agg(
        F.min("at").alias("first_at"), F.max("at").alias("latest_at"), F.count("*").alias("members")
    )


def recent_members(placed: DataFrame, limit: int = 5, skip: int = 0) -> DataFrame:
    """Members of the most recently active kept trees, read off what was written: nothing is climbed again."""
    top = kept_trees(placed).orderBy(F.desc("latest_at"), "tree_id").offset(skip).limit(limit)
    return placed.where("is_new").join(F.broadcast(top.select("owner", "tree_id")), ["owner", "tree_id"], "left_semi")
