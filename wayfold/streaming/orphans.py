"""The orphan buffer: visits wait for their opener tab's visit.

State is kept per opener tab in the state store, so it survives restarts. With
timeMode "ProcessingTime" a timer retries and expires waiting visits; with "None" they wait for
the parent only, which is what replays and tests use.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

TTL_MS = 60_000
RETRY_MS = 5_000
MAX_RETRIES = 5
#: How long a tab's last visit is remembered, with timers.
PARENT_TTL_MS = 86_400_000
OUT = "id string, parent_id string, state string, retries int"


class OrphanBuffer(StatefulProcessor):
    """Keyed by tab: remembers the tab's last visit, buffers children until there is one.

    Rows have key, id, is_child and arrived_ms. Emits one row for each child: attached with the
    parent's id, or expired after more than 60 s or 5 retries. Every child is emitted
    once. With timers a parent is forgotten a day after its tab's last visit, so state does not
    grow without end; without them there is no clock, and parents stay.
    """

    def __init__(self, timers: bool = False):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parent = handle.getValueState("parent", "id string", PARENT_TTL_MS if self.timers else None)
        self.waiting = handle.getListState("waiting", "id string, arrived_ms long, retries int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parent = self.parent.get()[0] if self.parent.exists() else None
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        got = pd.concat(list(rows)).sort_values(["arrived_ms", "id"])
        own = got["id"].where(~got["is_child"])
        seen = own.dropna()
        # a child takes the last parent before it, else the first that comes
        near = own.ffill().bfill() if parent is None else own.ffill().fillna(parent)
        child = got.assign(parent_id=near, state="attached", retries=0)[got["is_child"]]
        out = [child[child["parent_id"].notna()][["id", "parent_id", "state", "retries"]]]
        if len(seen):
            out.append(self._rows([(w[0], seen.iloc[0], "attached", w[2]) for w in waiting]))
            self.parent.update((seen.iloc[-1],))
            waiting = []
        late = child[child["parent_id"].isna()]
        waiting += zip(late["id"], map(int, late["arrived_ms"]), late["retries"].tolist(), strict=True)
        self._keep(waiting, timerValues)
        yield pd.concat([x for x in out if len(x)] or [self._rows([])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting = [(w[0], w[1], w[2] + 1) for w in self.waiting.get()] if self.waiting.exists() else []
        over = lambda w: now - w[1] > TTL_MS or w[2] >= MAX_RETRIES
        self._keep([w for w in waiting if not over(w)], timerValues)
        yield self._rows([(w[0], None, "expired", w[2]) for w in waiting if over(w)])

    def _keep(self, waiting: list, timers) -> None:
        if waiting:
            self.waiting.put(waiting)
            if self.timers:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + RETRY_MS)
        else:
            self.waiting.clear()

    @staticmethod
    def _rows(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "parent_id", "state", "retries"])

    def close(self) -> None:
        pass


def attach_orphans(visits: DataFrame, timers: bool = False) -> DataFrame:
    """A stream of visits (id, tab_id, opener_tab_id, ts) to a stream of attached or expired children.

    A visit is a parent under its own tab and a child under its opener's; tab 0 and
    negative tabs are tabs like others.
    """
    ship(visits.sparkSession)
    at = F.unix_millis("ts").alias("arrived_ms")
    parents = F.struct(F.col("tab_id").alias("key"), "id", F.lit(False).alias("is_child"), at)
    children = F.struct(F.col("opener_tab_id").alias("key"), "id", F.lit(True).alias("is_child"), at)
    events = visits.select(F.explode(F.array(parents, children)).alias("e")).select("e.*").where("key IS NOT NULL")
    return events.groupBy("key").transformWithStateInPandas(
        OrphanBuffer(timers), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if timers else "None"
    )


# ------------------------------------------------------------------ event time
TIMELINE = "tab long, id string, parent_id string, state string, retries int, at long"
#: Groups of tabs, each with a state of its own. Fixed, as a restarted stream must find its tabs where they were.
GROUPS = 256
_HELD = pa.schema([("tab", pa.int64()), ("at", pa.int64()), ("id", pa.string()), ("is_child", pa.bool_())])


def millis(ts: Column) -> Column:
    """Milliseconds of a time, halves away from zero, as SQL's epoch_ms has them."""
    return F.round(F.unix_micros(ts) / 1000).cast("long")


class OrphanTimeline(StatefulProcessor):
    """The orphan buffer on event time: what happens depends on the visits' own times, not on when a job runs.

    Keyed by a group of tabs, so a call to the state store serves many of them; rows have tab, id, is_child and at (milliseconds). A
    child takes the last parent of its tab at or before its time that is remembered, else waits for the first later one. It is tried
    every `retry_ms`, `max_retries` times at most, and is too old once more than `ttl_ms` have passed, so it waits for the shorter
    of both, its last moment included. The group's timer, at the first moment that anything ends, expires it once the
    watermark is later. Parents are forgotten `parent_ttl_ms` after their time.
    """

    def __init__(self, ttl_ms: int = TTL_MS, retry_ms: int = RETRY_MS, max_retries: int = MAX_RETRIES, parent_ttl_ms: int = PARENT_TTL_MS):
        self.retry_ms, self.parent_ttl_ms = retry_ms, parent_ttl_ms
        self.patience = min(ttl_ms, retry_ms * max_retries)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")  # Arrow's stream format, so one value is read and written
        self.next = handle.getValueState("next", "at long")

    def _match(self, at: int, parents: list) -> tuple | None:
        i = bisect_right(parents, (at, "\U0010ffff"))
        if i and at - parents[i - 1][0] <= self.parent_ttl_ms:
            return parents[i - 1][1], 0
        if i < len(parents) and parents[i][0] - at <= self.patience:
            return parents[i][1], (parents[i][0] - at) // self.retry_ms
        return None

    def _settle(self, rows: list, timers, fired: bool) -> pd.DataFrame:
        """Attach or expire what can be, keep the rest, and forget old parents."""
        now, out, left, ends = timers.getCurrentWatermarkInMs(), [], [], []
        tabs: dict[int, tuple[list, list]] = {}
        for tab, at, visit, is_child in (*rows, *self._load()):
            tabs.setdefault(tab, ([], []))[is_child].append((at, visit))
        for tab, (parents, waiting) in tabs.items():
            parents.sort()
            for at, child in waiting:
                found = self._match(at, parents)
                if found:
                    out.append((tab, child, found[0], "attached", found[1], at))
                elif at + self.patience < now:
                    out.append((tab, child, None, "expired", self.patience // self.retry_ms, at))
                else:
                    left.append((tab, at, child, True))
                    ends.append(at + self.patience)
            kept = [(tab, at, visit, False) for at, visit in parents if now - at <= self.parent_ttl_ms]
            left += kept
            ends += [at + self.parent_ttl_ms for _, at, _, _ in kept[:1]]
        self._store(left)
        self._wake(min(ends, default=None), fired)
        return pd.DataFrame(out, columns=["tab", "id", "parent_id", "state", "retries", "at"])

    def _load(self) -> Iterator[tuple]:
        if not self.held.exists():
            return iter(())
        held = pa.ipc.open_stream(bytes(self.held.get()[0])).read_all()
        return zip(*(c.to_pylist() for c in held.columns), strict=True)

    def _store(self, rows: list) -> None:
        if not rows:
            self.held.clear()
            return
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HELD, strict=True)], schema=_HELD)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD) as out:
            out.write_batch(batch)
        self.held.update((sink.getvalue().to_pybytes(),))

    def _wake(self, end: int | None, fired: bool) -> None:
        """One timer a group."""
        old = self.next.get()[0] if self.next.exists() else None
        if old is not None and old != end and not fired:
            self.handle.deleteTimer(old)
        if end is None:
            self.next.clear()
        elif old != end or fired:
            self.handle.registerTimer(end)
            self.next.update((end,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = [zip(part["tab"].tolist(), part["at"].tolist(), part["id"], part["is_child"].tolist(), strict=True) for part in rows]
        yield self._settle([r for part in got for r in part], timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle([], timerValues, True)

    def close(self) -> None:
        pass


def orphan_timeline(visits: DataFrame, late: str = "1 minute", groups: int = GROUPS, **knobs: int) -> DataFrame:
    """A stream of visits (id, tab_id, opener_tab_id, ts) to a stream of its children, each once: attached, with the retries it took, or expired.

    Children not emitted are still waiting. Tabs are dealt into `groups`, which bound the tasks. Knobs are those of `OrphanTimeline`.
    """
    ship(visits.sparkSession)
    parents = F.struct(F.col("tab_id").alias("tab"), "id", F.lit(False).alias("is_child"))
    children = F.struct(F.col("opener_tab_id").alias("tab"), "id", F.lit(True).alias("is_child"))
    events = (
        # the watermark has the milliseconds that visits are compared by
        visits.withColumn("at", millis(F.col("ts"))).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
        .select("ts", "at", F.explode(F.array(parents, children)).alias("e")).select("ts", "at", "e.*").where("tab IS NOT NULL")
        .withColumn("grp", F.pmod(F.xxhash64("tab"), F.lit(groups)).cast("int"))
    )
    return events.groupBy("grp").transformWithStateInPandas(OrphanTimeline(**knobs), outputStructType=TIMELINE, outputMode="Append", timeMode="EventTime")


def waiting_stats(waiting: DataFrame, now_ms: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """(tab, orphans, oldest_age_ms) of waiting children (tab, at): those of more than `ttl_ms` are evicted before anything is counted."""
    age = now_ms - F.col("at")
    return waiting.where(age <= ttl_ms).groupBy("tab").agg(F.count("*").alias("orphans"), F.max(age).alias("oldest_age_ms"))
