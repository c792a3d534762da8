"""Keyed state that expires and can be seeded: traces' scopes and slots' versions by ``transformWithStateInPandas``.

State lives in a RocksDB store. A key's timer is set ``idle`` after its latest event; once the watermark has
passed it, the key's state goes and the sink is told what it was, so that a later run can be seeded with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from recollect.operators.traces import KINDS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACE_ID = re.compile(r"[A-Za-z0-9_-]{1,128}")
LEFT_OPEN = 0  # the timer of a key that never expires

INGESTED = "trace_id string, event_id long, status string, scope string"
FOLDED = "scope string, slot string, seq long, status string, version long"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _millis(idle: timedelta | None) -> int:
    return int(idle / timedelta(milliseconds=1)) if idle else LEFT_OPEN


class _Expiring(StatefulProcessor):
    """State of one row, with a timer ``idle`` milliseconds after the key's latest event; subclasses fold the rows."""

    def __init__(self, idle: int, schema: str):
        self.idle, self.schema = idle, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)
        self.due = handle.getValueState("due", "at long")

    def close(self) -> None:
        pass

    def held(self) -> Any:
        return self.state.get()[0] if self.state.exists() else None

    def wait_on(self, millis: pd.Series) -> None:
        """Moves the key's one timer to ``idle`` after its latest event so far."""
        latest = millis.max()
        if not self.idle or pd.isna(latest):
            return
        at = int(latest) + self.idle
        if self.due.exists():
            before = self.due.get()[0]
            if before >= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def expire(self) -> Any:
        last = self.held()
        self.state.clear()
        self.due.clear()
        return last


class TraceScopes(_Expiring):
    """A trace's scope is that of its first good event with a scope; later events of other scopes are denied."""

    def __init__(self, idle: int):
        super().__init__(idle, "scope string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.state.update((initialState["scope"].iloc[0],))
        self.wait_on(initialState["at"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        named = bool(TRACE_ID.fullmatch(key[0] or ""))
        frames = [frame[["event_id", "scope", "kind", "created_at", "at"]] for frame in rows]  # ids, times and scopes of one trigger
        frame = pd.concat(frames)
        good = frame["kind"].isin(KINDS) & named
        scope, opening = self.held(), frame[good & frame["scope"].notna()]
        if scope is None and len(opening):
            scope = opening.sort_values(["created_at", "event_id"])["scope"].iloc[0]
            self.state.update((scope,))
        if scope is not None:
            self.wait_on(frame["at"])
        status = (frame["scope"] == scope).map({True: "ok", False: "scope_denied"}).where(good, "invalid")
        yield pd.DataFrame({"trace_id": key[0], "event_id": frame["event_id"], "status": status, "scope": frame["scope"]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"trace_id": [key[0]], "event_id": pd.Series([None], dtype="Int64"), "status": ["expired"], "scope": [self.expire()]})


class SlotVersions(_Expiring):
    """A slot's version advances with each good compare-and-set write, in order of seq within a trigger."""

    def __init__(self, idle: int):
        super().__init__(idle, "version long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.state.update((int(initialState["version"].iloc[0]),))
        self.wait_on(initialState["at"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        version = self.held() or 0
        frame = pd.concat(rows).sort_values("seq")
        told = []
        for good, fresh, expected in zip(frame["good"], frame["create_only"], frame["expected_version"]):
            if not good:
                status = "invalid_body"
            elif fresh is True and version > 0:
                status = "exists"
            elif not pd.isna(expected) and expected != version:
                status = "version_conflict"
            else:
                status, version = "ok", version + 1
            told.append((status, version))
        self.state.update((version,))
        self.wait_on(frame["at"])
        statuses, versions = zip(*told)
        yield pd.DataFrame({"scope": key[0], "slot": key[1], "seq": frame["seq"].to_numpy(), "status": statuses, "version": versions})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = {"scope": [key[0]], "slot": [key[1]], "seq": pd.Series([None], dtype="Int64"), "status": ["expired"], "version": [self.expire()]}
        yield pd.DataFrame(last)


def keyed_ingest(events: DataFrame, late: str = "1 hour", idle: timedelta | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """(trace_id, event_id, status, scope) of each event (trace_id, event_id, scope, kind, created_at) of a stream, once.

    Repeats within the watermark are dropped. A bad trace_id or kind is ``invalid``, as in a batch, and opens no
    trace; nor does an event without a scope, which is denied. Of one trigger's events the first by (created_at, event_id) opens the
    trace. With ``idle``, a trace is forgotten once the watermark is so much past its latest event, and a row
    without event_id and with status ``expired`` tells its scope. ``scopes`` (trace_id, scope, created_at) is
    what a new query knows beforehand; a restarted one has its own state.
    """
    once = events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"])
    at = F.unix_millis("created_at").alias("at")  # as timers have it, whatever the session's time zone
    rows = once.select("trace_id", "event_id", "scope", "kind", "created_at", at)
    known = None if scopes is None else scopes.select("trace_id", "scope", at).groupBy("trace_id")
    return rows.groupBy("trace_id").transformWithStateInPandas(TraceScopes(_millis(idle)), INGESTED, "Append", "EventTime", initialState=known)


def keyed_task_state(ops: DataFrame, late: str = "1 hour", idle: timedelta | None = None, versions: DataFrame | None = None) -> DataFrame:
    """(scope, slot, seq, status, version) of compare-and-set writes with created_at, as they arrive.

    The rules are those of a batch's fold. With ``idle``, a slot is forgotten once the watermark is so much
    past its latest write, and a row without seq and with status ``expired`` tells its version; a write after
    that finds a fresh slot. ``versions`` (scope, slot, version, created_at) is what a new query knows
    beforehand; a restarted one has its own state.
    """
    body = F.coalesce("body", F.lit(""))
    good = (F.trim(body).startswith("{") & (F.octet_length(body) <= 8192)).alias("good")
    at = F.unix_millis("created_at").alias("at")
    rows = ops.withWatermark("created_at", late).select("scope", "slot", "seq", "expected_version", "create_only", good, "created_at", at)
    known = None if versions is None else versions.select("scope", "slot", "version", at).groupBy("scope", "slot")
    return rows.groupBy("scope", "slot").transformWithStateInPandas(SlotVersions(_millis(idle)), FOLDED, "Append", "EventTime", initialState=known)
