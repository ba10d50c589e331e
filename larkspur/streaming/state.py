"""The event fold of the queue: one reducer, run in batch and in Structured Streaming.

Events are rows (entity, seq, kind, a, b). The entity names what an event changes (a task key, a launcher, a
rendezvous group, a session, a proxy or a node), so every entity folds on its own, in order of seq. The state of an
entity is a small JSON object. Batch and streaming use the same ``reduce``; they give the same state where no event is later than
the stream is told to wait for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "entity string, state string, n_events long"
STATE_COLUMNS = "state string, n_events long, last long, kept string"


def reduce(state: dict[str, Any], kind: str, a: str | None, b: str | None) -> dict[str, Any]:
    """The state after an event; the meaning of a and b depends on its kind."""
    s = dict(state)
    status = s.get("status")
    if kind == "Enqueued":  # a: proxy, b: task
        s["proxies"] = sorted({*s.get("proxies", []), *([a] if a else [])})
        s["task"] = b
        if status != "scheduled":  # a key that is scheduled only gets another waiter
            s["status"] = "queued"
    elif kind == "ProxyAdded":
        s["proxies"] = sorted({*s.get("proxies", []), *([a] if a else [])})
        if b is not None:
            s["task"] = b
    elif kind == "TaskScheduled":  # a: launcher, b: allocation; only a queued key can be scheduled
        if status == "queued":
            s |= {"status": "scheduled", "launcher": a, "allocated": b}
    elif kind in ("TaskDone", "TaskFailed"):  # also ends a key that was queued again meanwhile
        s = {"ended": kind} if status in ("queued", "scheduled") else s
    elif kind in ("TaskStopped", "CacheHit"):
        s = {} if status == "scheduled" else s
    elif kind == "Incremented":
        s["counter"] = s.get("counter", 0) + 1
    elif kind == "LauncherJoined":
        s["node"] = a
    elif kind == "LauncherCrashed":
        s = {}
    elif kind == "RendezvousJoined":  # a: rank, b: payload
        s["joined"] = {**s.get("joined", {}), a: b}
    elif kind == "RendezvousRead":  # a: reader, b: world size; the group ends when all have read
        if "joined" in s:
            s["readers"] = sorted({*s.get("readers", []), a})
            if len(s["readers"]) >= int(b):
                s = {}
    elif kind == "ResultStored":
        s["result"] = a
    elif kind == "ResultDelivered":
        s.pop("result", None)
    elif kind == "SessionDropped":  # a: session; waiters and results of that session go, submissions stay
        s["proxies"] = [p for p in s.get("proxies", []) if not p.startswith(f"{a}~")]
        s.pop("result", None) if s.get("owner") == a else None
    elif kind == "MainJoined":
        s["here"] = True
    elif kind == "MainLeft":
        s.pop("here", None)
    elif kind == "NodeRequested":  # a: shape
        s["requested"] = s.get("requested", 0) + 1
        s["in_flight"] = [a, *s.get("in_flight", [])]
    elif kind == "NodeRequestFailed":
        s["in_flight"] = _without_first(s.get("in_flight", []), a)
    elif kind == "NodeIsPending":  # a: committed shape, b: node
        s["in_flight"] = _without_first(s.get("in_flight", []), a)
        s["pending"] = sorted({*s.get("pending", []), b})
    elif kind == "NodeIsUp":
        s["pending"] = [x for x in s.get("pending", []) if x != b]
        s["running"] = sorted({*s.get("running", []), b})
    elif kind == "NodeIsDown":
        s["running"] = [x for x in s.get("running", []) if x != b]
    elif kind == "InitFailed":
        s["pending"] = [x for x in s.get("pending", []) if x != b]
    elif kind == "AllStop":  # what was ever requested stays counted
        s = {"requested": s.get("requested", 0)}
    return s


def _without_first(items: list, item: Any) -> list:
    return items[: items.index(item)] + items[items.index(item) + 1 :] if item in items else items


def _none(x: Any) -> Any:
    return None if x is None or x != x else x


def _text(state: dict) -> str:
    return json.dumps(state, sort_keys=True, separators=(",", ":"))


def fold(events: DataFrame) -> DataFrame:
    """(entity, state, n_events) after all events, as a sorted stream in each partition: no entity is held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, n = None, {}, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if n and r.entity != now:
                    out.append((now, _text(state), n))
                    state, n = {}, 0
                now = r.entity
                state, n = reduce(state, r.kind, _none(r.a), _none(r.b)), n + 1
            yield pd.DataFrame(out, columns=["entity", "state", "n_events"])
        if n:
            yield pd.DataFrame([(now, _text(state), n)], columns=["entity", "state", "n_events"])

    cols = events.select("entity", "seq", "kind", "a", "b")
    return cols.repartition("entity").sortWithinPartitions("entity", "seq").mapInPandas(run, STATE)


def fold_stream(events: DataFrame, reorder: int = 0) -> DataFrame:
    """The same over a stream, in update mode: the state of each entity that changed in a micro-batch.

    Events of an entity are applied in order of seq within a micro-batch. The last ``reorder`` events of an entity are kept beside the
    state they led to, so an event that comes late by no more events than that is still applied in its place, as the batch fold
    does; a later one, or one that came before, is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        # the state without the kept events, how many it holds, the last of them; the kept ones
        text, n, last, kept = held.get if held.exists else ("{}", 0, -(1 << 62), "[]")
        pending = {e[0]: e for e in json.loads(kept)}
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.seq > last:
                    pending.setdefault(int(r.seq), [int(r.seq), r.kind, _none(r.a), _none(r.b)])
        base, rows = json.loads(text), [pending[k] for k in sorted(pending)]
        cut = max(0, len(rows) - reorder)
        for seq, kind, a, b in rows[:cut]:
            base, last = reduce(base, kind, a, b), seq
        state = base
        for _, kind, a, b in rows[cut:]:
            state = reduce(state, kind, a, b)
        held.update((_text(base), n + cut, last, json.dumps(rows[cut:])))
        yield pd.DataFrame([(key[0], _text(state), n + len(rows))], columns=["entity", "state", "n_events"])

    cols = events.select("entity", "seq", "kind", "a", "b")
    return cols.groupBy("entity").applyInPandasWithState(run, STATE, STATE_COLUMNS, "update", "NoTimeout")


def launcher_counters(events: DataFrame) -> DataFrame:
    """(launcher, n): how often each launcher was heard of; the first time counts 1."""
    return events.where("kind = 'Incremented'").groupBy(F.col("entity").alias("launcher")).agg(F.count("*").alias("n"))


def dead_launchers(samples: DataFrame) -> DataFrame:
    """(launcher, moment) for samples (launcher, moment, counter): whose counter did not change since the sample before."""
    before = F.lag("counter").over(Window.partitionBy("launcher").orderBy("moment"))
    return samples.withColumn("_before", before).where("counter = _before").groupBy("launcher").agg(F.min("moment").alias("moment"))


def silent_launchers(samples: DataFrame, interval: int) -> DataFrame:
    """(launcher, moment) for samples (launcher, moment, counter): the first sample that finds a counter unchanged for two intervals.

    Counters only grow, so the samples of one counter stand together: they are grouped, not sorted by launcher.
    """
    since = samples.groupBy("launcher", "counter").agg(F.min("moment").alias("_since"), F.max("moment").alias("_last")).where(F.col("_last") - F.col("_since") >= 2 * interval)
    late = samples.join(since, ["launcher", "counter"]).where(F.col("moment") - F.col("_since") >= 2 * interval)
    return late.groupBy("launcher").agg(F.min("moment").alias("moment"))


def watch_stream(beats: DataFrame, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """(launcher, counter, since) over a stream of beats (launcher, at timestamp, counter), in update mode: launchers whose counter stood
    still for two intervals of ``seconds`` of event time.

    Each launcher has a timer that a new counter sets anew; it fires when the watermark passes it. One that beats again later is watched again.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            counter, since = held.get
            held.remove()
            yield pd.DataFrame({"launcher": [key[0]], "counter": [counter], "since": [pd.Timestamp(since, unit="us")]})
            return
        counter, since = held.get if held.exists else (None, None)
        for batch in batches:
            for r in batch.sort_values("at").itertuples(index=False):
                if counter is None or r.counter > counter:
                    counter, since = int(r.counter), int(r.at.value // 1000)
        held.update((counter, since))
        due = since // 1000 + 2 * seconds * 1000
        if due > held.getCurrentWatermarkMs():
            held.setTimeoutTimestamp(due)
        else:  # known too late for a timer
            held.remove()
            yield pd.DataFrame({"launcher": [key[0]], "counter": [counter], "since": [pd.Timestamp(since, unit="us")]})

    cols = beats.withWatermark("at", lateness).select("launcher", "at", "counter")
    kind = dict(beats.dtypes)["launcher"]
    return cols.groupBy("launcher").applyInPandasWithState(run, f"launcher {kind}, counter long, since timestamp", "counter long, since long", "update", "EventTimeTimeout")


def requeued(scheduled: DataFrame, dead: DataFrame) -> DataFrame:
    """Submissions of dead launchers, to be queued again."""
    return scheduled.join(dead.select("launcher").distinct(), "launcher", "left_semi")


def last_event(events: DataFrame, entity: str = "entity", order: str = "seq", kind: str = "kind") -> DataFrame:
    """(entity, kind): the last event of each entity."""
    return events.groupBy(entity).agg(F.max_by(kind, order).alias(kind))


def late_completions(events: DataFrame) -> DataFrame:
    """(entity, seq): completions of a key that was queued again after its last scheduling; they still end it."""
    w = Window.partitionBy("entity").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("kind").isin("Enqueued", "TaskScheduled"), F.col("kind")), ignorenulls=True).over(w)
    return events.withColumn("_before", before).where("kind = 'TaskDone' and _before = 'Enqueued'").select("entity", "seq")


def pending_timeouts(pending: DataFrame, now: int, seconds: int) -> DataFrame:
    """(node): nodes pending since (node, since) for longer than allowed; they are given up."""
    return pending.where(F.lit(now) - F.col("since") > seconds).select("node")


def sessions_left(events: DataFrame) -> DataFrame:
    """(session) that joined and did not leave since; when there is none, the last one out clears the state."""
    return last_event(events, "session").where("kind = 'MainJoined'").select("session")


def drop_session(waiting: DataFrame, session: str, proxy: str = "proxy") -> DataFrame:
    """Waiters that do not belong to a session."""
    return waiting.where(~F.col(proxy).startswith(f"{session}~"))
