"""Keyed state with event-time timers (STA-08, STA-09, STA-10, STA-17).

Each operator keeps one small state a key and one timer, set to the next thing
that would be told. Rows of a key come to the function in batches and are read
in the order of their times; a row that is older than the key's last one is
late and changes nothing. What is due before a row is told before the row is
read, with the time that it was due, so the result does not depend on how rows
were dealt to batches. What no later row tells, the timer does once the
watermark has passed it. State and timers live in the stream's checkpoint: a
restart goes on from there. A batch holds a key's times in memory, 9 bytes a
row; files per trigger bound it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_HOUR, _DAY = 3_600_000_000, 86_400_000_000
NEVER = np.iinfo(np.int64).max


class Told(NamedTuple):
    """What a step leaves: the state, what it told as (time, event), and when
    the next thing is due."""

    state: tuple
    events: list[tuple[int, str]]
    due: int


def _followed(stream: DataFrame, key: str, at: str, code: Column, late: str, kinds: str, start: tuple, step: Callable[[tuple, int, int | None], Told]) -> DataFrame:
    """(key, at, event): step(state, time in microseconds, code) for each row of
    a key in order, and step(state, time, None) for the passing of a time. The
    first field of a state is its last row's time."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = state.get if state.exists else start, []
        parts = [(f["_at"].to_numpy(), f["_code"].to_numpy()) for f in frames]
        times = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        codes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int8)
        due = NEVER
        for i in np.lexsort((codes, times)).tolist():
            if times[i] >= held[0]:
                held, events, due = step(held, int(times[i]), int(codes[i]))
                out += events
        passed = state.getCurrentWatermarkMs() * 1000
        if due == NEVER or due <= passed:
            held, events, due = step(held, passed, None)
            out += events
        state.update(held)
        if due < NEVER:
            state.setTimeoutTimestamp(max(due // 1000, passed // 1000 + 1))
        told = pd.DataFrame(out, columns=["at", "event"])
        if out:
            yield pd.DataFrame({key: [keys[0]] * len(out), "at": pd.to_datetime(told["at"], unit="us", utc=True), "event": told["event"]})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(at, late).select(F.col(key), F.col(at), F.unix_micros(at).alias("_at"), code.cast("tinyint").alias("_code"))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, at timestamp, event string", kinds, "append", GroupStateTimeout.EventTimeTimeout)


def watch_runs(stream: DataFrame, key: str, at: str, failed: Column, limit: int = 3, stale_hours: float = 6.0, late: str = "1 hour") -> DataFrame:
    """(key, at, event) of sources' runs (STA-08, STA-17): `down` at the failure
    that makes `limit` in a row, `recovered` at the next run that succeeds;
    `silent` when no run came for `stale_hours`, `back` at the next one."""
    stale = int(stale_hours * _HOUR)

    def step(state: tuple, now: int, code: int | None) -> Told:
        last, streak, told, silent = state
        events = []
        if last > 0 and not silent and (now > last + stale or code is None and now >= last + stale):
            events.append((last + stale, "silent"))
            silent = True
        if code is None:
            return Told((last, streak, told, silent), events, NEVER if silent else last + stale)
        if silent:
            events.append((now, "back"))
        streak = streak + 1 if code else 0
        if streak == limit and not told:
            events.append((now, "down"))
        elif told and not code:
            events.append((now, "recovered"))
        return Told((now, streak, streak >= limit or told and bool(code), False), events, now + stale)

    return _followed(stream, key, at, failed, late, "last long, streak int, told boolean, silent boolean", (0, 0, False, False), step)


def remind(stream: DataFrame, key: str, at: str, opens: Column, closes: Column, stages: tuple[int, ...] = (7, 21), late: str = "1 hour") -> DataFrame:
    """(key, at, event) of open matters (STA-09, STA-10): `day N` when N days
    have passed since the key's first opening row, each stage once, none after
    a closing row. What comes after that changes nothing."""

    def step(state: tuple, now: int, code: int | None) -> Told:
        last, opened, sent, closed = state
        due = lambda: opened + stages[sent] * _DAY if opened and not closed and sent < len(stages) else NEVER
        events = []
        while due() <= now:
            events.append((due(), f"day {stages[sent]}"))
            sent += 1
        if code == 1 and not opened:
            opened = now
        elif code == 2 and opened:
            closed = True
        return Told((last if code is None else now, opened, sent, closed), events, due())

    code = F.when(opens, 1).when(closes, 2).otherwise(0)
    return _followed(stream, key, at, code, late, "last long, opened long, sent int, closed boolean", (0, 0, 0, False), step)
