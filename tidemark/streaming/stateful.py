"""Stateful operators on an arriving stream: filters, forward fill, integral, keyed by channel.

A channel's state is a few numbers and its reorder buffer. Rows wait there
until they are older by ``delay_s`` than the newest row of their channel, or
than the stream's watermark where it has one, and are then worked on in order
of time, so rows may arrive in any order within the delay, across any batches.
A row that is older than what has been released goes out at once, unchanged
and marked late, for a side table. Without a delay rows are ordered within a
micro-batch and released with it.

The filters need the next timestamp of a row, so one row more is held back
until the next one arrives. A row with ``ends`` true is its channel's last:
it releases all that waits and closes the channel.

A channel's rows of one micro-batch, and those that wait, are one task's and
in memory, as Spark sorts no stream: bound the batches (maxFilesPerTrigger,
maxBytesPerTrigger), as ``ingest.in_time_order`` does.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "channel string, seq long, ts_ns long, value double, late boolean"
_STATE = "newest long, released long, ts array<long>, seq array<long>, x array<double>, ends array<boolean>, longs array<long>, doubles array<double>"
_LEAST = -(1 << 63)

#: A row in order: ts_ns, seq, value, ends. A result: seq, ts_ns, value.
Row = tuple[int, int, float, bool]
Result = tuple[int, int, float]


class Step(Protocol):
    """An operator over a channel's rows in order; its state is two lists of numbers, empty ones at the channel's start."""

    def run(self, rows: Iterable[Row], longs: list[int], doubles: list[float]) -> tuple[list[Result], list[int], list[float]]: ...


class Lag:
    """First-order low pass (or its complement), some stages over."""

    def __init__(self, tau: float, stages: int, high: bool):
        if tau <= 0 or stages < 1:
            raise ValueError("tau must be positive and there must be a stage")
        self.tau, self.stages, self.high = tau, stages, high

    def _advance(self, x: float, dt: float | None, states: list[float]) -> float:
        for k in range(self.stages):
            if dt is None:
                states[k] = x
            else:
                a = dt / (self.tau + dt)
                states[k] = a * x + (1.0 - a) * states[k]
            x = x - states[k] if self.high else states[k]
        return x

    def run(self, rows, longs, doubles):
        out: list[Result] = []
        seen = bool(longs)
        before, t, seq = longs if seen else (0, 0, 0)
        x, *states = doubles if seen else (0.0, *[math.nan] * self.stages)
        started = seen and not math.isnan(states[0])
        for ts, number, value, ends in rows:
            if seen:
                out.append((seq, t, self._advance(x, (ts - before) * 0.5e-9 if started else None, states)))
                before, started = t, True
            else:
                seen, states = True, [math.nan] * self.stages
            t, seq, x = ts, number, value
            if not started:
                before = t
            if ends:
                out.append((seq, t, self._advance(x, (t - before) * 1e-9 if started else None, states)))
                seen, started = False, False
        return (out, [before, t, seq], [x, *states]) if seen else (out, [], [])


class Fill:
    """The last value that isn't the marker."""

    def __init__(self, fill: float, tolerance: float):
        self.fill, self.tolerance = fill, abs(tolerance)

    def run(self, rows, longs, doubles):
        out: list[Result] = []
        for ts, number, value, ends in rows:
            same = value == self.fill if not self.tolerance else abs(value - self.fill) <= self.tolerance
            if not same:
                doubles = [value]
            out.append((number, ts, doubles[0] if doubles else value))
            doubles = [] if ends else doubles
        return out, [], doubles


class Area:
    """Cumulative trapezoid area."""

    def run(self, rows, longs, doubles):
        out: list[Result] = []
        for ts, number, value, ends in rows:
            area = doubles[1] + 0.5 * (value + doubles[0]) * ((ts - longs[0]) * 1e-9) if longs else 0.0
            longs, doubles = ([], []) if ends else ([ts], [value, area])
            out.append((number, ts, area))
        return out, longs, doubles


def in_order(stream: DataFrame, step: Step, delay_s: float = 0.0, idle_s: float | None = None) -> DataFrame:
    """``step`` over (channel, seq, ts_ns, value[, ends]), rows reordered within ``delay_s``; late rows are passed on marked.

    With a delay the stream gets a watermark of it, so channels that fall
    silent are released as others go on: with their next row, or, with
    ``idle_s``, after so many seconds of the clock without one. Such a timer
    keeps a query running batches until it is stopped, so it is for those
    that run on, not for those that end with their input.
    """
    if delay_s < 0:
        raise ValueError("the delay must not be negative")
    delay = int(delay_s * 1e9)
    columns = ["channel", "seq", "ts_ns", "value", F.col("ends") if "ends" in stream.columns else F.lit(False).alias("ends")]
    rows = stream.select(*columns)
    if delay:
        rows = rows.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", f"{delay // 1000} microseconds")

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, released, *held, longs, doubles = state.get if state.exists else (_LEAST, _LEAST, [], [], [], [], [], [])
        ts, seq, x, ends = (np.array(h, k) for h, k in zip(held, (np.int64, np.int64, float, bool), strict=True))
        longs, doubles, late = list(longs), list(doubles), []
        if delay:
            released = max(released, state.getCurrentWatermarkMs() * 1_000_000)
        if not state.hasTimedOut:
            new = pd.concat(list(batches))
            t = new["ts_ns"].to_numpy(np.int64)
            too_late = t < released
            late = [(key[0], *r, True) for r in new.loc[too_late, ["seq", "ts_ns", "value"]].itertuples(index=False)]
            new, t = new[~too_late], t[~too_late]
            ts, seq = np.concatenate((ts, t)), np.concatenate((seq, new["seq"].to_numpy(np.int64)))
            x, ends = np.concatenate((x, new["value"].to_numpy(float))), np.concatenate((ends, new["ends"].to_numpy(bool)))
            newest = max(newest, int(t.max(initial=_LEAST)))
        bound = max(released, newest - delay) if newest > _LEAST + delay else released
        if ends.any():
            bound = newest
        order = np.lexsort((seq, ts))
        go = order[(ts[order] < bound) if delay and not ends.any() else (ts[order] <= bound)]
        out, longs, doubles = step.run(zip(ts[go].tolist(), seq[go].tolist(), x[go].tolist(), ends[go].tolist(), strict=True), longs, doubles)
        wait = np.ones(len(ts), bool)
        wait[go] = False
        state.update((int(newest), int(bound), ts[wait].tolist(), seq[wait].tolist(), x[wait].tolist(), ends[wait].tolist(), longs, doubles))
        if idle_s is not None and wait.any():
            state.setTimeoutDuration(int(idle_s * 1000))
        rows = [(key[0], *r, False) for r in out] + late
        yield pd.DataFrame(rows, columns=["channel", "seq", "ts_ns", "value", "late"]).astype({"seq": "int64", "ts_ns": "int64", "value": "float64", "late": "bool"})

    timeout = GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("channel").applyInPandasWithState(work, OUT, _STATE, "append", timeout)


def lag_stages(stream: DataFrame, tau: float, stages: int = 1, high: bool = False, delay_s: float = 0.0, idle_s: float | None = None) -> DataFrame:
    """The first-order low pass (or its complement), ``stages`` times over, as in batch."""
    return in_order(stream, Lag(tau, stages, high), delay_s, idle_s)


def forward_fill(stream: DataFrame, fill: float = 0.0, tolerance: float = 0.0, delay_s: float = 0.0, idle_s: float | None = None) -> DataFrame:
    return in_order(stream, Fill(fill, tolerance), delay_s, idle_s)


def integral(stream: DataFrame, delay_s: float = 0.0, idle_s: float | None = None) -> DataFrame:
    return in_order(stream, Area(), delay_s, idle_s)


def marked_late(stream: DataFrame, delay_s: float) -> DataFrame:
    """``stream`` (channel, seq, ts_ns, value[, valid]), seq being the order of arrival, with column late.

    A row is late if it is older, by more than ``delay_s``, than the newest
    row of its channel that arrived before it. That newest time is state, so
    it outlives the query's restart; late rows go on marked, for a side table.
    A row that isn't valid makes no other row late and is itself never late.
    """
    delay = int(delay_s * 1e9)
    rows = stream.select("channel", "seq", "ts_ns", "value", F.col("valid") if "valid" in stream.columns else F.lit(True).alias("valid"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else _LEAST
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        ts, valid = rows["ts_ns"].to_numpy(), rows["valid"].to_numpy(bool)
        before = np.maximum.accumulate(np.concatenate(([newest], np.where(valid, ts, _LEAST))))
        state.update((int(before[-1]),))
        late = valid & (ts < np.maximum(before[:-1], delay + _LEAST) - delay)
        yield pd.DataFrame({"channel": key[0], "seq": rows["seq"].to_numpy(), "ts_ns": ts, "value": rows["value"].to_numpy(), "valid": valid, "late": late})

    schema = "channel string, seq long, ts_ns long, value double, valid boolean, late boolean"
    return rows.groupBy("channel").applyInPandasWithState(step, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def overrun_events(stream: DataFrame, tick_s: float) -> DataFrame:
    """(channel, tick_ns, overruns, rise): a row for every tick in which a channel's overruns grew, with their number so far.

    ``stream`` is (channel, ts_ns, valid[, ends]). Time is cut into ticks; a
    tick is done when a row of a later one arrives, or with a row that ends
    the channel. A row of an earlier tick than the newest counts in that.
    What has been told is state, so a restart repeats no event.
    """
    tick = int(tick_s * 1e9)
    if tick <= 0:
        raise ValueError("the tick must be positive")
    rows = stream.select("channel", "ts_ns", "valid", F.col("ends") if "ends" in stream.columns else F.lit(False).alias("ends"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, overruns, told = state.get if state.exists else (_LEAST, 0, 0)
        rows = pd.concat(list(batches)).sort_values("ts_ns", kind="stable")
        number = np.maximum(rows["ts_ns"].to_numpy() // tick, at)
        bad = pd.Series(~rows["valid"].to_numpy(bool)).groupby(number).sum()
        out = []
        for n, more in zip(bad.index.tolist(), bad.tolist(), strict=True):
            if n > at and overruns > told:
                out.append((key[0], at * tick, overruns, overruns - told))
                told = overruns
            at, overruns = n, overruns + int(more)
        if rows["ends"].any() and overruns > told:
            out.append((key[0], at * tick, overruns, overruns - told))
            told = overruns
        state.update((int(at), overruns, told))
        yield pd.DataFrame(out, columns=["channel", "tick_ns", "overruns", "rise"]).astype({"tick_ns": "int64", "overruns": "int64", "rise": "int64"})

    return rows.groupBy("channel").applyInPandasWithState(step, "channel string, tick_ns long, overruns long, rise long", "tick long, overruns long, told long", "append", GroupStateTimeout.NoTimeout)
