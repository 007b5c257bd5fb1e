"""Causal filters as affine scans over time slices, and their zero-phase form.

A filter's state after a slice is an affine function of the state before it.
Slices are run from a zero state in parallel, their transitions are composed
in order (one small row a slice), and a second parallel run starts from the
right states. A channel that fits one slice runs once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.frame import SignalFrame
from tidemark.functions import design as d
from tidemark.operators.kernels import ROWS_PER_SLICE, Sliced, neighbours, sliced
from tidemark.operators.windows import ends_sum, reverse

#: (rows in order, state before) -> (values, state after)
Run = Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray]]
_OUT = "channel string, seq long, ts_ns long, value double"


def _scan(s: Sliced, size: int, run: Run, transition: Callable[[pd.DataFrame], np.ndarray]):
    """Samples after a scan with a state of ``size`` numbers."""

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["ts_ns", "seq"], kind="stable")

    def once(rows: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        return rows.assign(value=run(rows, np.zeros(size))[0])[["channel", "seq", "ts_ns", "value"]]

    if not s.many:
        return s.df.groupBy("channel").applyInPandas(once, _OUT)

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        end = run(rows, np.zeros(size))[1]
        return pd.DataFrame({"channel": rows["channel"].iloc[:1], "slice": rows["slice"].iloc[:1], "a": [transition(rows).ravel().tolist()], "b": [end.tolist()]})

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, before = rows.sort_values("slice"), np.zeros(size), []
        for a, b in zip(rows["a"], rows["b"], strict=True):
            before.append(state.tolist())
            state = np.array(a).reshape(size, size) @ state + np.array(b)
        return pd.DataFrame({"channel": rows["channel"], "slice": rows["slice"], "before": before})

    def resume(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        return rows.assign(value=run(rows, np.array(states["before"].iloc[0]))[0])[["channel", "seq", "ts_ns", "value"]]

    keys = ["channel", "slice"]
    ends = s.df.groupBy(*keys).applyInPandas(summary, "channel string, slice long, a array<double>, b array<double>")
    states = ends.groupBy("channel").applyInPandas(compose, "channel string, slice long, before array<double>")
    return s.df.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(resume, _OUT)


#: Samples from which on a recurrence runs over pieces side by side.
PIECES_FROM = 256


def _pieces(n: int) -> tuple[int, int]:
    """Pieces and their length, near sqrt(n) both; what is left over is shorter than a piece more."""
    length = int(np.sqrt(n))
    return n // length, length


def run_affine(keep: np.ndarray, add: np.ndarray, y: float) -> np.ndarray:
    """y[i] = keep[i] * y[i - 1] + add[i], from ``y`` before the first.

    Pieces run side by side from zero, one numpy step a position; then what
    each begins with is carried along. Values that aren't finite run plainly.
    """
    n, done = len(add), 0
    out = np.empty(n)
    if n >= PIECES_FROM and np.isfinite(add).all() and np.isfinite(keep).all() and np.isfinite(y):
        m, size = _pieces(n)
        done = m * size
        k, b = keep[:done].reshape(m, size).T.copy(), add[:done].reshape(m, size).T.copy()
        for i in range(1, size):
            b[i] += k[i] * b[i - 1]
            k[i] *= k[i - 1]
        before = np.empty(m)
        for j in range(m):
            before[j], y = y, float(b[-1, j] + k[-1, j] * y)
        out[:done] = (b + k * before).T.ravel()
    for i in range(done, n):
        y = float(add[i]) if keep[i] == 0.0 else float(keep[i]) * y + float(add[i])
        out[i] = y
    return out


def _lag(f: SignalFrame, tau: float, high: bool, rows_per_slice: int) -> SignalFrame:
    if tau <= 0:
        raise ValueError("tau must be positive")
    s = neighbours(sliced(f.samples, rows_per_slice, f.longest))
    # Half the way from the neighbour before to the one after; the whole step at the last row.
    dt = (F.coalesce("next.ts_ns", "ts_ns") - F.col("prev.ts_ns")) * F.when(F.col("next").isNull(), 1e-9).otherwise(0.5e-9)
    # The first row takes the input as it is, whatever the state.
    alpha = F.when(F.col("prev").isNull(), 1.0).otherwise(dt / (tau + dt))
    s = Sliced(s.with_columns(alpha=alpha).df.drop("prev", "next"), s.many)

    def run(rows: pd.DataFrame, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, alpha = rows["value"].to_numpy(float), rows["alpha"].to_numpy(float)
        y = run_affine(1.0 - alpha, alpha * x, float(state[0]))
        return (x - y if high else y), y[-1:]

    return f.with_samples(_scan(s, 1, run, lambda rows: np.array([[np.prod(1.0 - rows["alpha"].to_numpy())]])))


def low_pass(f: SignalFrame, tau: float, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """First-order lag with time constant ``tau``; steps follow the actual sampling."""
    return _lag(f, tau, False, rows_per_slice)


def high_pass(f: SignalFrame, tau: float, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """The signal less its low pass; 0 at the first sample."""
    return _lag(f, tau, True, rows_per_slice)


def pt(f: SignalFrame, band: int, order: int, tau: float, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """``order`` equal first-order stages, low (band 0) or high (band 1)."""
    if band not in (d.LOW, d.HIGH):
        raise ValueError("one time constant makes no band: 0 is low, 1 is high")
    for _ in range(max(1, round(order))):
        f = _lag(f, tau, band == d.HIGH, rows_per_slice)
    return f


def _run_section(section: list[float], x: np.ndarray, s1: float, s2: float) -> tuple[np.ndarray, float, float]:
    b0, b1, b2, a1, a2 = section
    n, done, out = len(x), 0, np.empty(len(x))
    if n >= PIECES_FROM and np.isfinite(x).all() and np.isfinite(s1) and np.isfinite(s2):
        m, size = _pieces(n)
        done = m * size
        v = x[:done].reshape(m, size).T.copy()
        p, q, free, row = np.zeros(m), np.zeros(m), np.empty((size, 2)), np.array([1.0, 0.0])
        step = np.array([[-a1, 1.0], [-a2, 0.0]])
        for i in range(size):
            # free[i]: what a piece's first state adds to its output i.
            free[i], row = row, row @ step
            y = b0 * v[i] + p
            p, q = b1 * v[i] - a1 * y + q, b2 * v[i] - a2 * y
            v[i] = y
        whole, before = np.linalg.matrix_power(step, size), np.empty((2, m))
        for j in range(m):
            before[:, j] = s1, s2
            s1, s2 = float(whole[0, 0] * s1 + whole[0, 1] * s2 + p[j]), float(whole[1, 0] * s1 + whole[1, 1] * s2 + q[j])
        out[:done] = (v + free @ before).T.ravel()
    for i in range(done, n):
        v = float(x[i])
        y = b0 * v + s1
        s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
        out[i] = y
    return out, s1, s2


def run_sections(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cascade of second-order sections, two states a section, from the given state."""
    values, after = np.asarray(x, float), []
    for section, (s1, s2) in zip(sections.tolist(), state.reshape(-1, 2).tolist(), strict=True):
        values, s1, s2 = _run_section(section, values, s1, s2)
        after += [s1, s2]
    return values, np.array(after)


def step_matrix(sections: np.ndarray) -> np.ndarray:
    """What one sample without input makes of the cascade's state."""
    n = 2 * len(sections)
    return np.stack([run_sections(sections, np.zeros(1), unit)[1] for unit in np.eye(n)], axis=1)


def iir(f: SignalFrame, family: str, band: int, order: int, *edges: float, pass_db: float = 0.0, stop_db: float = 0.0, rows_per_slice: int = ROWS_PER_SLICE, times: SignalFrame | None = None) -> SignalFrame:
    """A recursive filter of the family; the sample rate is each channel's own mean rate.

    Channels with fewer than two samples pass unchanged. ``times`` is a frame
    of the same rates, where that is cheaper to read.
    """
    order, edges = max(1, round(order)), tuple(map(float, edges))
    d.check(family, band, order, edges, pass_db, stop_db)
    rate = (times or f).samples.groupBy("channel").agg(((F.count(F.lit(1)) - 1) / F.nullif((F.max("ts_ns") - F.min("ts_ns")) * F.lit(1e-9), F.lit(0.0))).alias("fs"), F.count(F.lit(1)).alias("n"))
    worst = rate.filter("n > 1").agg(F.min("fs"), F.max(F.col("fs").isNull().cast("int"))).first()
    if worst[1]:
        raise ValueError("timestamps must increase")
    if worst[0] is not None and max(edges) >= worst[0] / 2:
        raise ValueError(f"the cutoff must be below the Nyquist frequency, {worst[0] / 2} Hz")
    s = sliced(f.samples, rows_per_slice, f.longest)
    s = Sliced(s.df.join(rate.select("channel", "fs", "n"), "channel"), s.many)
    size = 2 * (order if band in (d.PASS, d.STOP) else (order + 1) // 2)

    def sections(rows: pd.DataFrame) -> np.ndarray | None:
        return None if rows["n"].iloc[0] < 2 else d.design(family, band, order, edges, float(rows["fs"].iloc[0]), pass_db, stop_db)

    def run(rows: pd.DataFrame, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sos = sections(rows)
        return (rows["value"].to_numpy(), state) if sos is None else run_sections(sos, rows["value"].to_numpy(), state)

    def transition(rows: pd.DataFrame) -> np.ndarray:
        sos = sections(rows)
        return np.zeros((size, size)) if sos is None else np.linalg.matrix_power(step_matrix(sos), len(rows))

    return f.with_samples(_scan(s, size, run, transition))


def butterworth(f: SignalFrame, band: int, order: int, *edges: float, **how) -> SignalFrame:
    return iir(f, "butterworth", band, order, *edges, **how)


def cheby1(f: SignalFrame, band: int, order: int, ripple_db: float, *edges: float, **how) -> SignalFrame:
    return iir(f, "cheby1", band, order, *edges, pass_db=ripple_db, **how)


def cheby2(f: SignalFrame, band: int, order: int, attenuation_db: float, *edges: float, **how) -> SignalFrame:
    return iir(f, "cheby2", band, order, *edges, stop_db=attenuation_db, **how)


def elliptic(f: SignalFrame, band: int, order: int, ripple_db: float, attenuation_db: float, *edges: float, **how) -> SignalFrame:
    return iir(f, "elliptic", band, order, *edges, pass_db=ripple_db, stop_db=attenuation_db, **how)


def filtfilt(operator: Callable[..., SignalFrame], f: SignalFrame, *args, **how) -> SignalFrame:
    """Zero phase: the operator forward, then backward; ends are not padded."""
    from tidemark.operators import windows

    if operator not in (low_pass, high_pass, pt, butterworth, cheby1, cheby2, elliptic, windows.rolling_mean, windows.rolling_rms):
        raise ValueError("filtfilt takes a causal filter, rolling_mean or rolling_rms")
    ends = ends_sum(f)
    again = how | {"times": f} if operator in (butterworth, cheby1, cheby2, elliptic) else how
    return reverse(operator(reverse(operator(f, *args, **how), ends), *args, **again), ends)
