"""Trailing windows, derivative, integral, forward fill, reversal."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.frame import SignalFrame
from tidemark.functions.elementwise import matches
from tidemark.operators.kernels import ROWS_PER_SLICE, Sliced, last_known, neighbours, running_sum, sliced

NS = 1e9
#: Samples of a block up to which a trailing window is read anew for every row.
DIRECT_ROWS = 64


#: Aggregates of a window by name: a kind and what it is of.
Parts = dict[str, tuple[str, Column]]
_KINDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_OF_BOTH = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}
_IN_NUMPY = {"sum": np.add, "count": np.add, "min": np.fmin, "max": np.maximum}


def _together(kind: str, *parts: Column) -> Column:
    """Parts of a window put together; a part without samples is null."""
    if kind in ("min", "max"):
        return _OF_BOTH[kind](*parts)
    return reduce(_OF_BOTH[kind], [F.coalesce(p, F.lit(0)) for p in parts])


def _rolling(f: SignalFrame, window_s: float, parts: Parts, result: Callable[[dict[str, Column]], Column], rows_per_slice: int) -> SignalFrame:
    """``result`` of aggregates over the trailing window, in linear time.

    Time is cut into blocks as long as the window. A row's window is then the
    beginning of its own block up to the row, and the end of the block before,
    from its time less the window on. Every row is sent to its own block and,
    a window later, to the next one; there a running aggregate read forwards
    gives the first part and one read backwards the second. Nothing is ever
    subtracted, so sums stay exact and a NaN leaves with its window.
    Where no block has more than ``DIRECT_ROWS`` samples, a row's few samples
    are read anew in order of time instead, as a plain range frame does; where
    one has more than ``rows_per_slice``, blocks are cut (``_over_pieces``).
    Rows later in order but equal in time are not yet seen.
    """
    if window_s <= 0:
        raise ValueError("the window must be positive")
    w = int(window_s * NS)
    most = _crowded(f.samples, w)
    if most > rows_per_slice:
        return _over_pieces(f, w, parts, result, rows_per_slice, most)
    block = F.expr(f"(ts_ns - pmod(ts_ns, {w}L)) div {w}L")
    places = F.array(F.struct(F.lit(False).alias("late"), F.col("ts_ns").alias("at"), F.col("block")), F.struct(F.lit(True).alias("late"), (F.col("ts_ns") + w).alias("at"), (F.col("block") + 1).alias("block")))
    rows = f.samples.withColumn("block", block).withColumn("p", F.explode(places)).select("channel", "seq", "ts_ns", "value", "p.late", "p.at", "p.block")
    own, near = _ways("block")
    earlier = Window.partitionBy("channel", "block").orderBy("ts_ns").rangeBetween(-w, -1)
    now = Window.partitionBy("channel", "block", "ts_ns").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)

    def over(kind: str, x: Column) -> Column:
        of = _KINDS[kind]
        if most <= DIRECT_ROWS:
            return _together(kind, of(x).over(earlier), of(x).over(now))
        return _together(kind, of(F.when(F.col("late"), x)).over(near), of(F.when(~F.col("late"), x)).over(own))

    return f.with_samples(rows.withColumn("value", result({k: over(*p) for k, p in parts.items()})).filter(~F.col("late")))


def _ways(place: str) -> tuple[WindowSpec, WindowSpec]:
    """A place read forwards to a row, and backwards to it, where what was sent there comes before what equals it in time."""
    of = Window.partitionBy("channel", place)
    return of.orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0), of.orderBy(F.desc("at"), F.desc("late")).rowsBetween(Window.unboundedPreceding, 0)


def _crowded(samples: DataFrame, width: int) -> int:
    """The most rows that a channel has in a block of this width."""
    return samples.groupBy("channel", F.expr(f"(ts_ns - pmod(ts_ns, {width}L)) div {width}L")).count().agg(F.max("count")).first()[0] or 0


def _over_pieces(f: SignalFrame, w: int, parts: Parts, result: Callable[[dict[str, Column]], Column], rows_per_slice: int, most: int) -> SignalFrame:
    """Windows that hold more rows than a task should: cut into so many pieces of equal time that a piece is a task's work.

    A row's window is its own piece up to the row, whole pieces before it, and
    the end of its oldest piece, which is sent to the row's piece as in
    ``_rolling``. Aggregates of whole pieces, one row a piece, come from a
    table of runs of 1, 2, 4, ... pieces, so nothing is subtracted here either.
    Where the window isn't a multiple of the pieces, the few nanoseconds left
    over reach into one piece more, whose last rows are sent a piece further.
    """
    n = 2
    while most > rows_per_slice and n < w:
        n = min(w, max(2 * n, 1 << math.ceil(math.log2(most / rows_per_slice * n / 2))))
        before, most = most, _crowded(f.samples, w // n)
        if most == before:
            break  # one instant has them all
    width = w // n
    n = w // width
    rest = w - n * width
    piece = F.expr(f"(ts_ns - pmod(ts_ns, {width}L)) div {width}L")
    to = lambda late, at, k: F.struct(F.lit(late).alias("late"), at.alias("at"), k.alias("piece"))
    at = F.col("ts_ns") + w
    places = F.array(to(False, F.col("ts_ns"), F.col("piece")), to(True, at, F.col("piece") + n))
    if rest:
        places = F.when(F.pmod("ts_ns", F.lit(width)) >= width - rest, F.concat(places, F.array(to(True, at, F.col("piece") + n + 1)))).otherwise(places)
    samples = f.samples.withColumn("piece", piece)
    names = list(parts)
    whole = samples.groupBy("channel", "piece").agg(*[_KINDS[kind](x).alias(name) for name, (kind, x) in parts.items()])

    def between(pieces: pd.DataFrame) -> pd.DataFrame:
        """Aggregates of the n - 1 pieces before each piece."""
        pieces = pieces.sort_values("piece")
        number = pieces["piece"].to_numpy()
        start, end = np.searchsorted(number, number - n + 1), np.arange(len(number))
        out = {"channel": pieces["channel"].to_numpy(), "piece": number}
        for name in names:
            runs, kind = pieces[name].to_numpy(float), _IN_NUMPY[parts_kind[name]]
            got, at, left, size = np.full(len(number), np.nan), start.copy(), end - start, 1
            any_yet = np.zeros(len(number), bool)
            while len(runs):
                go = (left & size) > 0
                some = runs[at[go]]
                got[go] = np.where(any_yet[go], kind(got[go], some), some)
                any_yet |= go
                at[go] += size
                runs, size = kind(runs[:-size], runs[size:]), 2 * size
            out[name] = pd.Series(got, dtype=object).where(any_yet, None)
        return pd.DataFrame(out)

    parts_kind = {name: kind for name, (kind, _) in parts.items()}
    middle = whole.groupBy("channel").applyInPandas(between, "channel string, piece long, " + ", ".join(f"{k} double" for k in names))
    middle = middle.select("channel", "piece", *[F.col(k).alias(f"__{k}") for k in names])
    rows = samples.withColumn("p", F.explode(places)).select("channel", "seq", "ts_ns", "value", "p.late", "p.at", "p.piece")
    own, near = _ways("piece")
    for name, (kind, x) in parts.items():
        of = _KINDS[kind]
        rows = rows.withColumn(f"__own_{name}", of(F.when(~F.col("late"), x)).over(own)).withColumn(f"__near_{name}", of(F.when(F.col("late"), x)).over(near))
    rows = rows.filter(~F.col("late")).join(middle, ["channel", "piece"])
    made = {name: _together(kind, F.col(f"__near_{name}"), F.col(f"__{name}"), F.col(f"__own_{name}")) for name, (kind, _) in parts.items()}
    return f.with_samples(rows.withColumn("value", result(made)))


def rolling_mean(f: SignalFrame, window_s: float, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """Mean of the samples at most ``window_s`` back, this one included."""
    x = F.col("value")
    return _rolling(f, window_s, {"sum": ("sum", x), "n": ("count", x)}, lambda p: p["sum"] / p["n"], rows_per_slice)


def rolling_rms(f: SignalFrame, window_s: float, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    x = F.col("value") * F.col("value")
    return _rolling(f, window_s, {"sum": ("sum", x), "n": ("count", x)}, lambda p: F.sqrt(p["sum"] / p["n"]), rows_per_slice)


def rolling_min(f: SignalFrame, window_s: float, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    return _rolling(f, window_s, {"min": ("min", F.col("value"))}, lambda p: p["min"], rows_per_slice)


def rolling_max(f: SignalFrame, window_s: float, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    return _rolling(f, window_s, {"max": ("max", F.col("value"))}, lambda p: p["max"], rows_per_slice)


def derivative(f: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """Central differences, one-sided at the ends; a lone sample has derivative 0."""
    s = neighbours(sliced(f.samples, rows_per_slice, f.longest))
    at_end = F.col("prev").isNull() | F.col("next").isNull()
    before = F.coalesce("prev", F.struct("ts_ns", "value"))
    after = F.coalesce("next", F.struct("ts_ns", "value"))
    dt = (after["ts_ns"] - before["ts_ns"]) / NS
    dv = after["value"] - before["value"]
    slope = F.when(dt != 0, dv / dt).when(at_end, 0.0).otherwise(dv / 1e-12)
    return f.with_samples(s.df.withColumn("value", slope)).with_meta(unit="")


def integral(f: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """Cumulative trapezoid area, 0 at the first sample."""
    s = neighbours(sliced(f.samples, rows_per_slice, f.longest))
    step = F.coalesce(0.5 * (F.col("value") + F.col("prev.value")) * ((F.col("ts_ns") - F.col("prev.ts_ns")) / NS), F.lit(0.0))
    out = running_sum(s.with_columns(step=step), F.col("step"), "area")
    return f.with_samples(out.df.withColumn("value", F.col("area"))).with_meta(unit="")


def forward_fill(f: SignalFrame, fill: float = 0.0, tolerance: float = 0.0, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """Samples that equal the fill marker take the last value that doesn't; a leading run stays."""
    good = F.when(~matches(F.col("value"), fill, tolerance), F.col("value"))
    out = last_known(sliced(f.samples, rows_per_slice, f.longest), good, "good")
    return f.with_samples(out.df.withColumn("value", F.coalesce("good", "value")))


def backward_fill(f: SignalFrame, fill: float = 0.0, tolerance: float = 0.0, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """The mirror of ``forward_fill``: the next value that is not the marker; a trailing run stays."""
    ends = ends_sum(f)
    return reverse(forward_fill(reverse(f, ends), fill, tolerance, rows_per_slice), ends)


def ends_sum(f: SignalFrame) -> DataFrame:
    """channel, both: first and last time added, about which a channel is flipped."""
    return f.samples.groupBy("channel").agg((F.min("ts_ns") + F.max("ts_ns")).alias("both"))


def reverse(f: SignalFrame, ends: DataFrame | None = None) -> SignalFrame:
    """The waveform flipped in time within its own span; twice is the identity.

    ``ends`` is ``ends_sum`` of a frame with the same times, where that is cheaper to read.
    """
    out = f.samples.join(ends_sum(f) if ends is None else ends, "channel").withColumn("ts_ns", F.col("both") - F.col("ts_ns")).withColumn("seq", -F.col("seq"))
    return f.with_samples(out)


__all__ = ["Sliced", "backward_fill", "derivative", "ends_sum", "forward_fill", "integral", "reverse", "rolling_max", "rolling_mean", "rolling_min", "rolling_rms"]
