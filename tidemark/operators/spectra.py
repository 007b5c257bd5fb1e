"""Spectra: one task a channel where it fits, four steps over many tasks where it doesn't.

A transform of N = N1 * N2 points is N1 transforms of N2 points over the
samples of equal remainder, a turn by exp(-2 pi i n1 k2 / N), and N2
transforms of N1 points. Both halves are dealt over the cluster by key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import FREQUENCY, TIME, Longest, SignalFrame
from tidemark.operators.kernels import ROWS_PER_SLICE, ordinals, sliced
from tidemark.operators.segments import gate_runs
from tidemark.scratch import written

HANN, FLAT_TOP, NONE = 0, 1, 2
#: Points of a transform that one task computes whole.
DIRECT_POINTS = 1 << 20
# The coefficients of the flat-top window.
FLAT_TOP_TERMS = (0.21557895, -0.41663158, 0.277263158, -0.083578947, 0.006947368)


def window_weight(kind: int, i: Column, n: Column) -> Column:
    x = 2 * np.pi * i / (n - 1)
    if kind == HANN:
        w = 0.5 - 0.5 * F.cos(x)
    elif kind == FLAT_TOP:
        w = F.lit(FLAT_TOP_TERMS[0])
        for k, c in enumerate(FLAT_TOP_TERMS[1:], 1):
            w = w + c * F.cos(k * x)
    elif kind == NONE:
        return F.lit(1.0)
    else:
        raise ValueError("the window is 0 (Hann), 1 (flat-top) or 2 (none)")
    return F.when(n <= 1, 1.0).otherwise(w)


def power_of_two(n: Column) -> Column:
    """The least power of two that is at least ``n`` and 2."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")) - 1e-12))).cast("long")


def transform(points: DataFrame, keys: list[str], direct_points: int = DIRECT_POINTS) -> DataFrame:
    """keys, k, re, im for points (keys, i, re, im, n_fft); missing i are 0."""
    most = points.agg(F.max("n_fft")).first()[0] or 0
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{kinds}, n_fft long, k long, re double, im double"

    def filled(rows: pd.DataFrame, at: pd.Series, n: int) -> np.ndarray:
        x = np.zeros(n, complex)
        x[at.to_numpy()] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        return x

    def framed(rows: pd.DataFrame, n_fft: int, k: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({c: rows[c].iloc[0] for c in keys} | {"n_fft": n_fft, "k": k, "re": x.real, "im": x.imag})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n_fft"].iloc[0])
        return framed(rows, n, np.arange(n), np.fft.fft(filled(rows, rows["i"], n)))

    if most <= direct_points:
        return points.groupBy(*keys).applyInPandas(whole, out)

    def split(n: int) -> tuple[int, int]:
        n1 = 1 << (n.bit_length() // 2)
        return n1, n // n1

    def columns(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n_fft"].iloc[0])
        n1, n2 = split(n)
        here = int(rows["i"].iloc[0]) % n1
        k2 = np.arange(n2)
        x = np.fft.fft(filled(rows, rows["i"] // n1, n2)) * np.exp(-2j * np.pi * here * k2 / n)
        return framed(rows, n, k2, x).assign(i=here)

    def lines(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n_fft"].iloc[0])
        n1, n2 = split(n)
        k2 = int(rows["k"].iloc[0])
        return framed(rows, n, k2 + n2 * np.arange(n1), np.fft.fft(filled(rows, rows["i"], n1)))

    n1 = F.pow(F.lit(2.0), F.floor((F.log2(F.col("n_fft").cast("double")) + 1.5) / 2)).cast("long")
    first = points.withColumn("rest", F.col("i") % n1).groupBy(*keys, "rest").applyInPandas(columns, out + ", i long")
    return first.groupBy(*keys, "k").applyInPandas(lines, out)


def _inverse(spectrum: DataFrame, keys: list[str], direct_points: int) -> DataFrame:
    """keys, i, re of the inverse, by conjugation."""
    turned = spectrum.withColumn("im", -F.col("im")).withColumnRenamed("k", "i")
    back = transform(turned.select(*keys, "i", "re", "im", "n_fft"), keys, direct_points)
    return back.select(*keys, F.col("k").alias("i"), (F.col("re") / F.col("n_fft")).alias("re"))


def _points(f: SignalFrame, window: int, rows_per_slice: int) -> tuple[DataFrame, DataFrame]:
    """Windowed samples as points, and a row of facts (n, t0, fs, n_fft, weights) a channel."""
    facts = f.samples.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    bad = facts.filter("n < 2 or t1 <= t0").select("channel").first()
    if bad:
        raise ValueError(f"{bad[0]}: a spectrum needs two samples over a span of time")
    facts = facts.withColumn("fs", 1.0 / ((F.col("t1") - F.col("t0")) * 1e-9 / (F.col("n") - 1))).withColumn("n_fft", power_of_two(F.col("n")))
    rows = ordinals(sliced(f.samples, rows_per_slice, f.longest), "i").df.join(facts, "channel").withColumn("w", window_weight(window, F.col("i"), F.col("n")))
    weights = rows.groupBy("channel").agg(F.sum("w").alias("weights"))
    points = rows.select("channel", "i", (F.col("value") * F.col("w")).alias("re"), F.lit(0.0).alias("im"), "n_fft")
    return points, facts.join(weights, "channel")


def _half(f: SignalFrame, window: int, rows_per_slice: int, direct_points: int) -> DataFrame:
    points, facts = _points(f, window, rows_per_slice)
    bins = transform(points, ["channel"], direct_points).filter("k * 2 <= n_fft").drop("n_fft")
    return bins.join(facts, "channel")


def _axis() -> Column:
    return F.floor(F.col("k") * (F.col("fs") / F.col("n_fft")) * 1e9 + 0.5).cast("long")


def _spectrum(f: SignalFrame, bins: DataFrame, value: Column, unit: str) -> SignalFrame:
    samples = bins.select("channel", F.col("k").alias("seq"), _axis().alias("ts_ns"), value.alias("value"))
    start = f.samples.groupBy("channel").agg(F.min("ts_ns").alias("__t0"))
    channels = f.channels.join(start, "channel", "left").withColumn("source_start_ns", F.col("__t0")).drop("__t0")
    # Half of the least power of two, and one bin more.
    return SignalFrame(samples, channels, f.longest.times(2)).with_meta(domain=FREQUENCY, unit=unit)


def _magnitude() -> Column:
    return F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def _scale(weights: Column) -> Column:
    once = F.when((F.col("k") == 0) | (F.col("k") * 2 == F.col("n_fft")), 1.0).otherwise(2.0)
    return F.when(weights > 0, once / weights).otherwise(0.0)


def fft(f: SignalFrame, window: int = HANN, rows_per_slice: int = ROWS_PER_SLICE, direct_points: int = DIRECT_POINTS) -> SignalFrame:
    """Single-sided amplitudes: a tone of amplitude A reads about A, whatever the window."""
    return _spectrum(f, _half(f, window, rows_per_slice, direct_points), _magnitude() * _scale(F.col("weights")), "magnitude")


def rfft_magnitude(f: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE, direct_points: int = DIRECT_POINTS) -> SignalFrame:
    return _spectrum(f, _half(f, NONE, rows_per_slice, direct_points), _magnitude(), "magnitude")


def rfft_phase(f: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE, direct_points: int = DIRECT_POINTS) -> SignalFrame:
    return _spectrum(f, _half(f, NONE, rows_per_slice, direct_points), F.atan2("im", "re"), "rad")


def revert_fft(magnitude: SignalFrame, phase: SignalFrame, direct_points: int = DIRECT_POINTS) -> SignalFrame:
    """The signal of a single-sided magnitude and phase; starts at the spectrum's origin, or 0."""
    m = ordinals(sliced(magnitude.samples, longest=magnitude.longest), "k").df
    p = ordinals(sliced(phase.samples, longest=phase.longest), "k").df.select("channel", "k", F.col("value").alias("phase"))
    facts = m.groupBy("channel").agg(F.count(F.lit(1)).alias("bins"), ((F.max(F.when(F.col("k") == 1, F.col("ts_ns"))) - F.min(F.when(F.col("k") == 0, F.col("ts_ns")))) / 1e9).alias("df"))
    lengths = facts.join(p.groupBy("channel").agg(F.count(F.lit(1)).alias("other")), "channel", "full")
    if not lengths.filter("bins is null or other is null or bins <> other or bins < 2").isEmpty():
        raise ValueError("magnitude and phase must have the same length, two at least")
    facts = facts.withColumn("n_fft", 2 * (F.col("bins") - 1))
    if not facts.filter(F.bit_count("n_fft") != 1).isEmpty():
        raise ValueError("the number of bins must be a power of two and one")
    rows = m.join(p, ["channel", "k"]).join(facts, "channel").withColumn("re", F.col("value") * F.cos("phase")).withColumn("im", F.col("value") * F.sin("phase"))
    mirror = rows.filter("k > 0 and k < bins - 1").withColumn("k", F.col("n_fft") - F.col("k")).withColumn("im", -F.col("im"))
    back = _inverse(rows.unionByName(mirror).select("channel", "k", "re", "im", "n_fft"), ["channel"], direct_points)
    start = magnitude.channels.select("channel", F.coalesce("source_start_ns", F.lit(0)).alias("t0"))
    step = 1e9 / (F.col("n_fft") * F.when(F.col("df") > 0, F.col("df")).otherwise(1.0))
    out = back.join(facts, "channel").join(start, "channel").select("channel", F.col("i").alias("seq"), (F.col("t0") + F.floor(F.col("i") * step + 0.5)).cast("long").alias("ts_ns"), F.col("re").alias("value"))
    return SignalFrame(out, magnitude.channels, magnitude.longest.times(2)).with_meta(domain=TIME, source_start_ns=None)


def _band_edit(f: SignalFrame, low: float, high: float, keep: bool, rows_per_slice: int, direct_points: int) -> SignalFrame:
    if not 0 <= low < high:
        raise ValueError("a band needs 0 <= low < high")
    points, facts = _points(f, NONE, rows_per_slice)
    bins = transform(points, ["channel"], direct_points).join(facts.select("channel", "fs"), "channel")
    hz = F.least(F.col("k"), F.col("n_fft") - F.col("k")) * (F.col("fs") / F.col("n_fft"))
    inside = hz.between(low, high)
    back = _inverse(bins.filter(inside if keep else ~inside).select("channel", "k", "re", "im", "n_fft"), ["channel"], direct_points)
    rows = ordinals(sliced(f.samples, rows_per_slice, f.longest), "i").df.drop("value").join(back, ["channel", "i"], "left")
    return f.with_samples(rows.withColumn("value", F.coalesce("re", F.lit(0.0)))).with_meta(domain=TIME, source_start_ns=None)


def fft_cut(f: SignalFrame, low: float, high: float, rows_per_slice: int = ROWS_PER_SLICE, direct_points: int = DIRECT_POINTS) -> SignalFrame:
    """The signal without the frequencies in [low, high], on its own timestamps."""
    return _band_edit(f, low, high, False, rows_per_slice, direct_points)


def fft_keep(f: SignalFrame, low: float, high: float, rows_per_slice: int = ROWS_PER_SLICE, direct_points: int = DIRECT_POINTS) -> SignalFrame:
    """The signal's frequencies in [low, high] alone."""
    return _band_edit(f, low, high, True, rows_per_slice, direct_points)


def peak_hz(f: SignalFrame, window: int = HANN, rows_per_slice: int = ROWS_PER_SLICE, direct_points: int = DIRECT_POINTS) -> DataFrame:
    """(channel, value): the largest bin above 0 Hz, refined by the parabola through the logs beside it."""
    bins = _half(f, window, rows_per_slice, direct_points).withColumn("m", _magnitude())
    top = bins.filter("k > 0").groupBy("channel").agg(F.max(F.struct("m", (-F.col("k")).alias("minus_k"))).alias("top")).select("channel", (-F.col("top.minus_k")).alias("top_k"))
    near = bins.join(top, "channel").filter("abs(k - top_k) <= 1")
    side = {d: F.max(F.when(F.col("k") - F.col("top_k") == d, F.log(F.col("m") + 1e-300))) for d in (-1, 0, 1)}
    three = near.groupBy("channel").agg(F.first("top_k").alias("k"), F.first("fs").alias("fs"), F.first("n_fft").alias("n_fft"), side[-1].alias("a"), side[0].alias("b"), side[1].alias("c"))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    delta = F.when(bend != 0, 0.5 * (F.col("a") - F.col("c")) / bend).otherwise(0.0)
    delta = F.when(F.col("c").isNull() | F.col("a").isNull(), 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), delta)))
    return three.select("channel", ((F.col("k") + delta) * (F.col("fs") / F.col("n_fft"))).alias("value"))


def _summed_runs(points: DataFrame, direct_points: int) -> DataFrame:
    """channel, k, m: amplitudes added over runs, as many runs to a task as ``direct_points`` points hold."""

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n_fft"].iloc[0])
        runs, at = np.unique(rows["run"].to_numpy(), return_inverse=True)
        x, weight = np.zeros((len(runs), n)), np.ones(len(runs))
        x[at, rows["i"].to_numpy()] = rows["re"].to_numpy()
        weight[at] = rows["weights"].to_numpy()
        m = np.abs(np.fft.rfft(x, axis=1))
        m[:, 1 : (n + 1) // 2] *= 2
        m = np.divide(m, weight[:, None], out=np.zeros_like(m), where=weight[:, None] > 0)
        return pd.DataFrame({"channel": rows["channel"].iloc[0], "k": np.arange(m.shape[1]), "m": m.sum(axis=0)})

    together = points.withColumn("batch", F.expr(f"run div ({direct_points} div n_fft)"))
    return together.groupBy("channel", "batch").applyInPandas(added, "channel string, k long, m double")


def fft_welch(f: SignalFrame, by: SignalFrame, low: float, high: float, least_s: float = 0.0, window: int = HANN, rows_per_slice: int = ROWS_PER_SLICE, direct_points: int = DIRECT_POINTS) -> SignalFrame:
    """Mean amplitude spectrum over the gate's runs, each transformed by itself.

    All runs share the length of the longest one; the rate is the first step
    of the first run with two samples. The samples in runs are written once:
    they are read several times, and the gate over slices is a large plan.
    """
    if by.samples.isEmpty():
        raise ValueError("the gate is empty")
    rows = written(gate_runs(f, by, low, high, least_s, rows_per_slice).df.select("channel", "run", "seq", "ts_ns", "value"), "runs")
    # A run is an own short channel for numbering its samples.
    named = rows.withColumn("of", F.col("channel")).withColumn("channel", F.concat_ws("\x00", "channel", F.lpad(F.col("run").cast("string"), 19, "0")))
    rows = ordinals(sliced(named, rows_per_slice, Longest.of(named)), "i").df.drop("channel").withColumnRenamed("of", "channel")
    runs = rows.groupBy("channel", "run").agg(F.count(F.lit(1)).alias("n"), (F.max(F.when(F.col("i") == 1, F.col("ts_ns"))) - F.min("ts_ns")).alias("step"))
    longest = runs.groupBy("channel").agg(F.max("n").alias("longest"), F.min_by(F.when(F.col("n") > 1, F.col("step")), F.when(F.col("n") > 1, F.col("run"))).alias("step"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("used"))
    if longest.isEmpty() or not longest.filter("longest < 2 or step is null or step <= 0").isEmpty():
        raise ValueError("no run of the gate is long enough")
    facts = longest.select("channel", "used", (1e9 / F.col("step")).alias("fs"), power_of_two(F.col("longest")).alias("n_fft"))
    rows = rows.join(runs.filter("n > 1").select("channel", "run", "n"), ["channel", "run"]).join(facts, "channel").withColumn("w", window_weight(window, F.col("i"), F.col("n")))
    weights = rows.groupBy("channel", "run").agg(F.sum("w").alias("weights"))
    points = rows.select("channel", "run", "i", (F.col("value") * F.col("w")).alias("re"), F.lit(0.0).alias("im"), "n_fft")
    if (facts.agg(F.max("n_fft")).first()[0] or 0) <= direct_points:
        sums = _summed_runs(points.join(weights, ["channel", "run"]), direct_points)
    else:
        bins = transform(points, ["channel", "run"], direct_points).filter("k * 2 <= n_fft").join(weights, ["channel", "run"])
        sums = bins.select("channel", "k", (_magnitude() * _scale(F.col("weights"))).alias("m"))
    mean = sums.groupBy("channel", "k").agg(F.sum("m").alias("m")).join(facts, "channel")
    return _spectrum(f, mean, F.col("m") / F.col("used"), "magnitude")
