"""Slices, bands, gates and other reshaping of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.frame import FREQUENCY, TIME, SignalFrame
from tidemark.operators.align import interpolated
from tidemark.operators.kernels import ROWS_PER_SLICE, Sliced, neighbours, run_ids, running_sum, sliced
from tidemark.scratch import written

NS = 1e9


def _anchored(f: SignalFrame, origins: DataFrame) -> SignalFrame:
    """Time channels keep their display origin; a spectrum keeps what it has."""
    o = origins.withColumnRenamed("origin_ns", "__origin")
    start = F.when(F.col("domain") == TIME, F.col("__origin")).otherwise(F.col("source_start_ns"))
    return SignalFrame(f.samples, f.channels.join(o, "channel", "left").withColumn("source_start_ns", start).drop("__origin"), f.longest)


def slice_range(f: SignalFrame, start: float, stop: float) -> SignalFrame:
    """Samples from ``start`` to ``stop``, both included: seconds from the origin, or Hz of a spectrum."""
    low, high = int(min(start, stop) * NS), int(max(start, stop) * NS)
    origins = f.origins()
    kept = f.samples.join(origins, "channel").filter((F.col("ts_ns") - F.col("origin_ns")).between(low, high))
    return _anchored(f.with_samples(kept), origins)


def _band(f: SignalFrame, low: float, high: float, keep: bool) -> SignalFrame:
    if high < low:
        raise ValueError("the band's end lies before its start")
    origins = f.origins()
    inside = ((F.col("ts_ns") - F.col("origin_ns")) / NS).between(low, high)
    out = f.samples.join(origins, "channel").withColumn("value", F.when(inside if keep else ~inside, F.col("value")).otherwise(0.0))
    return _anchored(f.with_samples(out), origins)


def band_zero(f: SignalFrame, low: float, high: float) -> SignalFrame:
    """Zero within [low, high] of the axis; the length stays."""
    return _band(f, low, high, False)


def band_keep(f: SignalFrame, low: float, high: float) -> SignalFrame:
    """Zero outside [low, high] of the axis."""
    return _band(f, low, high, True)


def shift(f: SignalFrame, seconds: float) -> SignalFrame:
    return f.with_samples(f.samples.withColumn("ts_ns", F.col("ts_ns") + int(seconds * NS)))


def repeat(f: SignalFrame, times: int, most_samples: int | None = None) -> SignalFrame:
    """The signal ``times`` over, copies one mean step apart. ``most_samples`` refuses larger results."""
    if times < 1 or int(times) != times:
        raise ValueError("n must be a positive integer")
    facts = f.samples.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("t0"), (F.max("ts_ns") - F.min("ts_ns")).alias("span"), (F.max("seq") - F.min("seq") + 1).alias("seqs"))
    checks = facts.agg(F.min("n"), F.max("n")).first()
    if times > 1 and checks[0] is not None and checks[0] < 2:
        raise ValueError("repeating needs two samples at least")
    if most_samples and checks[1] and checks[1] * times > most_samples:
        raise ValueError(f"the result would exceed {most_samples} samples")
    if not f.channels.filter(F.col("domain") == FREQUENCY).isEmpty():
        raise ValueError("only signals over time repeat")
    stride = F.col("span") + F.when(F.col("n") > 1, F.floor(F.col("span") / (F.col("n") - 1) + 0.5)).otherwise(0)
    copies = facts.select("channel", "seqs", stride.alias("stride"), F.explode(F.sequence(F.lit(0), F.lit(int(times) - 1))).alias("copy"))
    out = f.samples.join(copies, "channel").withColumn("ts_ns", F.col("ts_ns") + F.col("copy") * F.col("stride")).withColumn("seq", F.col("seq") + F.col("copy") * F.col("seqs"))
    return f.with_samples(out, f.longest.times(int(times)))


def gate_runs(f: SignalFrame, gate: SignalFrame, low: float, high: float, least_s: float = 0.0, rows_per_slice: int = ROWS_PER_SLICE) -> Sliced:
    """Samples in the gate's runs, with run, prev (of all samples) and first_of_run.

    The gate is interpolated onto the signal; a run is contiguous samples at
    which it lies in [low, high]; runs shorter than ``least_s`` are left out.
    Where channels are cut into slices the interpolated gate is written once:
    slicing and carrying read it many times over, and the driver's plan is as
    much larger.
    """
    low, high = min(low, high), max(low, high)
    at = interpolated(f.samples, gate.samples, rows_per_slice=rows_per_slice, longest=f.longest.plus(gate.longest))
    inside = (~F.isnan("other") & F.col("other").between(low, high)).cast("int")
    at = at.withColumn("inside", inside).drop("other")
    if f.longest() > rows_per_slice:
        at = written(at, "gate")
    s = sliced(at, rows_per_slice, f.longest)
    s = neighbours(s, ts_ns=F.col("ts_ns"), inside=F.col("inside"))
    begins = (F.col("inside") == 1) & (F.col("prev").isNull() | (F.col("prev.inside") == 0))
    s = running_sum(s.with_columns(begins=begins.cast("int")), F.col("begins"), "run")
    kept = s.df.filter("inside = 1")
    if least_s > 0:
        long = kept.groupBy("channel", "run").agg((F.max("ts_ns") - F.min("ts_ns")).alias("lasts")).filter(F.col("lasts") >= int(least_s * NS))
        kept = kept.join(long.select("channel", "run"), ["channel", "run"], "left_semi")
    return Sliced(kept.drop("inside", "next"), s.many)


def upper_median_step(f: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """channel, median_ns: the step of rank n // 2 among all steps, exact, 1 at least.

    Equal steps are counted first; a step's rank is a running sum over the
    distinct steps, so no task sorts a channel's samples.
    """
    s = neighbours(sliced(f.samples, rows_per_slice, f.longest))
    steps = s.df.filter("prev is not null").select("channel", (F.col("ts_ns") - F.col("prev.ts_ns")).alias("step"))
    counts = steps.groupBy("channel", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("channel").orderBy("step"))
    every = F.sum("n").over(Window.partitionBy("channel"))
    ranked = counts.withColumn("upto", upto).withColumn("wanted", F.floor(every / 2))
    return ranked.filter(F.col("upto") > F.col("wanted")).groupBy("channel").agg(F.greatest(F.min("step"), F.lit(1)).alias("median_ns"))


def gate(f: SignalFrame, by: SignalFrame, low: float, high: float, least_s: float = 0.0, mode: int = 0, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """Samples where the gate lies in [low, high].

    Mode 1 keeps their times. Mode 0 closes the gaps: a run follows the one
    before it after the signal's median step, and steps that aren't positive
    become that step too.
    """
    if mode not in (0, 1):
        raise ValueError("mode is 0 (close gaps) or 1 (real time)")
    if by.samples.isEmpty():
        raise ValueError("the gate is empty")
    s = gate_runs(f, by, low, high, least_s, rows_per_slice)
    out = s.df
    if mode == 0:
        median = upper_median_step(f, rows_per_slice)
        first = out.groupBy("channel").agg(F.min_by("ts_ns", F.struct("ts_ns", "seq")).alias("starts"), F.min("run").alias("first_run"))
        rows = out.join(median, "channel", "left").join(first, "channel").withColumn("median_ns", F.coalesce("median_ns", F.lit(1)))
        step = F.when(F.col("begins") == 1, F.when(F.col("run") == F.col("first_run"), 0).otherwise(F.col("median_ns"))).otherwise(F.col("ts_ns") - F.col("prev.ts_ns"))
        step = F.when((step <= 0) & ~((F.col("begins") == 1) & (F.col("run") == F.col("first_run"))), F.col("median_ns")).otherwise(step)
        moved = running_sum(Sliced(rows.withColumn("step", step), s.many), F.col("step"), "moved")
        out = moved.df.withColumn("ts_ns", F.col("starts") + F.col("moved"))
    return _anchored(f.with_samples(out), f.origins())


def select_channels(f: SignalFrame, names: list[str] | None = None, domains: list[str] | None = None, derived: bool | None = None, range_s: tuple[float, float] | None = None) -> SignalFrame:
    """Channels by name and domain and being derived (no source symbol); a range cuts time channels.

    The range is seconds from the earliest sample of the chosen time channels.
    """
    keep: Column = F.lit(True)
    if names is not None:
        keep &= F.col("channel").isin(names)
    if domains is not None:
        keep &= F.col("domain").isin(domains)
    if derived is not None:
        keep &= (F.coalesce("source_symbol", F.lit("")) == "") == F.lit(derived)
    channels = f.channels.filter(keep)
    if channels.isEmpty():
        raise ValueError("no channel matches")
    rows = f.samples.join(channels.select("channel", "domain"), "channel")
    if range_s is not None:
        t0 = rows.filter(F.col("domain") == TIME).agg(F.min("ts_ns")).first()[0] or 0
        rows = rows.filter((F.col("domain") == FREQUENCY) | (F.col("ts_ns") - t0).between(int(range_s[0] * NS), int(range_s[1] * NS)))
    return SignalFrame(rows.select(*f.samples.columns), channels, f.longest)


def split_domains(f: SignalFrame) -> tuple[SignalFrame, SignalFrame]:
    """The time channels and the frequency channels."""
    parts = []
    for domain in (TIME, FREQUENCY):
        channels = f.channels.filter(F.col("domain") == domain)
        parts.append(SignalFrame(f.samples.join(channels.select("channel"), "channel", "left_semi"), channels, f.longest))
    return parts[0], parts[1]


def rebase_time(f: SignalFrame) -> DataFrame:
    """(channel, seq, x, value): seconds from the earliest display origin of all, or Hz."""
    origins = f.origins().join(f.channels.select("channel", "domain"), "channel")
    base = origins.filter(F.col("domain") == TIME).agg(F.coalesce(F.min("origin_ns"), F.lit(0))).first()[0]
    rows = f.samples.join(origins.select("channel", "domain"), "channel")
    x = F.when(F.col("domain") == FREQUENCY, F.col("ts_ns") / NS).otherwise((F.col("ts_ns") - base) / NS)
    return rows.select("channel", "seq", x.alias("x"), "value")


def collapse_instants(f: SignalFrame, keep: str = "first", rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """One sample of each run of equal timestamps: its first, last or mean value."""
    s = run_ids(sliced(f.samples, rows_per_slice, f.longest), F.col("prev").isNull() | (F.col("prev.ts_ns") != F.col("ts_ns")))
    value = {"first": F.min_by("value", "seq"), "last": F.max_by("value", "seq"), "mean": F.avg("value")}[keep]
    return f.with_samples(s.df.groupBy("channel", "run").agg(F.min("seq").alias("seq"), F.min("ts_ns").alias("ts_ns"), value.alias("value")))


def collapse_plateaus(f: SignalFrame, keep: str = "first", rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """One sample of each run of equal values, at the run's first or last time; of those at that time the first."""
    s = run_ids(sliced(f.samples, rows_per_slice, f.longest), F.col("prev").isNull() | (F.col("prev.value") != F.col("value")))
    backwards = F.struct("ts_ns", F.bitwise_not("seq").alias("seq"))
    at = {"first": F.min(F.struct("ts_ns", "seq")), "last": F.max(backwards)}[keep]
    runs = s.df.groupBy("channel", "run").agg(at.alias("at"), F.first("value").alias("value"))
    seq = F.col("at.seq") if keep == "first" else F.bitwise_not("at.seq")
    return f.with_samples(runs.select("channel", seq.alias("seq"), "at.ts_ns", "value"))
