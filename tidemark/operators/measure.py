"""Statistics between cursors, value ranges, channel summaries, thinning for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import SignalFrame
from tidemark.operators.kernels import ROWS_PER_SLICE, neighbours, sliced
from tidemark.operators.segments import rebase_time


def gate_stats(f: SignalFrame, x1_ns: int, x2_ns: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Per channel within the two instants, NaN left out: n, min, max, mean, rms, sigma, area."""
    low, high = min(x1_ns, x2_ns), max(x1_ns, x2_ns)
    kept = f.samples.filter(F.col("ts_ns").between(low, high) & ~F.isnan("value"))
    s = neighbours(sliced(kept, rows_per_slice, f.longest))
    area = 0.5 * (F.col("value") + F.col("prev.value")) * ((F.col("ts_ns") - F.col("prev.ts_ns")) / 1e9)
    return s.df.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.coalesce(F.stddev_samp("value"), F.lit(float("nan"))).alias("sigma"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area"),
    )


def cursor_values(f: SignalFrame, x1_ns: int, x2_ns: int) -> DataFrame:
    """Values at both cursors (NaN outside), their difference, slope, ratio, dB and peak to peak.

    What lies beside a cursor is an aggregate of its channel: one pass, no window.
    """
    t, order, point = F.col("ts_ns"), F.struct("ts_ns", "seq"), F.struct("ts_ns", "value")
    beside = []
    for k, x in ((1, x1_ns), (2, x2_ns)):
        beside += [F.max_by(F.when(t < x, point), F.when(t < x, order)).alias(f"lo{k}"), F.min_by(F.when(t >= x, point), F.when(t >= x, order)).alias(f"hi{k}")]
    near = f.samples.groupBy("channel").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.max_by("value", order).alias("last_value"), *beside)

    def at(k: int, x: int) -> Column:
        lo, hi, x = F.col(f"lo{k}"), F.col(f"hi{k}"), F.lit(x)
        between = lo["value"] + (x - lo["ts_ns"]) / (hi["ts_ns"] - lo["ts_ns"]) * (hi["value"] - lo["value"])
        inside = F.when(x == F.col("last_ns"), F.col("last_value")).when(lo.isNull(), hi["value"]).otherwise(between)
        return F.coalesce(F.when(x.between(F.col("first_ns"), F.col("last_ns")), inside), F.lit(float("nan")))

    two = f.channels.select("channel").distinct().join(near, "channel", "left").select("channel", at(1, x1_ns).alias("y1"), at(2, x2_ns).alias("y2"))
    nan, dx = F.lit(float("nan")), (x2_ns - x1_ns) / 1e9
    delta = F.col("y2") - F.col("y1")
    ratio = F.when(F.col("y1") != 0, F.try_divide(F.col("y2"), F.col("y1"))).otherwise(nan)
    out = two.withColumn("delta", delta).withColumn("slope", delta / dx if dx else nan).withColumn("ratio", ratio)
    out = out.withColumn("db", F.when(~F.isnan("ratio") & (F.col("ratio") > 0), 20 * F.log10(F.when(F.col("ratio") > 0, F.col("ratio")))).otherwise(nan))
    return out.withColumn("peak_to_peak", F.abs(delta))


def measure(f: SignalFrame, x1_ns: int, x2_ns: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The report: cursor values and statistics of every channel."""
    stats = gate_stats(f, x1_ns, x2_ns, rows_per_slice).withColumn("span", F.col("max") - F.col("min"))
    both = cursor_values(f, x1_ns, x2_ns).drop("peak_to_peak").join(stats, "channel", "left")
    return both.withColumnRenamed("span", "peak_to_peak").na.fill(0, ["n"])


def value_range(f: SignalFrame, groups: DataFrame | None = None, x_min: float | None = None, x_max: float | None = None) -> DataFrame:
    """(group, low, high) for a value axis: half a unit around a flat range, else 5 % margin.

    ``groups`` is (channel, group); without it all channels are one group.
    """
    rows = rebase_time(f)
    if x_min is not None and x_max is not None:
        rows = rows.filter(F.col("x").between(x_min, x_max))
    rows = rows.filter(~F.isnan("value"))
    rows = rows.join(groups, "channel") if groups is not None else rows.withColumn("group", F.lit(""))
    ends = rows.groupBy("group").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    margin = F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.col("high") - F.col("low")) * 0.05)
    return ends.select("group", (F.col("low") - margin).alias("low"), (F.col("high") + margin).alias("high"))


def downsample_minmax(f: SignalFrame, bins: int) -> DataFrame:
    """Per channel and bin of its span: count, least and greatest value and when they are first reached."""
    ends = f.samples.groupBy("channel").agg(F.min("ts_ns").alias("t0"), (F.max("ts_ns") - F.min("ts_ns")).alias("span"))
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("ts_ns") - F.col("t0")) * F.lit(float(bins)) / F.greatest("span", F.lit(1)))).cast("long")
    rows = f.samples.join(ends, "channel").filter(~F.isnan("value")).withColumn("bin", bin_)
    least, most = F.min(F.struct("value", "ts_ns")), F.max(F.struct("value", (-F.col("ts_ns")).alias("minus_ts")))
    out = rows.groupBy("channel", "bin").agg(F.count(F.lit(1)).alias("n"), least.alias("a"), most.alias("b"))
    return out.select("channel", "bin", "n", F.col("a.value").alias("min"), F.col("a.ts_ns").alias("min_ts_ns"), F.col("b.value").alias("max"), (-F.col("b.minus_ts")).alias("max_ts_ns"))


def channel_summary(f: SignalFrame) -> DataFrame:
    """n, first_ns, last_ns, span_s and mean rate of every channel."""
    out = f.samples.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    span = (F.col("last_ns") - F.col("first_ns")) / 1e9
    return out.withColumn("span_s", span).withColumn("rate_hz", F.when(span > 0, (F.col("n") - 1) / span).otherwise(0.0))


def _repeats(f: SignalFrame, column: str, rows_per_slice: int) -> DataFrame:
    s = neighbours(sliced(f.samples, rows_per_slice, f.longest))
    same = (F.col("prev").isNotNull() & (F.col(f"prev.{column}") == F.col(column))).cast("int")
    return s.df.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(same).alias("repeats"))


def duplicate_instants(f: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """channel, n, repeats, warn: samples at the instant of the one before; warned above a tenth."""
    return _repeats(f, "ts_ns", rows_per_slice).withColumn("warn", (F.col("n") >= 2) & (F.col("repeats") * 10 > F.col("n")))


def value_plateaus(f: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """channel, n, repeats, warn: samples with the value of the one before; warned above three tenths."""
    return _repeats(f, "value", rows_per_slice).withColumn("warn", (F.col("n") >= 2) & (F.col("repeats") * 10 > 3 * F.col("n")))


def shared_write_loss(f: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """What writing one row an instant would lose: channels hit, samples, and the worst channel (first by name)."""
    hit = _repeats(f, "ts_ns", rows_per_slice).filter("repeats > 0")
    worst = F.min_by("channel", F.struct((-F.col("repeats")).alias("r"), "channel"))
    return hit.agg(F.count(F.lit(1)).alias("channels"), F.coalesce(F.sum("repeats"), F.lit(0)).alias("dropped"), worst.alias("worst_channel"), F.coalesce(F.max("repeats"), F.lit(0)).alias("worst_dropped"))
