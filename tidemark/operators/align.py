"""Joins of signals on different time grids, arithmetic between signals, resampling.

Channels of the two sides pair by name. Both sides are tagged, united and read
in time order; each grid row sees the other side's last sample before it and
first at or after it. There is no range join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.frame import FREQUENCY, Longest, SignalFrame
from tidemark.functions.elementwise import BINARY, nan, replaced
from tidemark.operators.kernels import ROWS_PER_SLICE, Sliced, last_known, next_known, sliced

_IN_TIME = ("ts_ns", "kind", "seq")


def interpolated(grid: DataFrame, other: DataFrame, gaps: bool = False, rows_per_slice: int = ROWS_PER_SLICE, longest: Longest | None = None) -> DataFrame:
    """``grid`` with column other: the other side's value at the grid's times, linear between samples.

    Outside the other side's span: its end value, or NaN with ``gaps``. Of
    samples at one instant the first counts, at the very last instant the last.
    ``longest`` bounds the rows of both sides together.
    """
    ends = other.groupBy("channel").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.max_by("value", F.struct("ts_ns", "seq")).alias("last_value"))
    point = F.struct(F.col("ts_ns"), F.col("value"))
    extra = [c for c in grid.columns if c not in ("channel", "seq", "ts_ns")]
    rows = grid.withColumn("kind", F.lit(0)).withColumn("point", F.lit(None).cast("struct<ts_ns:bigint,value:double>"))
    rows = rows.unionByName(other.select("channel", "seq", "ts_ns", F.lit(1).alias("kind"), point.alias("point")), allowMissingColumns=True)
    s = sliced(rows, rows_per_slice, longest)
    s = last_known(s, F.col("point"), "lo", _IN_TIME)
    s = next_known(Sliced(s.df, s.many), F.col("point"), "hi", _IN_TIME)
    at = s.df.filter("kind = 0").join(ends, "channel", "left")
    t, lo, hi = F.col("ts_ns"), F.col("lo"), F.col("hi")
    between = lo["value"] + (t - lo["ts_ns"]) / (hi["ts_ns"] - lo["ts_ns"]) * (hi["value"] - lo["value"])
    value = F.when(t >= F.col("last_ns"), F.col("last_value")).when(lo.isNull(), hi["value"]).when(hi.isNull(), lo["value"]).otherwise(between)
    if gaps:
        value = F.when((t < F.col("first_ns")) | (t > F.col("last_ns")), nan()).otherwise(value)
    return at.select("channel", "seq", "ts_ns", *extra, F.coalesce(value, nan()).alias("other"))


def _grid_facts(samples: DataFrame, side: str) -> DataFrame:
    """Count, ends and a fingerprint of every channel's time grid."""
    print_ = F.sum(F.xxhash64("ts_ns").cast("decimal(38,0)"))
    return samples.groupBy("channel").agg(F.count(F.lit(1)).alias(f"n_{side}"), F.min("ts_ns").alias(f"t0_{side}"), F.max("ts_ns").alias(f"t1_{side}"), print_.alias(f"h_{side}"))


def _occurrences(samples: DataFrame) -> DataFrame:
    """The ordinal of a sample among those of its instant."""
    return samples.withColumn("occurrence", F.row_number().over(Window.partitionBy("channel", "ts_ns").orderBy("seq")))


def pair_same_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sides whose channels have the same timestamps, by instant and occurrence: a's columns and other."""
    b = _occurrences(b).select("channel", "ts_ns", "occurrence", F.col("value").alias("other"))
    return _occurrences(a).join(b, ["channel", "ts_ns", "occurrence"]).drop("occurrence")


def aligned(a: DataFrame, b: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, longest: Longest | None = None) -> DataFrame:
    """(channel, seq, ts_ns, a, b) on one grid a channel.

    Equal grids pair by position. Else both are cut to their common span, the
    side with more samples there (a on a tie) is the grid, the other one is
    interpolated.
    """
    facts = _grid_facts(a, "a").join(_grid_facts(b, "b"), "channel", "full")
    facts = facts.withColumn("same", (F.col("n_a") == F.col("n_b")) & (F.col("t0_a") == F.col("t0_b")) & (F.col("h_a") == F.col("h_b")))
    facts = facts.withColumn("low", F.greatest("t0_a", "t0_b")).withColumn("high", F.least("t1_a", "t1_b"))
    empty = F.col("n_a").isNull() | F.col("n_b").isNull()
    checks = facts.agg(F.max(empty.cast("int")), F.max((~empty & (F.col("low") > F.col("high"))).cast("int")), F.max(F.col("same").cast("int")), F.min(F.coalesce("same", F.lit(False)).cast("int"))).first()
    if checks[0] or checks[0] is None:
        raise ValueError("an operand is empty")
    if checks[1]:
        raise ValueError("signals don't overlap in time")
    parts = []
    if checks[2]:
        same = facts.filter("same").select("channel")
        pairs = pair_same_grid(a.join(same, "channel", "left_semi"), b.join(same, "channel", "left_semi"))
        parts.append(pairs.select("channel", "seq", "ts_ns", F.col("value").alias("a"), F.col("other").alias("b")))
    if not checks[3]:
        span = facts.filter("not same").select("channel", "low", "high")
        rows = a.withColumn("of_a", F.lit(True)).unionByName(b.withColumn("of_a", F.lit(False))).join(span, "channel").withColumn("inside", F.col("ts_ns").between(F.col("low"), F.col("high")))
        inside = F.col("inside")
        grids = rows.groupBy("channel").agg((F.count(F.when(inside & F.col("of_a"), 1)) >= F.count(F.when(inside & ~F.col("of_a"), 1))).alias("use_a"))
        rows = rows.join(grids, "channel").withColumn("is_grid", F.col("of_a") == F.col("use_a"))
        grid = rows.filter("is_grid and inside").select("channel", "seq", "ts_ns", "value", "use_a")
        got = interpolated(grid, rows.filter("not is_grid").select("channel", "seq", "ts_ns", "value"), rows_per_slice=rows_per_slice, longest=longest)
        parts.append(got.select("channel", "seq", "ts_ns", F.when(F.col("use_a"), F.col("value")).otherwise(F.col("other")).alias("a"), F.when(F.col("use_a"), F.col("other")).otherwise(F.col("value")).alias("b")))
    return parts[0].union(parts[1]) if len(parts) == 2 else parts[0]


def _joined_meta(a: SignalFrame, b: SignalFrame) -> DataFrame:
    """Frequency wins, the origin is a's if known, the unit is dropped."""
    other = b.channels.select("channel", F.col("domain").alias("d_b"), F.col("source_start_ns").alias("s_b"))
    m = a.channels.join(other, "channel", "left")
    m = m.withColumn("domain", F.when(F.col("d_b") == FREQUENCY, FREQUENCY).otherwise(F.col("domain"))).withColumn("source_start_ns", F.coalesce("source_start_ns", "s_b"))
    return m.withColumn("unit", F.lit("")).drop("d_b", "s_b")


def combine(a: SignalFrame | float, b: SignalFrame | float, op: str | Callable[[Column, Column], Column], rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """``a op b``. A number is a literal; two frames are aligned channel by channel."""
    f = BINARY[op] if isinstance(op, str) else op
    if not isinstance(b, SignalFrame):
        return a.map_value(lambda v: f(v, F.lit(float(b)))).with_meta(unit="")
    if not isinstance(a, SignalFrame):
        return b.map_value(lambda v: f(F.lit(float(a)), v)).with_meta(unit="")
    both = a.longest.plus(b.longest)
    rows = aligned(a.samples, b.samples, rows_per_slice, both)
    return SignalFrame(rows.select("channel", "seq", "ts_ns", f(F.col("a"), F.col("b")).alias("value")), _joined_meta(a, b), both)


def combine_scalar(f: SignalFrame, scalars: DataFrame, op: str) -> SignalFrame:
    """``f op s`` with one number a channel, from a DataFrame (channel, value) such as ``peak_hz`` returns."""
    s = scalars.select("channel", F.col("value").alias("__s"))
    out = f.samples.join(s, "channel").withColumn("value", BINARY[op](F.col("value"), F.col("__s")))
    return f.with_samples(out).with_meta(unit="")


def replace_values(f: SignalFrame, old: float, new: SignalFrame | float, tolerance: float = 0.0) -> SignalFrame:
    """Samples that match ``old`` become ``new``, a number or a signal."""
    return combine(f, new, lambda v, n: replaced(v, n, old, tolerance))


def resample(f: SignalFrame, rate_hz: float, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """An even grid from a channel's first to its last sample."""
    step = int(1e9 / rate_hz) if rate_hz > 0 else 0
    if step <= 0:
        raise ValueError("the rate must be positive and at most 1 GHz")
    block = 100_000
    span = f.samples.groupBy("channel").agg(F.min("ts_ns").alias("t0"), ((F.max("ts_ns") - F.min("ts_ns")) / F.lit(step)).alias("x"))
    blocks = span.withColumn("last", F.floor("x")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {block}"))))
    seq = F.explode(F.sequence(F.col("block") * block, F.least(F.col("last"), F.col("block") * block + (block - 1))))
    grid = blocks.select("channel", "t0", seq.alias("seq")).select("channel", "seq", (F.col("t0") + F.col("seq") * step).alias("ts_ns"))
    even = Longest(lambda: int(span.agg(F.max("x")).first()[0] or 0) + 1)
    got = interpolated(grid, f.samples, rows_per_slice=rows_per_slice, longest=even.plus(f.longest))
    return f.with_samples(got.withColumnRenamed("other", "value"), even)


def resample_onto(f: SignalFrame, reference: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE) -> SignalFrame:
    """The reference's timestamps that lie within the channel's span."""
    span = f.samples.groupBy("channel").agg(F.min("ts_ns").alias("low"), F.max("ts_ns").alias("high"))
    grid = reference.samples.join(span, "channel").filter("ts_ns between low and high").select("channel", "seq", "ts_ns")
    got = interpolated(grid, f.samples, rows_per_slice=rows_per_slice, longest=f.longest.plus(reference.longest))
    return f.with_samples(got.withColumnRenamed("other", "value"), reference.longest)


def xy_pairs(x: SignalFrame, y: SignalFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(channel, seq, ts_ns, x, y) on x's grid; y is NaN outside its span. Only channels of equal domain pair."""
    same = x.channels.select("channel", "domain").join(y.channels.select("channel", "domain"), ["channel", "domain"]).select("channel")
    grid = x.samples.join(same, "channel", "left_semi").withColumnRenamed("value", "x")
    got = interpolated(grid, y.samples.join(same, "channel", "left_semi"), gaps=True, rows_per_slice=rows_per_slice, longest=x.longest.plus(y.longest))
    return got.withColumnRenamed("other", "y")


def union_grid(f: SignalFrame) -> DataFrame:
    """(ts_ns, occurrence) and a column a channel, null where it has no such sample.

    An instant appears as often as the channel that repeats it most.
    """
    names = [r[0] for r in f.channels.select("channel").distinct().orderBy("channel").collect()]  # become columns
    return _occurrences(f.samples).groupBy("ts_ns", "occurrence").pivot("channel", names).agg(F.first("value"))
