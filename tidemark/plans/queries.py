"""Registered queries of the signal operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import SignalFrame
from tidemark.functions import elementwise as e
from tidemark.functions import payloads
from tidemark.operators import align, catalog, filters, measure, segments, spectra, windows
from tidemark.scratch import new_folder
from tidemark.sources import json_files, sinks, tables, text
from tidemark.sources import profile as importing
from tidemark.streaming import ingest, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def out(f: SignalFrame | DataFrame, digits: int = 6) -> DataFrame:
    rows = f.samples if isinstance(f, SignalFrame) else f
    return rows.select("channel", "seq", "ts_ns", rounded("value", digits).alias("value"))


#: Added before rounding means of prices, which would often lie half-way between two results.
OFF_TIES = 1.23e-6


def two(spark: SparkSession, sf_dir: str, a: str = "click", b: str = "purchase") -> tuple[SignalFrame, SignalFrame]:
    """Two event channels under one name, so that they pair."""
    f = tables.events(spark, sf_dir)
    return f.only(a).renamed("pair"), f.only(b).renamed("pair")


@query
def w1_rolling_mean(spark, sf_dir):
    return out(windows.rolling_mean(tables.events(spark, sf_dir), 3600.0))


@query
def w2_rolling_rms(spark, sf_dir):
    return out(windows.rolling_rms(tables.events(spark, sf_dir), 3600.0))


@query
def w3_rolling_min(spark, sf_dir):
    return out(windows.rolling_min(tables.events(spark, sf_dir), 3600.0))


@query
def w4_rolling_max(spark, sf_dir):
    return out(windows.rolling_max(tables.events(spark, sf_dir), 3600.0))


@query
def w1_rolling_mean_ties(spark, sf_dir):
    """Orders share dates, so rows later on the same date are not seen yet."""
    return out(windows.rolling_mean(tables.orders(spark, sf_dir), 7 * 86400.0).map_value(lambda v: v + OFF_TIES), 4)


@query
def w5_derivative(spark, sf_dir):
    return out(windows.derivative(tables.events(spark, sf_dir)))


@query
def w6_integral(spark, sf_dir):
    return out(windows.integral(tables.events(spark, sf_dir)), 2)


@query
def w7_forward_fill(spark, sf_dir):
    return out(windows.forward_fill(tables.events(spark, sf_dir), 50.0, 25.0))


@query
def w15_reverse(spark, sf_dir):
    return out(windows.reverse(tables.events(spark, sf_dir)))


@query
def w8_low_pass(spark, sf_dir):
    return out(filters.low_pass(tables.events(spark, sf_dir), 3600.0))


@query
def w9_high_pass(spark, sf_dir):
    return out(filters.high_pass(tables.events(spark, sf_dir), 3600.0))


@query
def w10_pt2(spark, sf_dir):
    return out(filters.pt(tables.events(spark, sf_dir), 0, 2, 3600.0))


def _evenly(spark, sf_dir) -> SignalFrame:
    """Events at an even rate of one sample in ten minutes."""
    return align.resample(tables.events(spark, sf_dir), 1 / 600)


@query
def w11_butterworth(spark, sf_dir):
    return out(filters.butterworth(_evenly(spark, sf_dir), 0, 4, 1e-4))


@query
def w12_cheby1(spark, sf_dir):
    return out(filters.cheby1(_evenly(spark, sf_dir), 1, 3, 1.0, 1e-4))


@query
def w13_cheby2(spark, sf_dir):
    return out(filters.cheby2(_evenly(spark, sf_dir), 2, 2, 30.0, 1e-4, 3e-4))


@query
def w14_elliptic(spark, sf_dir):
    return out(filters.elliptic(_evenly(spark, sf_dir), 3, 3, 1.0, 40.0, 1e-4, 3e-4))


@query
def w16_filtfilt(spark, sf_dir):
    return out(filters.filtfilt(filters.low_pass, tables.events(spark, sf_dir), 3600.0))


@query
def w16_filtfilt_mean(spark, sf_dir):
    return out(windows.reverse(windows.rolling_mean(windows.reverse(windows.rolling_mean(tables.events(spark, sf_dir), 3600.0)), 3600.0)))


def _unary(name: str, shifted: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = tables.events(spark, sf_dir)
        return out(f.map_value(lambda v: e.UNARY[name](v / 200 - 0.25 if shifted else v - 50.0)))

    run.__name__ = f"e_{name.lower()}"
    return run


for _name in e.UNARY:
    query(_unary(_name, _name in ("Asin", "Acos", "Exp")))


@query
def e14_round_tolerance(spark, sf_dir):
    return out(tables.events(spark, sf_dir).map_value(lambda v: e.round_half_away(v, 0.2)))


@query
def e16_limit(spark, sf_dir):
    return out(tables.events(spark, sf_dir).map_value(lambda v: e.limit(v, 80.0, 20.0)))


@query
def e18_round_significant(spark, sf_dir):
    return out(tables.events(spark, sf_dir).map_value(lambda v: e.round_significant(v * 1234.5, 3)), 3)


@query
def e19_as_double(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    typed = li.select("l_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), e.as_double(F.col(k)).alias("value")) for k in ("l_partkey", "l_linenumber", "l_tax")])).alias("s"))
    return typed.groupBy("s.channel").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("s.value"), 2).alias("total"))


def _binary(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = two(spark, sf_dir)
        if name == "Power":  # within what both engines round alike
            a, b = a.map_value(lambda v: v / 100 + 0.5), b.map_value(lambda v: v / 100)
        return out(align.combine(a, b, name))

    run.__name__ = f"b_{name.lower()}"
    return run


for _name in e.BINARY:
    query(_binary(_name))


@query
def b_same_grid(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    return out(align.combine(f, f.map_value(lambda v: v * v), "Divide"))


@query
def b_scalar(spark, sf_dir):
    return out(align.combine(align.combine(tables.events(spark, sf_dir), 7.0, "Mod"), 0.0, "Divide"))


@query
def b10_replace(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return out(align.replace_values(a, 50.0, b, 20.0))


@query
def j1_same_grid_pairs(spark, sf_dir):
    f = tables.orders(spark, sf_dir)
    doubled = f.map_value(lambda v: 2 * v)
    return align.pair_same_grid(f.samples, doubled.samples).select("channel", "seq", "ts_ns", rounded("value", 2).alias("a"), rounded("other", 2).alias("b"))


@query
def j2_interpolated_clamped(spark, sf_dir):
    a, b = two(spark, sf_dir)
    got = align.interpolated(a.samples, b.samples)
    return got.select("channel", "seq", "ts_ns", rounded("value").alias("value"), rounded("other").alias("other"))


@query
def j3_interpolated_gaps(spark, sf_dir):
    a, b = two(spark, sf_dir, "purchase", "click")
    got = align.interpolated(a.samples, b.samples, gaps=True)
    return got.select("channel", "seq", "ts_ns", rounded("value").alias("value"), rounded(F.when(~F.isnan("other"), F.col("other"))).alias("other"))


@query
def j4_union_grid(spark, sf_dir):
    wide = align.union_grid(tables.orders(spark, sf_dir))
    names = [c for c in wide.columns if c not in ("ts_ns", "occurrence")]
    return wide.select("ts_ns", F.col("occurrence").cast("long").alias("occurrence"), *[rounded(f"`{c}`", 2).alias(c) for c in names])


@query
def j5_xy_pairs(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return align.xy_pairs(a, b).filter("not isnan(y)").select("channel", "seq", "ts_ns", rounded("x").alias("x"), rounded("y").alias("y"))


@query
def f1_slice(spark, sf_dir):
    return out(segments.slice_range(tables.events(spark, sf_dir), 1e6, 5e5))


@query
def f2_band_zero(spark, sf_dir):
    return out(segments.band_zero(tables.events(spark, sf_dir), 5e5, 1e6))


@query
def f3_band_keep(spark, sf_dir):
    return out(segments.band_keep(tables.events(spark, sf_dir), 5e5, 1e6))


@query
def f4_gate_real_time(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return out(segments.gate(a, b, 70.0, 10.0, 1800.0, 1))


@query
def f4_gate_smash(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return out(segments.gate(a, b, 10.0, 70.0))


@query
def f5_shift(spark, sf_dir):
    return out(segments.shift(tables.events(spark, sf_dir), -1.5))


@query
def f6_repeat(spark, sf_dir):
    return out(segments.repeat(tables.events(spark, sf_dir), 3))


@query
def f7_resample(spark, sf_dir):
    return out(align.resample(tables.events(spark, sf_dir), 1 / 900))


@query
def f8_resample_onto(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return out(align.resample_onto(a, b))


@query
def f9_select_channels(spark, sf_dir):
    return out(segments.select_channels(tables.events(spark, sf_dir), ["click", "view", "purchase"], ["time"], True, (0.0, 1e6)))


@query
def f10_rebase_time(spark, sf_dir):
    return segments.rebase_time(tables.events(spark, sf_dir)).select("channel", "seq", rounded("x").alias("x"), rounded("value").alias("value"))


@query
def i8_i9_relative_time(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    first = f.samples.groupBy("channel").agg(F.min_by("ts_ns", "seq").alias("t0"))
    return out(segments.shift(f.with_samples(f.samples.join(first, "channel").withColumn("ts_ns", F.col("ts_ns") - F.col("t0"))), 5.0))


@query
def i10_collapse_first(spark, sf_dir):
    return out(segments.collapse_instants(tables.orders(spark, sf_dir), "first"), 2)


@query
def i10_collapse_last(spark, sf_dir):
    return out(segments.collapse_instants(tables.orders(spark, sf_dir), "last"), 2)


@query
def i10_collapse_mean(spark, sf_dir):
    return out(segments.collapse_instants(tables.orders(spark, sf_dir), "mean").map_value(lambda v: v + OFF_TIES), 2)


def _stairs(spark, sf_dir) -> SignalFrame:
    return tables.events(spark, sf_dir).map_value(lambda v: e.floor(v / 50))


@query
def i11_plateaus_first(spark, sf_dir):
    return out(segments.collapse_plateaus(_stairs(spark, sf_dir), "first"))


@query
def i11_plateaus_last(spark, sf_dir):
    return out(segments.collapse_plateaus(_stairs(spark, sf_dir), "last"))


@query
def q3_duplicate_instants(spark, sf_dir):
    return measure.duplicate_instants(tables.orders(spark, sf_dir))


@query
def q4_value_plateaus(spark, sf_dir):
    return measure.value_plateaus(_stairs(spark, sf_dir))


@query
def q5_shared_write_loss(spark, sf_dir):
    return measure.shared_write_loss(tables.orders(spark, sf_dir))


@query
def p1_fft(spark, sf_dir):
    return out(spectra.fft(tables.events(spark, sf_dir)), 5)


@query
def p1_fft_flat_top(spark, sf_dir):
    return out(spectra.fft(tables.events(spark, sf_dir), spectra.FLAT_TOP), 5)


@query
def p2_rfft_magnitude(spark, sf_dir):
    return out(spectra.rfft_magnitude(tables.events(spark, sf_dir)), 3)


@query
def p3_rfft_phase(spark, sf_dir):
    half_turn = lambda v: F.when(F.abs(v) > 3.14159, np.pi).otherwise(v)  # noqa: E731  of either sign
    return out(spectra.rfft_phase(tables.events(spark, sf_dir)).map_value(half_turn), 4)


@query
def p4_revert_fft(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    return out(spectra.revert_fft(spectra.rfft_magnitude(f), spectra.rfft_phase(f)), 5)


@query
def p5_fft_cut(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    return out(spectra.fft_cut(f, 1e-5, 1e-4), 5)


@query
def p6_fft_keep(spark, sf_dir):
    return out(spectra.fft_keep(tables.events(spark, sf_dir), 1e-5, 1e-4), 5)


@query
def p5_p6_complement(spark, sf_dir):
    """What is cut and what is kept add up to the signal."""
    f = tables.events(spark, sf_dir)
    return out(align.combine(spectra.fft_cut(f, 1e-5, 1e-4), spectra.fft_keep(f, 1e-5, 1e-4), "Add"), 5)


@query
def p7_peak_hz(spark, sf_dir):
    return spectra.peak_hz(tables.events(spark, sf_dir)).select("channel", rounded(F.col("value") * 1e6, 4).alias("peak_uhz"))


@query
def p8_fft_welch(spark, sf_dir):
    a, b = two(spark, sf_dir)
    return out(spectra.fft_welch(a, b, 10.0, 70.0), 5)


def _cursors(spark, sf_dir) -> tuple[SignalFrame, int, int]:
    f = tables.events(spark, sf_dir)
    low, high = f.samples.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    return f, low + (high - low) // 4, low + (high - low) // 4 * 3


_STATS = ("min", "max", "mean", "rms", "sigma", "area")


@query
def a1_gate_stats(spark, sf_dir):
    return measure.gate_stats(*_cursors(spark, sf_dir)).select("channel", "n", *[rounded(c, 3).alias(c) for c in _STATS])


@query
def a2_cursor_values(spark, sf_dir):
    got = measure.cursor_values(*_cursors(spark, sf_dir))
    return got.select("channel", *[rounded(c).alias(c) for c in ("y1", "y2", "delta", "slope", "ratio", "db", "peak_to_peak")])


@query
def a3_measure(spark, sf_dir):
    got = measure.measure(*_cursors(spark, sf_dir))
    return got.select("channel", "n", *[rounded(c, 3).alias(c) for c in ("y1", "y2", "delta", "slope", "ratio", "db", "peak_to_peak", *_STATS)])


@query
def a4_value_range(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    groups = f.channels.select("channel", F.substring("channel", 1, 1).alias("group"))
    return measure.value_range(f, groups, 1e5, 1e6).select("group", rounded("low").alias("low"), rounded("high").alias("high"))


@query
def a5_downsample(spark, sf_dir):
    return measure.downsample_minmax(tables.events(spark, sf_dir), 100).select("channel", "bin", "n", rounded("min").alias("min"), "min_ts_ns", rounded("max").alias("max"), "max_ts_ns")


@query
def a6_channel_summary(spark, sf_dir):
    return measure.channel_summary(tables.events(spark, sf_dir, "user_id")).select("channel", "n", "first_ns", "last_ns", rounded("span_s").alias("span_s"), rounded("rate_hz", 9).alias("rate_hz"))


@query
def c1_add_replace(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    return out(catalog.add(f, f.only("click").map_value(lambda v: -v)))


@query
def c2_c3_rename_remove(spark, sf_dir):
    return out(catalog.rename(catalog.remove(tables.events(spark, sf_dir), "view"), "click", "press"))


@query
def c4_merge_unique(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    return out(catalog.merge_unique(catalog.merge_unique(f, f.only("click")), f.only("click", "view")))


@query
def c5_derived(spark, sf_dir):
    d = catalog.Derived()
    d.define("double", lambda f: f.map_value(lambda v: 2 * v), "click")
    d.define("sum", lambda a, b: align.combine(a.renamed("x"), b.renamed("x"), "Add"), "double", "click")
    f, _ = d.recompute(tables.events(spark, sf_dir))
    return out(f.only("sum"))


@query
def c5_derived_chain(spark, sf_dir):
    """Ten channels, each the sum of the two before it: every one is read twice."""
    d, plus = catalog.Derived(), lambda a, b: align.combine(a.renamed("x"), b.renamed("x"), "Add")
    d.define("d1", lambda f: f.map_value(lambda v: 0.5 * v), "click")
    d.define("d2", plus, "d1", "click")
    for k in range(3, 11):
        d.define(f"d{k}", plus, f"d{k - 1}", f"d{k - 2}")
    f, _ = d.recompute(tables.events(spark, sf_dir))
    return out(f.only(*d.definitions))


@query
def c6_alias(spark, sf_dir):
    return out(catalog.alias(tables.events(spark, sf_dir), "click", "copy").only("copy", "click"))


@query
def o1_wide_table(spark, sf_dir):
    a, b = two(spark, sf_dir)
    f = catalog.add(a.renamed("a"), b.renamed("b"))
    wide = sinks.wide_table(f, ["a", "b"])
    blank = lambda c: rounded(F.when(~F.isnan(c), F.col(c)))
    return wide.select("ts_ns", blank("a").alias("a"), blank("b").alias("b"))


@query
def o2_paired_table(spark, sf_dir):
    f = tables.events(spark, sf_dir).only("click", "purchase")
    got = sinks.paired_table(f, ["click", "purchase"])
    return got.select("row", "click_x", rounded("click_v").alias("click_v"), "purchase_x", rounded("purchase_v").alias("purchase_v"))


@query
def o3_number_format(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    return f.samples.select("seq", sinks.format_number(F.round("value", 2), 3, ",").alias("cell"))


@query
def n1_flatten(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("ts", F.col("vec_id") * 1000)
    samples, _, _ = catalog.flatten_channels(emb, "ts", "vec_id")
    return samples.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query
def t1_accepted(spark, sf_dir):
    return out(ingest.accepted(_notifications(spark, sf_dir)))


@query
def t2_running_totals(spark, sf_dir):
    return ingest.running_totals(_notifications(spark, sf_dir))


def _notifications(spark, sf_dir) -> DataFrame:
    """Events as notifications: every seventh without device time, every eleventh of the wrong size."""
    f = tables.events(spark, sf_dir).samples
    return f.select("channel", "seq", F.when(F.col("seq") % 7 == 0, 0).otherwise(F.col("ts_ns")).alias("plc_ts_ns"), (F.col("ts_ns") + 5).alias("host_ts_ns"), F.when(F.col("seq") % 11 == 0, 4).otherwise(8).alias("payload_len"), "value")


@query
def t3_live_window(spark, sf_dir):
    got = ingest.live_window(tables.events(spark, sf_dir).samples, 1e5)
    return got.select("group", rounded("low").alias("low"), rounded("high").alias("high"), "n")


@query
def t4_fan_out(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ticks = emb.select(F.col("label").cast("string").alias("channel"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 1_000_000).alias("ts_ns"), F.lit(1000).alias("cycle_us"), F.col("embedding").cast("array<double>").alias("values"))
    return out(ingest.fan_out(ticks), 5)


@query
def x1_backward_fill(spark, sf_dir):
    return out(windows.backward_fill(tables.events(spark, sf_dir), 50.0, 25.0))


@query
def s1_s2_grid_import(spark, sf_dir):
    """Events written as CSV, read as a grid and imported by a profile."""
    path = new_folder(spark, "grid")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev.select(tables.nanoseconds("ts"), "value", "event_type").write.option("sep", ";").csv(path)
    profile = importing.ImportProfile((importing.ColumnMapping("A", importing.X_TIME, unit="ns"), importing.ColumnMapping("B", name="value")))
    f = importing.import_profile(text.read_grid_csv(spark, path, ";"), profile).frame
    return f.samples.select("channel", "ts_ns", rounded("value").alias("value"))


@query
def s1_quoted_grid(spark, sf_dir):
    """Lines with quotes in the middle of cells, doubled, left open and around separators, and comments after blanks."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, v, n = F.col("event_id") % 5, F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(k == 0, F.concat(F.lit('"'), v, F.lit('""x"tail,'), n)).when(k == 1, F.concat(v, F.lit('"d,e"f,'), n)).when(k == 2, F.concat(F.lit('"'), v, F.lit(",,"), n)).when(k == 3, F.concat(v, F.lit('""b,,"'), n, F.lit('"'))).otherwise(F.concat(F.lit("  # "), v))
    path = new_folder(spark, "quoted")
    ev.select(line).write.text(path)
    cells = text.read_grid_csv(spark, path).select("cells")
    return cells.select(F.size("cells").alias("n"), *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)])


def _cells(spark, sf_dir, x: Column) -> DataFrame:
    """Events as a grid: an axis, values with a decimal comma, every ninth no number, every tenth blank."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 9 == 0, "n/a").when(F.col("event_id") % 10 == 0, " ").otherwise(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")))
    return ev.select(F.col("event_id").alias("row_idx"), F.array(x, value, F.col("user_id").cast("string")).alias("cells"))


def _imported(spark, sf_dir, x: Column, axis: importing.ColumnMapping, *columns: importing.ColumnMapping) -> importing.Imported:
    return importing.import_profile(_cells(spark, sf_dir, x), importing.ImportProfile((axis, *columns), decimal=","))


@query
def i1_i5_i6_import(spark, sf_dir):
    """Milliseconds, a row range, numbers and blanks."""
    got = _imported(spark, sf_dir, (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").cast("string"), importing.ColumnMapping("A", importing.X_TIME, unit="ms"), importing.ColumnMapping("B", name="v", row_start=100, row_end=8000), importing.ColumnMapping("C"))
    return out(got.frame)


@query
def i2_i7_frequency_import(spark, sf_dir):
    """kHz, and rows without an axis value left out."""
    got = _imported(spark, sf_dir, F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_id").cast("string")), importing.ColumnMapping("A", importing.X_FREQUENCY, unit="kHz"), importing.ColumnMapping("B", name="v"))
    return out(got.frame)


@query
def i3_i4_rate_import(spark, sf_dir):
    """A period of 3 ms in place of the axis column, from row 50 on."""
    got = _imported(spark, sf_dir, F.lit("0"), importing.ColumnMapping("A", importing.X_TIME), importing.ColumnMapping("B", name="v", sample_rate_hz=importing.rate_hz(4, "ms"), row_start=50))
    return out(got.frame)


@query
def i8_i9_import(spark, sf_dir):
    """Relative to the first row, then 2.5 s later."""
    got = _imported(spark, sf_dir, tables.nanoseconds("ts").cast("string"), importing.ColumnMapping("A", importing.X_TIME, unit="ns"), importing.ColumnMapping("C", name="v", relative_time=True, time_offset_s=2.5))
    return out(got.frame)


@query
def q1_bad_cells(spark, sf_dir):
    bad_x = F.when(F.col("event_id") % 50 == 7, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    got = _imported(spark, sf_dir, bad_x, importing.ColumnMapping("A", importing.X_TIME), importing.ColumnMapping("B"), importing.ColumnMapping("C"))
    return got.bad_cells


@query
def s4_o2_csv_round_trip(spark, sf_dir):
    """Two channels as paired CSV with exact nanoseconds, read by its titles."""
    path = new_folder(spark, "paired")
    sinks.write_wide_csv(tables.events(spark, sf_dir).only("click", "view"), path, absolute_ns=True, paired=True)
    # A folder of part files with a title line each: titles are no numbers and left out.
    f = text.read_signal_csv(spark, path)
    return f.samples.select("channel", "ts_ns", rounded("value").alias("value"))


@query
def s8_o5_json_round_trip(spark, sf_dir):
    path = new_folder(spark, "json")
    sinks.write_signal_json(tables.events(spark, sf_dir), path)
    f = json_files.read_signal_json(spark, path)
    return f.samples.select("channel", "ts_ns", rounded("value").alias("value"))


@query
def s6_json_records(spark, sf_dir):
    path = new_folder(spark, "records")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", F.struct("user_id").alias("nested")).write.json(path)
    got = json_files.read_json_records(spark, path, json_lines=True)
    return got.agg(F.count("event_id").alias("n"), F.count("nested").alias("nested"), rounded(F.sum(F.col("value").cast("double")), 2).alias("total"))


@query
def s10_o6_session(spark, sf_dir):
    path = new_folder(spark, "session")
    sinks.save_session(tables.events(spark, sf_dir), path)
    return out(sinks.open_signals(spark, path).only("click", "error"))


@query
def o7_split_domains(spark, sf_dir):
    f = tables.events(spark, sf_dir)
    both = catalog.add(f, spectra.rfft_magnitude(f).renamed(F.concat("channel", F.lit(" spectrum"))))
    written = sinks.save_split(both, new_folder(spark, "split"), sinks.save_session)
    time, frequency = (sinks.load_session(spark, w).samples for w in written)
    return time.groupBy().agg(F.count(F.lit(1)).alias("n_time")).crossJoin(frequency.groupBy().agg(F.count(F.lit(1)).alias("n_frequency")))


def _drained(samples: DataFrame, path: str, run) -> DataFrame:
    q = run(samples).writeStream.format("parquet").option("path", path).option("checkpointLocation", path + ".state").trigger(availableNow=True).start()
    q.awaitTermination()
    return samples.sparkSession.read.parquet(path)


def _in_order(spark, sf_dir, label: str, run) -> DataFrame:
    """What a stream over the events in order of time, in bounded batches, writes until it has read all there is."""
    path = new_folder(spark, label)
    return _drained(ingest.in_time_order(tables.events(spark, sf_dir).samples, path + ".in"), path, run)


def _streamed(spark, sf_dir, label: str, run) -> DataFrame:
    """What a stream over the events table writes until it has read all there is."""
    path = new_folder(spark, label)
    ev = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet")
    samples = ev.select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), tables.nanoseconds("ts").alias("ts_ns"), "value")
    return _drained(samples, path, run)


@query
def t5_stream_integral(spark, sf_dir):
    return out(_in_order(spark, sf_dir, "integral", stateful.integral), 2)


@query
def t5_stream_forward_fill(spark, sf_dir):
    return out(_in_order(spark, sf_dir, "fill", lambda s: stateful.forward_fill(s, 50.0, 25.0)))


def _with_ends(samples: DataFrame) -> DataFrame:
    """Samples that say which is their channel's last."""
    last = samples.groupBy("channel").agg(F.max(F.struct("ts_ns", "seq")).alias("last"))
    return samples.join(last, "channel").select("channel", "seq", "ts_ns", "value", (F.struct("ts_ns", "seq") == F.col("last")).alias("ends"))


def _ended(spark, sf_dir, label: str, run) -> DataFrame:
    path = new_folder(spark, label)
    return _drained(ingest.in_time_order(_with_ends(tables.events(spark, sf_dir).samples), path + ".in"), path, run)


@query
def t5_stream_low_pass(spark, sf_dir):
    return out(_ended(spark, sf_dir, "low", lambda s: stateful.lag_stages(s, 3600.0)))


@query
def t5_stream_high_pass(spark, sf_dir):
    return out(_ended(spark, sf_dir, "high", lambda s: stateful.lag_stages(s, 3600.0, high=True)))


@query
def t5_stream_pt2(spark, sf_dir):
    return out(_ended(spark, sf_dir, "pt2", lambda s: stateful.lag_stages(s, 3600.0, 2)))


@query
def t1_stream_late(spark, sf_dir):
    """Events that arrive in the order of their user and number, so that most are out of order."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrival = F.col("event_id") + F.col("user_id") * 10_000_000
    samples = ev.select(F.col("event_type").alias("channel"), arrival.alias("seq"), tables.nanoseconds("ts").alias("ts_ns"), "value")
    path = new_folder(spark, "late")
    got = _drained(ingest.in_time_order(samples, path + ".in", ("seq",)), path, lambda s: stateful.marked_late(s, 864_000.0))
    return got.select("channel", "seq", "ts_ns", rounded("value").alias("value"), "late")


_DAY = 86400 * 10**9


def _disordered(spark, sf_dir, late: bool) -> tuple[DataFrame, Column]:
    """Events that arrive up to a day after their time, and with ``late`` every fiftieth forty days after; and the ten days they arrive in."""
    samples = _with_ends(tables.events(spark, sf_dir).samples)
    after = F.when(F.col("ends"), _DAY).when(F.lit(late) & (F.col("seq") % 50 == 0), 40 * _DAY).otherwise(F.col("seq") * 7919 % 86400 * 10**9)
    return samples.withColumn("arrival", F.col("ts_ns") + after), F.expr(f"arrival div {10 * _DAY}")


def _arriving(spark, sf_dir, label: str, run, late: bool = False) -> DataFrame:
    path = new_folder(spark, label)
    samples, batch = _disordered(spark, sf_dir, late)
    return _drained(ingest.in_time_order(samples, path + ".in", ("arrival", "seq"), batch).drop("arrival"), path, run)


@query
def t5_stream_disordered_integral(spark, sf_dir):
    """Rows come out of order within and across micro-batches; the result is that of the ordered table."""
    return out(_arriving(spark, sf_dir, "integral", lambda s: stateful.integral(s, 86400.0)), 2)


@query
def t5_stream_disordered_pt2(spark, sf_dir):
    return out(_arriving(spark, sf_dir, "pt2", lambda s: stateful.lag_stages(s, 3600.0, 2, delay_s=86400.0)))


@query
def t5_stream_too_late(spark, sf_dir):
    """Rows that the reorder buffer could not wait for, as its side table has them."""
    got = _arriving(spark, sf_dir, "late", lambda s: stateful.forward_fill(s.drop("ends"), 50.0, 25.0, delay_s=86400.0), late=True)
    return out(got.filter("late"))


_NOTIFIED = "channel string, seq long, ts_ns long, value double, valid boolean, late boolean"


def _two_tables(spark, sf_dir, side: bool) -> DataFrame:
    """Notifications in an order of arrival that makes most late, every eleventh of the wrong size."""
    path = new_folder(spark, "recorded")
    ev = _notifications(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "user_id"), "seq")
    arriving = ev.withColumn("seq", F.col("seq") + F.col("user_id") * 10_000_000).drop("user_id")
    stream = ingest.in_time_order(arriving, path + ".in", ("seq",), F.expr("seq div 300000000"), sharing=True)
    marked = stateful.marked_late(ingest.stamped(stream), 864_000.0)
    ingest.in_two_tables(marked, F.col("late") | ~F.col("valid"), path, path + ".state").awaitTermination()
    return ingest.table_of(spark, path, _NOTIFIED, side)


@query
def t1_stream_samples(spark, sf_dir):
    return out(_two_tables(spark, sf_dir, False))


@query
def t1_stream_side(spark, sf_dir):
    return _two_tables(spark, sf_dir, True).select("channel", "seq", "ts_ns", rounded("value").alias("value"), "valid", "late")


_KINDS = ("BOOL", "SINT", "USINT", "INT", "UINT", "DINT", "UDINT", "LINT", "ULINT", "REAL", "LREAL")


def _bits(n: Column, fraction: int, bias: int) -> Column:
    """The IEEE 754 bits of a whole number from 1 on, as a long."""
    power = F.floor(F.log2(n.cast("double")) + 1e-12).cast("long")
    return (power + bias) * 2**fraction + (n - F.pow(F.lit(2.0), power).cast("long")) * F.pow(F.lit(2.0), F.lit(fraction) - power).cast("long")


@query
def t1_typed_payloads(spark, sf_dir):
    """A stream of bytes, read by the types of a table of channels; every thirteenth payload is a byte too long."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 11 + 1).cast("int"))
    n = F.col("event_id") % 1000 + 1
    number = F.when(kind == "REAL", _bits(n, 23, 127)).when(kind == "LREAL", _bits(n, 52, 1023)).when(kind.isin("INT", "DINT", "LINT"), -n).when(kind.isin("SINT", "USINT"), n % 100).when(kind == "BOOL", n % 2).otherwise(n)
    payload = payloads.encoded_whole(F.col("number"), payloads.size_of(F.col("kind")))
    payload = F.when(F.col("event_id") % 13 == 0, F.concat(payload, F.lit(b"x"))).otherwise(payload)
    ev = ev.withColumn("kind", kind).withColumn("number", number)
    sent = ev.select(F.concat(F.lit("of "), "kind").alias("channel"), F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("plc_ts_ns"), tables.nanoseconds("ts").alias("host_ts_ns"), payload.alias("payload"))
    channels = spark.createDataFrame([(f"of {k}", k) for k in _KINDS], "channel string, data_type string")
    path = new_folder(spark, "typed")
    got = _drained(ingest.in_time_order(sent, path + ".in", ("host_ts_ns", "seq")), path, lambda s: ingest.typed(s, channels))
    return got.select("channel", "seq", "ts_ns", "data_type", "payload_len", F.when(F.col("valid"), rounded("value")).alias("value"), "valid")


@query
def t2_stream_events(spark, sf_dir):
    """An event for every day in which a channel's overruns grew."""
    path = new_folder(spark, "overruns")
    ended = _with_ends(tables.events(spark, sf_dir).samples).select("seq", "ends")
    ev = ingest.stamped(_notifications(spark, sf_dir)).join(ended, "seq")
    stream = ingest.in_time_order(ev, path + ".in", ("ts_ns", "seq"), F.expr(f"ts_ns div {10 * _DAY}"))
    return _drained(stream, path, lambda s: stateful.overrun_events(s, 86400.0))


@query
def t3_stream_window(spark, sf_dir):
    """The live window after a stream's last batch; groups are halves of the channels."""
    path = new_folder(spark, "live")
    f = tables.events(spark, sf_dir)
    groups = f.channels.select("channel", F.when(F.col("channel") < "m", "low").otherwise("high").alias("group"))
    stream = ingest.in_time_order(f.samples, path + ".in", batch=F.expr(f"ts_ns div {10 * _DAY}"))
    q = ingest.live_ranges(stream, 1e5, 1000.0, path, path + ".state", groups)
    q.awaitTermination()
    got = spark.read.parquet(f"{path}/ranges/{q.lastProgress['batchId']}")
    return got.select("group", rounded("low").alias("low"), rounded("high").alias("high"), "n")


@query
def t2_stream_totals(spark, sf_dir):
    """Totals of a stream, as its last complete table."""
    path = new_folder(spark, "totals")
    ev = _notifications(spark, sf_dir)
    stream = ingest.in_time_order(ev, path + ".in", ("plc_ts_ns", "seq"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    q = ingest.running_totals(stream).writeStream.outputMode("complete").option("checkpointLocation", path + ".state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/{q.lastProgress['batchId']}")


@query
def s3_o4_noted_csv(spark, sf_dir):
    """A channel called t, which titles alone would take for an axis; the files' own description says what it is."""
    f = tables.events(spark, sf_dir).only("click", "view").with_meta(unit="V")
    path = new_folder(spark, "noted") + ".csv"
    sinks.write_wide_csv(f.renamed(F.when(F.col("channel") == "click", "t").otherwise(F.col("channel"))), path, absolute_ns=True, paired=True, noted=True)
    back = text.read_signal_csv(spark, path)
    return back.samples.join(back.channels.select("channel", "unit"), "channel").select("channel", "ts_ns", rounded("value").alias("value"), "unit")


@query
def s5_paired_export(spark, sf_dir):
    """Two channels as a logger exports them, in whole milliseconds, each with its own number of rows."""
    f = tables.events(spark, sf_dir).only("click", "view")
    rows = sinks.paired_table(f, ["click", "view"])
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = F.concat_ws("\t", *[cell(x) for c in ("click", "view") for x in (F.expr(f"{c}_x div 1000000"), F.col(f"{c}_v"))])
    path = new_folder(spark, "export") + ".txt"
    head = ["Name\tsome recording", "Name\tclick\tName\tview", "SampleTime[ms]\t1\tSampleTime[ms]\t1", "Unit\t(V)\tUnit\t(None)"]
    sinks.write_lines(rows.orderBy("row").select(line), path, head)
    back = sinks.open_signals(spark, path)
    return back.samples.join(back.channels.select("channel", "unit"), "channel").select("channel", "ts_ns", rounded("value").alias("value"), "unit")


def _documents(spark, sf_dir, label: str, **columns: Column) -> str:
    """Events as JSON documents of columns, a file each of some thousand rows."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = F.struct("event_id", *[c.alias(k) for k, c in columns.items()])
    docs = ev.groupBy(F.expr("event_id div 1000")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    path = new_folder(spark, label) + ".json"
    docs.select(F.to_json(F.struct(F.lit("x").alias("meta"), *[F.col(f"rows.{k}").alias(k) for k in columns]))).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query
def s7_json_columnar(spark, sf_dir):
    got = json_files.read_json_columnar(spark, _documents(spark, sf_dir, "columnar", t=F.col("event_id"), a=F.col("value")))
    return got.select(F.col("t").cast("long").alias("t"), rounded(F.col("a").cast("double")).alias("a"))


@query
def s9_json_guess(spark, sf_dir):
    """The axis is found by its name; truth values are numbers."""
    path = _documents(spark, sf_dir, "guess", flag=F.col("event_id") % 2 == 0, Time=F.col("event_id") * 0.5, a=F.col("value"))
    return sinks.open_signals(spark, path).samples.select("channel", "ts_ns", rounded("value").alias("value"))


def _many_files(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = F.array(tables.nanoseconds("ts").cast("string"), F.when(F.col("event_type") != "error", F.col("value").cast("string")))
    grids = ev.select(F.concat(F.lit("in/"), "event_type", F.lit(".csv")).alias("file"), F.col("event_id").alias("row_idx"), F.when(F.col("event_type") == "view", F.slice(cells, 1, 1)).otherwise(cells).alias("cells"))
    return importing.import_files(grids, importing.ImportProfile((importing.ColumnMapping("A", importing.X_TIME, unit="ns"), importing.ColumnMapping("B", name="v", relative_time=True))))


@query
def i13_many_files(spark, sf_dir):
    return out(_many_files(spark, sf_dir)[0])


@query
def i13_report(spark, sf_dir):
    """Files of views have no second column, so they give nothing."""
    return _many_files(spark, sf_dir)[1]


@query
def q2_unit_report(spark, sf_dir):
    cells = _cells(spark, sf_dir, F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_id").cast("string")))
    return importing.unit_report(cells, importing.ImportProfile((importing.ColumnMapping("A", importing.X_TIME, unit="hours"), importing.ColumnMapping("B"), importing.ColumnMapping("C", importing.X_FREQUENCY, unit="rpm")), header_row=10))


@query
def u1_registered_operator(spark, sf_dir):
    catalog.register_operator("Scaled", lambda f, k: f.map_value(lambda v: v * k), 2, 2, replace=True)
    return out(catalog.apply_operator("Scaled", tables.events(spark, sf_dir), 0.5))


@query
def t1_stream_record(spark, sf_dir):
    def notified(s: DataFrame) -> DataFrame:
        return ingest.accepted(s.select("channel", "seq", F.lit(0).cast("long").alias("plc_ts_ns"), F.col("ts_ns").alias("host_ts_ns"), F.when(F.col("seq") % 11 == 0, 4).otherwise(8).alias("payload_len"), "value"))

    return out(_streamed(spark, sf_dir, "record", notified))


@query
def n1_nested(spark, sf_dir):
    """Arrays of structures with arrays in them, and arrays of arrays of the row's own length."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    cell = lambda k: F.struct((F.col("value") * k).alias("a"), F.array(F.col("value") + k, F.col("event_id").cast("double")).alias("b"), F.col("event_type").alias("text"))
    rows = F.transform(F.sequence(F.lit(1), F.col("event_id") % 3 + 1), lambda i: F.transform(F.sequence(F.lit(1), i), lambda j: F.col("value") * j))
    nested = ev.select("event_id", tables.nanoseconds("ts").alias("t"), F.array(cell(1), cell(2)).alias("cells"), rows.alias("rows"), F.array(*[F.col("value") + i for i in range(4)]).alias("grid"))
    samples, skipped, _ = catalog.flatten_channels(nested, "t", "event_id", {"grid": [(1, 2), (0, 1)]})
    return out(samples).withColumn("skipped", F.lit(",".join(skipped)))


@query
def s10_typed_session(spark, sf_dir):
    """Whole numbers above 2^53 and floats, appended in two runs, come back as they were."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.element_at(F.array(F.lit("LINT"), F.lit("ULINT"), F.lit("REAL"), F.lit("LREAL")), (F.col("event_id") % 4 + 1).cast("int"))
    base = F.when(kind == "LINT", F.lit(-(2**62)).cast("decimal(20,0)")).when(kind == "ULINT", F.lit(str(2**63)).cast("decimal(20,0)"))
    exact = (base + F.col("event_id")).cast("decimal(20,0)")
    value = F.coalesce(exact.cast("double"), F.when(kind == "REAL", F.col("event_id") * 0.5).otherwise(F.col("value")))
    rows = ev.select(F.concat("event_type", F.lit(" "), kind).alias("channel"), F.col("event_id").alias("seq"), tables.nanoseconds("ts").alias("ts_ns"), kind.alias("data_type"), exact.alias("exact"), value.alias("value"))
    path = new_folder(spark, "typed-session")
    for part in (0, 1):
        sinks.append_typed(rows.filter(F.col("seq") % 2 == part), path)
    got = sinks.typed_samples(spark, path)
    return got.select("channel", "seq", "ts_ns", "data_type", F.col("exact").cast("string").alias("exact"), F.when(F.col("exact").isNull(), rounded("value")).alias("value"))


@query
def i13_library(spark, sf_dir):
    """Files imported twice, some of them with other rows the second time: the library has each file's last import."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = F.array(tables.nanoseconds("ts").cast("string"), F.col("value").cast("string"))
    grids = ev.select(F.concat(F.lit("in/"), "event_type", F.lit(".csv")).alias("file"), F.col("event_id").alias("row_idx"), cells.alias("cells"))
    profile = importing.ImportProfile((importing.ColumnMapping("A", importing.X_TIME, unit="ns"), importing.ColumnMapping("B", name="v")))
    path = new_folder(spark, "library")
    importing.import_into(grids, profile, path)
    importing.import_into(grids.filter(F.col("file").endswith("k.csv") & (F.col("row_idx") % 3 == 0)), profile, path)
    return out(importing.library(spark, path))


@query
def s6_json_pieces(spark, sf_dir):
    """Documents of records in pieces: commas, brackets and quotes in their texts are no structure."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = F.struct("event_id", F.concat(F.lit('],{ "'), "event_type", F.lit('\\",[')).alias("note"), F.col("value").alias("a"), F.array("value", F.lit(1.0)).alias("more"))
    docs = ev.groupBy(F.expr("event_id div 1000")).agg(F.sort_array(F.collect_list(row)).alias("data"))
    path = new_folder(spark, "pieces") + ".json"
    docs.select(F.to_json(F.struct(F.lit("x,[").alias("meta"), "data"))).write.option("maxRecordsPerFile", 1).text(path)
    got = json_files.read_json_records(spark, path, in_pieces=True)
    return got.select(F.col("event_id").cast("long").alias("event_id"), "note", rounded(F.col("a").cast("double")).alias("a"), "more")


@query
def s7_json_pieces(spark, sf_dir):
    got = json_files.read_json_columnar(spark, _documents(spark, sf_dir, "columns", t=F.col("event_id"), a=F.col("value"), b=F.concat("event_type", F.lit(',"]'))), in_pieces=True)
    return got.select(F.col("t").cast("long").alias("t"), rounded(F.col("a").cast("double")).alias("a"), "b")
