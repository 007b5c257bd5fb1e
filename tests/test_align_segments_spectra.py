import math
import random

import numpy as np
import pytest

from tests.helpers import frame, points, sine, values
from tidemark.frame import SignalFrame
from tidemark.functions import elementwise as e
from tidemark.operators import align, catalog, measure, segments, spectra

NAN = float("nan")


def jitter(n, seed):
    rng, t, out = random.Random(seed), 0.0, []
    for _ in range(n):
        t += rng.uniform(0.05, 0.6)
        out.append((round(t, 6), rng.uniform(-5, 5)))
    return out


def at(data, t):
    ts = [p[0] for p in data]
    return float(np.interp(t, ts, [p[1] for p in data]))


def test_two_grids(spark):
    a, b = jitter(50, 1), jitter(70, 2)
    lo, hi = max(a[0][0], b[0][0]), min(a[-1][0], b[-1][0])
    ain, bin_ = [p for p in a if lo <= p[0] <= hi], [p for p in b if lo <= p[0] <= hi]
    want = [v + at(b, t) for t, v in ain] if len(ain) >= len(bin_) else [at(a, t) + v for t, v in bin_]
    for how in ({}, {"rows_per_slice": 9}):
        assert values(align.combine(frame(spark, x=a), frame(spark, x=b), "Add", **how)) == pytest.approx(want, abs=1e-9)


def test_same_grid_scalars_and_errors(spark):
    f = frame(spark, x=[(0, 1), (0, 2), (1, 0)])
    assert values(align.combine(f, f, "Multiply")) == [1, 4, 0]
    assert all(map(math.isnan, values(align.combine(f, 0.0, "Divide"))))
    assert values(align.combine(10.0, frame(spark, x=[(0, 4)]), "Mod")) == [2]
    with pytest.raises(ValueError, match="overlap"):
        align.combine(f, frame(spark, x=[(5, 1), (6, 1)]), "Add")
    with pytest.raises(ValueError, match="empty"):
        align.combine(f, frame(spark, y=[(0, 1)]), "Add")
    assert values(align.replace_values(f, 0.1, -1.0, 0.2)) == [1, 2, -1]


def test_value_functions(spark):
    f = frame(spark, x=[(i, v) for i, v in enumerate([NAN, -2.5, -0.5, 0.0, 0.5, 2.5, 1e300, float("inf")])])
    assert str(values(f.map_value(e.round_half_away))) == str([NAN, -3.0, -1.0, 0.0, 1.0, 3.0, 1e300, float("inf")])
    assert str(values(f.map_value(e.log))) == str([NAN, NAN, NAN, -math.inf, math.log(0.5), math.log(2.5), math.log(1e300), math.inf])
    assert values(f.map_value(e.sign)) == [0, -1, -1, 0, 1, 1, 1, 1]
    assert str(values(f.map_value(lambda v: e.lesser(v, e.nan())))) == str([NAN, -2.5, -0.5, 0.0, 0.5, 2.5, 1e300, math.inf])
    assert str(values(f.map_value(lambda v: e.limit(v, 1, -1)))) == str([NAN, -1.0, -0.5, 0.0, 0.5, 1.0, 1.0, 1.0])
    assert values(frame(spark, x=[(0, 123456.789), (1, -0.00123456)]).map_value(lambda v: e.round_significant(v, 3))) == pytest.approx([123000, -0.00123])


def test_resample_and_gaps(spark):
    f = frame(spark, x=[(0, 0), (1, 10), (3, 30)])
    for how in ({}, {"rows_per_slice": 1}):
        assert values(align.resample(f, 2.0, **how)) == pytest.approx([0, 5, 10, 15, 20, 25, 30])
    other = frame(spark, x=[(-1, 0), (0.5, 0), (3, 0), (4, 0)])
    assert values(align.resample_onto(f, other)) == pytest.approx([5, 30])
    got = align.interpolated(other.samples, f.samples, gaps=True).orderBy("ts_ns").collect()
    assert str([r["other"] for r in got]) == str([NAN, 5.0, 30.0, NAN])


def test_union_grid_repeats(spark):
    f = frame(spark, a=[(0, 1), (0, 2), (1, 3)], b=[(0, 9), (2, 8)])
    got = [tuple(r) for r in align.union_grid(f).orderBy("ts_ns", "occurrence").collect()]
    assert got == [(0, 1, 1, 9), (0, 2, 2, None), (10**9, 1, 3, None), (2 * 10**9, 1, None, 8)]


def gated(spark, **how):
    signal = [(i / 10, i) for i in range(12)]
    gate = [(0, 0), (0.2, 1), (0.4, 1), (0.5, 0), (0.8, 0), (0.9, 1), (1.1, 1)]
    return frame(spark, x=signal), frame(spark, x=gate)


def test_gate(spark):
    f, g = gated(spark)
    for how in ({}, {"rows_per_slice": 3}):
        assert values(segments.gate(f, g, 0.9, 1.1, 0, 1, **how)) == [2, 3, 4, 9, 10, 11]
        assert [round(t / 1e8) for _, t, _ in points(segments.gate(f, g, 1.1, 0.9, **how))] == [2, 3, 4, 5, 6, 7]
        assert values(segments.gate(f, g, 0.2, 1.1, 0.25, 1, **how)) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        segments.gate(f, g.only("none"), 0, 1)


def test_slice_band_repeat_collapse(spark):
    f = frame(spark, x=[(5 + i, i) for i in range(5)])
    cut = segments.slice_range(f, 3, 1)
    assert values(cut) == [1, 2, 3] and values(segments.slice_range(cut, 2, 9)) == [2, 3]
    assert values(segments.band_zero(f, 1, 2)) == [0, 0, 0, 3, 4] and values(segments.band_keep(f, 1, 2)) == [0, 1, 2, 0, 0]
    assert [t / 1e9 for _, t, _ in points(segments.repeat(f, 2))] == list(range(5, 15))
    with pytest.raises(ValueError):
        segments.repeat(f, 2, most_samples=9)
    d = frame(spark, x=[(0, 1), (0, 3), (1, 3), (2, 3), (2, 5)])
    assert [values(segments.collapse_instants(d, k, 2)) for k in ("first", "last", "mean")] == [[1, 3, 3], [3, 3, 5], [2, 3, 4]]
    assert [[t / 1e9 for _, t, _ in points(segments.collapse_plateaus(d, k))] for k in ("first", "last")] == [[0, 0, 2], [0, 2, 2]]
    with pytest.raises(ValueError):
        segments.select_channels(f, ["none"])


def test_a_plateau_ends_with_the_first_sample_of_its_last_instant(spark):
    f = frame(spark, x=[(0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (1, 2), (3, 2), (3, 2)])
    for how in ({}, {"rows_per_slice": 2}):
        assert [[r["seq"] for r in segments.collapse_plateaus(f, k, **how).samples.orderBy("seq").collect()] for k in ("first", "last")] == [[0, 5], [2, 6]]


def test_spectra(spark):
    f = frame(spark, x=sine(3, 50, 1024, 1024, 2.0))
    amplitude = spectra.fft(f, spectra.FLAT_TOP)
    top = amplitude.samples.orderBy("value", ascending=False).first()
    assert top["value"] == pytest.approx(3, rel=1e-3) and top["ts_ns"] == pytest.approx(50e9, rel=1e-6)
    assert amplitude.channels.first()["domain"] == "frequency" and amplitude.channels.first()["source_start_ns"] == 2 * 10**9
    assert spectra.peak_hz(frame(spark, x=sine(1, 50.3, 1000, 1000))).first()["value"] == pytest.approx(50.3, abs=0.1)
    back = spectra.revert_fft(spectra.rfft_magnitude(f), spectra.rfft_phase(f))
    assert values(back) == pytest.approx(values(f), abs=1e-9) and points(back)[0][1] == 2 * 10**9
    both = frame(spark, x=[(t, a + b) for (t, a), (_, b) in zip(sine(1, 8, 256, 256), sine(1, 64, 256, 256))])
    assert values(spectra.fft_cut(both, 30, 100)) == pytest.approx([v for _, v in sine(1, 8, 256, 256)], abs=1e-9)
    with pytest.raises(ValueError):
        spectra.fft(frame(spark, x=[(0, 1)]))


def test_four_steps_equal_one(spark):
    f = frame(spark, x=[(i / 100, random.Random(i).uniform(-1, 1)) for i in range(100)], y=[(i, i % 3) for i in range(9)])
    for run in (spectra.rfft_magnitude, lambda g, **k: spectra.fft_keep(g, 0, 20, **k)):
        assert values(run(f, direct_points=8)) == pytest.approx(values(run(f)), abs=1e-9)


def test_measure(spark):
    f = frame(spark, x=[(x / 10, x / 10) for x in range(11)])
    got = measure.measure(f, 200_000_000, 800_000_000).first()
    assert got["n"] == 7 and got["mean"] == pytest.approx(0.5) and got["rms"] == pytest.approx(math.sqrt(0.29)) and got["sigma"] == pytest.approx(0.2160246899)
    assert got["area"] == pytest.approx(0.3) and got["ratio"] == pytest.approx(4) and got["db"] == pytest.approx(20 * math.log10(4)) and got["slope"] == pytest.approx(1)
    flat = measure.value_range(frame(spark, x=[(0, 2), (1, 2)])).first()
    assert (flat["low"], flat["high"]) == (1.5, 2.5)
    assert measure.downsample_minmax(f, 2).count() == 2


def test_catalog(spark):
    f = frame(spark, a=[(0, 1)], b=[(0, 2)])
    assert values(catalog.add(f, frame(spark, b=[(0, 5)])), "b") == [5]
    for wrong in (("a", "b"), ("a", " ")):
        with pytest.raises(ValueError):
            catalog.rename(f, *wrong)
    merged = catalog.merge_unique(catalog.merge_unique(f, f.only("a")), f.only("a"))
    assert sorted(r[0] for r in catalog.names(merged).collect()) == ["a", "a (2)", "a (3)", "b"]
    d = catalog.Derived()
    d.define("c", lambda x: x.map_value(lambda v: v * 10), "a")
    d.define("d", lambda x, y: align.combine(x.renamed("p"), y.renamed("p"), "Add"), "c", "b")
    d.define("lost", lambda x: x, "nowhere")
    with pytest.raises(ValueError):
        d.define("c", lambda x: x, "d")
    got, failed = d.recompute(f)
    assert values(got, "d") == [12] and set(failed) == {"lost"} and d.dependents_of("a") == {"c", "d"}
    catalog.register_operator("Twice", lambda g: g.map_value(lambda v: 2 * v), 1, 1, replace=True)
    assert values(catalog.apply_operator("Twice", f)) == [2, 4]
    with pytest.raises(ValueError):
        catalog.apply_operator("Twice", f, 1)


def test_flatten(spark):
    df = spark.createDataFrame([(1, 10, (1.5, "x"), [1, 2], [1, 2, 3, 4], True)], "seq long, ts long, s struct<a:double,b:string>, v array<int>, m array<int>, ok boolean")
    rows, skipped, capped = catalog.flatten_channels(df, "ts", "seq", {"m": [(1, 2), (0, 1)]})
    got = {r["channel"]: r["value"] for r in rows.collect()}
    assert got == {"s.a": 1.5, "v[0]": 1, "v[1]": 2, "m[1,0]": 1, "m[1,1]": 2, "m[2,0]": 3, "m[2,1]": 4, "ok": 1} and skipped == ["s.b"] and not capped
    assert catalog.flatten_channels(df, "ts", "seq", most_leaves=1)[2]


def test_empty_frames(spark):
    empty = SignalFrame.of(spark.createDataFrame([], "channel string, seq long, ts_ns long, value double"))
    assert values(segments.shift(empty, 1.0)) == [] and values(align.resample(empty, 1.0)) == [] and measure.channel_summary(empty).count() == 0
