"""What must stay linear, spread and shared as channels grow."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, values
from tidemark import scratch
from tidemark.frame import SignalFrame
from tidemark.functions.design import design
from tidemark.operators import align, filters, kernels, spectra, windows


def long_frame(spark, n, step=1_000_000):
    rows = spark.range(n).select(F.lit("a").alias("channel"), F.col("id").alias("seq"), (F.col("id") * step).alias("ts_ns"), (F.col("id") % 97).cast("double").alias("value"))
    return SignalFrame.of(rows)


def seconds(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_next_known_is_linear(spark):
    f = long_frame(spark, 500_000)
    s = kernels.next_known(kernels.sliced(f.samples), F.when(F.col("seq") % 1000 == 0, F.col("seq")), "after")
    assert not s.many and seconds(s.df) < 60
    assert s.df.filter("after <> ceil(seq / 1000) * 1000").isEmpty()


def test_a_wide_rolling_window_is_linear(spark):
    f = long_frame(spark, 300_000)
    got = windows.rolling_mean(f, 100.0)  # 100,001 samples
    assert seconds(got.samples) < 60
    assert values(got)[-1] == pytest.approx(np.mean(np.arange(199_999, 300_000) % 97))


def test_rolling_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = sorted((round(float(t), 2), float(v)) for t, v in zip(rng.random(80) * 20, rng.standard_normal(80)))
    data += [(data[-1][0], 3.0)] * 2
    f, got = frame(spark, a=data, b=data[:9]), []
    for rows in (1000, 0):
        monkeypatch.setattr(windows, "DIRECT_ROWS", rows)
        got.append([values(op(f, 1.5)) for op in (windows.rolling_mean, windows.rolling_rms, windows.rolling_min, windows.rolling_max)])
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in zip(*got))


def test_a_nan_leaves_with_its_window(spark):
    data = [(i, float("nan") if i == 3 else i) for i in range(12)]
    got = values(windows.rolling_mean(frame(spark, a=data), 2.0))
    assert [i for i, v in enumerate(got) if v != v] == [3, 4, 5] and got[6] == 5.0


def test_slices_of_crowded_and_outlying_samples_are_even(spark):
    times = [*range(1000), *range(500_000_000, 500_003_000), 9 * 10**18, 1000]
    f = SignalFrame.of(spark.createDataFrame([("a", i, t, float(i)) for i, t in enumerate(times)], "channel string, seq long, ts_ns long, value double"))
    s = kernels.sliced(f.samples, 100)
    sizes = [r["count"] for r in s.df.groupBy("slice").count().collect()]
    assert s.many and sum(sizes) == len(times) and max(sizes) <= 220
    spans = s.df.groupBy("slice").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b")).orderBy("slice").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))
    row = kernels.ordinals(s).df.orderBy("ts_ns", "seq").select("row").collect()
    assert [r["row"] for r in row] == list(range(len(times)))


def test_chained_operators_ask_for_the_length_once(spark, monkeypatch):
    asked = []
    of = kernels.Longest.of
    f = long_frame(spark, 1000)
    monkeypatch.setattr(kernels.Longest, "of", staticmethod(lambda samples: asked.append(1) or of(samples)))
    filters.filtfilt(filters.pt, windows.derivative(f.map_value(lambda v: v + 1)), 0, 3, 0.5)
    assert not asked


def test_recurrences_over_pieces_equal_plain_ones():
    rng = np.random.default_rng(4)
    for n in (10, 255, 256, 1000, 4099):
        x, keep = rng.standard_normal(n), rng.random(n)
        y, want = 0.3, []
        for k, v in zip(keep, x):
            y = k * y + v
            want.append(y)
        assert np.allclose(filters.run_affine(keep, x, 0.3), want, atol=1e-10)
        sections = design("elliptic", 2, 3, (5.0, 12.0), 100.0, 1.0, 40.0)
        state = rng.standard_normal(2 * len(sections))
        whole, after = filters.run_sections(sections, x, state)
        parts, between = [], state
        for i in range(0, n, 100):  # below the length from which pieces run
            part, between = filters.run_sections(sections, x[i : i + 100], between)
            parts.append(part)
        assert np.allclose(whole, np.concatenate(parts), atol=1e-8) and np.allclose(after, between, atol=1e-8)
    assert np.isnan(filters.run_affine(np.full(600, 0.5), np.where(np.arange(600) == 300, np.nan, 1.0), 0.0)).sum() == 300


def test_welch_in_batches_equals_runs_by_themselves(spark):
    from tidemark.operators import spectra

    rng = np.random.default_rng(1)
    f = frame(spark, x=[(i / 50, float(v)) for i, v in enumerate(rng.standard_normal(400))])
    gate = frame(spark, x=[(i / 50, float((i // 20) % 3 > 0)) for i in range(400)])
    a, b = (spectra.fft_welch(f, gate, 0.5, 1.5, direct_points=d) for d in (1 << 20, 16))
    assert values(a) == pytest.approx(values(b), abs=1e-9)


def test_interpolation_beside_both_sides_in_slices(spark):
    a, b = frame(spark, x=[(i, i) for i in range(50)]), frame(spark, x=[(i + 0.5, 2 * i) for i in range(30)])
    got = [values(align.combine(a, b, "Add", rows_per_slice=n)) for n in (4, 1000)]
    assert got[0] == pytest.approx(got[1]) and len(got[0]) == 30


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, **of):
            self.of = of

        def get(self, k, default=None):
            return self.of.get(k, default)

        def set(self, k, v):
            self.of[k] = v

    class Session:
        pass

    cluster = Session()
    cluster.conf = Conf(**{"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(cluster)
    path = scratch.new_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    scratch.discard(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        scratch.discard(spark, "/root")


def test_welch_over_slices_is_a_small_plan(spark):
    data = [(i * 0.01, float(i % 7)) for i in range(300)]
    f, gate = frame(spark, x=data), frame(spark, x=[(i * 0.1, float(i % 5 > 1)) for i in range(31)])
    whole, cut = (spectra.fft_welch(f, gate, 0.5, 1.5, rows_per_slice=n) for n in (1000, 100))
    relations = cut.samples._jdf.queryExecution().analyzed().collectLeaves().size()
    assert relations <= 12, relations
    assert values(cut) == pytest.approx(values(whole), abs=1e-9)
