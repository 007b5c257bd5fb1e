import math
import random

import numpy as np
import pytest

from tests.helpers import frame, points, sine, values
from tidemark.functions.design import design
from tidemark.operators import filters, windows

SLICES = {"rows_per_slice": 7}


def wobble(n=60, seed=1, ties=True):
    rng, t, out = random.Random(seed), 0.0, []
    for _ in range(n):
        t += rng.choice([0.0, 0.25, 0.5, 1.0] if ties else [0.25, 0.5, 1.0])
        out.append((t, rng.uniform(-3, 3)))
    return out


def test_integral_of_a_sine(spark):
    got = values(windows.integral(frame(spark, a=sine(2, 5, 1000, 1000)), **{"rows_per_slice": 90}))
    want = [2 / (2 * math.pi * 5) * (1 - math.cos(2 * math.pi * 5 * i / 1000)) for i in range(1000)]
    assert max(abs(a - b) for a, b in zip(got, want)) < 5e-4 and got[0] == 0


def test_derivative_of_a_square(spark):
    got = values(windows.derivative(frame(spark, a=[(i / 100, (i / 100) ** 2) for i in range(51)]), **SLICES))
    assert all(abs(got[i] - 2 * i / 100) < 1e-9 for i in range(1, 50))
    assert got[0] == pytest.approx(0.01) and got[-1] == pytest.approx(0.99)
    assert values(windows.derivative(frame(spark, a=[(0, 5)]))) == [0.0]
    assert values(windows.derivative(frame(spark, a=[(0, 1), (0, 2), (0, 3)]))) == [0.0, 2 / 1e-12, 0.0]


def test_rolling_mean_and_rms(spark):
    f = frame(spark, a=[(i, i + 1) for i in range(5)])
    assert values(windows.rolling_mean(f, 2.0)) == [1, 1.5, 2, 3, 4]
    assert values(windows.rolling_rms(frame(spark, a=sine(3, 10, 1000, 1000)), 10.0))[-1] == pytest.approx(3 / math.sqrt(2), abs=1e-9)
    with pytest.raises(ValueError):
        windows.rolling_mean(f, 0.0)


@pytest.mark.parametrize("name, reduce", [("rolling_mean", np.mean), ("rolling_min", np.min), ("rolling_max", np.max), ("rolling_rms", lambda x: np.sqrt(np.mean(np.square(x))))])
def test_rolling_by_slices_with_ties(spark, name, reduce):
    data = wobble()
    want = [reduce([v for t2, v in data[: i + 1] if t - t2 <= 1.5]) for i, (t, _) in enumerate(data)]
    f = frame(spark, a=data)
    for how in ({}, SLICES):
        assert values(getattr(windows, name)(f, 1.5, **how)) == pytest.approx(want, abs=1e-12)


def test_forward_fill_and_reverse(spark):
    f = frame(spark, a=[(i, v) for i, v in enumerate([0, 0, 3, 0, 0, 5, 0])])
    assert values(windows.forward_fill(f)) == [0, 0, 3, 3, 3, 5, 5]
    assert values(windows.forward_fill(f, rows_per_slice=2)) == [0, 0, 3, 3, 3, 5, 5]
    assert values(windows.backward_fill(f, rows_per_slice=2)) == [3, 3, 3, 5, 5, 5, 0]
    uneven = frame(spark, a=[(0, 1), (1, 2), (4, 3)])
    assert [(t / 1e9, v) for _, t, v in points(windows.reverse(uneven))] == [(0, 3), (3, 2), (4, 1)]
    assert points(windows.reverse(windows.reverse(uneven))) == points(uneven)


def lag(data, tau, high=False):
    t, x = [p[0] for p in data], [p[1] for p in data]
    y, out = x[0], []
    for i in range(len(x)):
        if i:
            dt = (t[i] - t[i - 1]) if i == len(x) - 1 else (t[i + 1] - t[i - 1]) / 2
            a = dt / (tau + dt)
            y = a * x[i] + (1 - a) * y
        out.append(x[i] - y if high else y)
    return out


def test_lags_by_slices(spark):
    data = wobble(ties=False)
    f = frame(spark, a=data)
    for how in ({}, SLICES):
        assert values(filters.low_pass(f, 2.0, **how)) == pytest.approx(lag(data, 2.0), abs=1e-12)
        assert values(filters.high_pass(f, 2.0, **how)) == pytest.approx(lag(data, 2.0, True), abs=1e-12)
    twice = lag([(t, v) for (t, _), v in zip(data, lag(data, 2.0))], 2.0)
    assert values(filters.pt(f, 0, 2, 2.0, **SLICES)) == pytest.approx(twice, abs=1e-12)
    with pytest.raises(ValueError):
        filters.pt(f, 2, 1, 1.0)


def direct(sections, x):
    for b0, b1, b2, a1, a2 in sections:
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for v in x:
            y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        x = out
    return x


@pytest.mark.parametrize("family, band, order, edges, pass_db, stop_db", [("butterworth", 0, 3, (5.0,), 0, 0), ("cheby1", 1, 2, (5.0,), 1, 0), ("cheby2", 2, 2, (5.0, 15.0), 0, 30), ("elliptic", 3, 3, (5.0, 15.0), 1, 40)])
def test_recursive_filters_by_slices(spark, family, band, order, edges, pass_db, stop_db):
    data = [(i / 100, random.Random(i).uniform(-1, 1)) for i in range(80)]
    want = direct(design(family, band, order, edges, 100.0, pass_db, stop_db), [v for _, v in data])
    f = frame(spark, a=data)
    for how in ({}, {"rows_per_slice": 11}):
        assert values(filters.iir(f, family, band, order, *edges, pass_db=pass_db, stop_db=stop_db, **how)) == pytest.approx(want, abs=1e-9)


def response(sections, hz, fs):
    z = np.exp(-2j * np.pi * hz / fs)
    return 20 * np.log10(abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections])) + 1e-30)


def test_designs_meet_their_edges():
    assert response(design("butterworth", 0, 4, (100.0,), 1000.0), 100, 1000) == pytest.approx(-3.0103, abs=1e-3)
    assert response(design("butterworth", 2, 3, (50.0, 150.0), 1000.0), 150, 1000) == pytest.approx(-3.0103, abs=1e-3)
    assert response(design("cheby1", 1, 3, (100.0,), 1000.0, 1.0), 100, 1000) == pytest.approx(-1, abs=1e-6)
    assert response(design("cheby2", 0, 5, (100.0,), 1000.0, 0.0, 40.0), 100, 1000) == pytest.approx(-40, abs=1e-6)
    for order in (1, 2, 3, 4, 5, 8):
        sections = design("elliptic", 0, order, (100.0,), 1000.0, 1.0, 40.0)
        ripple = [response(sections, f, 1000) for f in np.linspace(0, 100, 200)]
        assert min(ripple) == pytest.approx(-1, abs=2e-2) and max(ripple) < 1e-9
        assert ripple[0] == pytest.approx(0 if order % 2 else -1, abs=1e-9)
        assert all(abs(np.roots([1, a1, a2])).max() < 1 for *_, a1, a2 in sections)
    assert max(response(design("elliptic", 0, 5, (100.0,), 1000.0, 1.0, 40.0), f, 1000) for f in np.linspace(130, 499, 300)) < -39.9


def test_filter_errors_and_zero_phase(spark):
    f = frame(spark, a=sine(1, 2, 100, 300))
    for wrong in (lambda: filters.butterworth(f, 0, 2, 60.0), lambda: filters.butterworth(f, 2, 2, 5.0), lambda: filters.elliptic(f, 0, 2, 40.0, 1.0, 5.0), lambda: filters.filtfilt(windows.integral, f)):
        with pytest.raises(ValueError):
            wrong()
    got = values(filters.filtfilt(filters.butterworth, f, 0, 2, 10.0))
    assert max(abs(a - b) for a, b in zip(got[80:220], [v for _, v in sine(1, 2, 100, 300)][80:220])) < 0.02
