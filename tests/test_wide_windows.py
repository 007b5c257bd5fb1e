import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from tidemark.operators import windows

OPERATORS = {
    windows.rolling_mean: lambda v: sum(v) / len(v),
    windows.rolling_rms: lambda v: math.sqrt(sum(x * x for x in v) / len(v)),
    windows.rolling_min: lambda v: min((x for x in v if not math.isnan(x)), default=math.nan),
    windows.rolling_max: lambda v: math.nan if any(map(math.isnan, v)) else max(v),
}


@pytest.mark.parametrize("window_s", [7.0, 3.000000007, 100.0])
def test_windows_cut_into_pieces_equal_the_definition(spark, window_s):
    rng = random.Random(3)
    a = sorted((round(rng.random() * 20, 2) if i % 3 else round(rng.random() * 2, 1), rng.choice([math.nan, 1.0, -2.0, 5.5]) if i % 40 == 0 else rng.gauss(0, 5)) for i in range(240))
    b = [(1000 + i * 0.5, float(i)) for i in range(10)] + [(2000 + i * 1e-9, float(i)) for i in range(30)]
    f = frame(spark, a=a, b=b, c=[(-5.0, 1.0), (-4.5, 2.0)])
    w = int(window_s * 1e9)
    rows = sorted((r["channel"], r["ts_ns"], r["seq"], r["value"]) for r in f.samples.collect())
    for operator, of in OPERATORS.items():
        want = {}
        for c, t, s, _ in rows:
            want[c, s] = of([v for d, u, q, v in rows if d == c and u >= t - w and (u, q) <= (t, s)])
        for rows_per_slice in (8, 100):
            got = {(r["channel"], r["seq"]): r["value"] for r in operator(f, window_s, rows_per_slice).samples.collect()}
            assert got.keys() == want.keys()
            for k, v in want.items():
                assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9, nan_ok=True), (operator.__name__, k, rows_per_slice)


def test_a_window_over_a_whole_channel_is_many_tasks_work(spark):
    n, per = 200_000, 10_000
    samples = spark.range(n).select(F.lit("hot").alias("channel"), F.col("id").alias("seq"), (F.col("id") * 1_000_000).alias("ts_ns"), (F.col("id") % 100).cast("double").alias("value"))
    f = windows.SignalFrame.of(samples)
    got = windows.rolling_mean(f, 1000.0, per)
    last = got.samples.filter(F.col("seq").isin(0, 99, 100, n - 1)).collect()
    assert {r["seq"]: round(r["value"], 9) for r in last} == {0: 0.0, 99: 49.5, 100: round(4950 / 101, 9), n - 1: 49.5}
    placed = samples.withColumn("piece", F.expr(f"ts_ns div {10**12 // 128}"))
    assert placed.groupBy("piece").count().agg(F.max("count")).first()[0] <= per and got.samples.count() == n
