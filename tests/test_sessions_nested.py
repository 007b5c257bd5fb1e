import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, points
from tidemark.operators import catalog
from tidemark.sources import profile as p
from tidemark.sources import sinks

RAW = "channel string, seq long, ts_ns long, data_type string, exact decimal(20,0), value double"


def test_typed_values_come_back_exactly_and_only_named_files_are_read(spark, tmp_path):
    from decimal import Decimal

    rows = [("a", 0, 1, "LINT", Decimal(2**53 + 1), float(2**53 + 1)), ("a", 1, 2, "LINT", Decimal(-(2**63)), -(2.0**63)), ("b", 0, 1, "ULINT", Decimal(2**64 - 1), 2.0**64), ("c", 0, 1, "REAL", None, 0.5), ("c", 1, 2, "REAL", None, 0.1), ("c", 2, 3, "REAL", None, math.nan)]
    more = [("d", 0, 1, "INT", None, -7.0), ("d", 1, 2, "INT", None, 2.5), ("d", 2, 3, "INT", None, math.nan), ("e", 0, 1, "LREAL", None, math.inf), ("f", 0, 1, "BOOL", None, 1.0), ("a", 2, 3, "LINT", Decimal(5), 5.0)]
    for some in (rows, more):
        sinks.append_typed(spark.createDataFrame(some, RAW), str(tmp_path))
    got = {(r["channel"], r["seq"]): r for r in sinks.typed_samples(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(more)
    for c, s, _, kind, exact, value in rows + more:
        r = got[c, s]
        assert r["data_type"] == kind and (exact is None or r["exact"] == exact)
        assert r["value"] == value or math.isnan(r["value"]) and math.isnan(value), (c, s)
    assert got["d", 0]["exact"] == -7 and got["d", 1]["exact"] is None
    named = sinks.typed_samples(spark, str(tmp_path), "a")
    read = named.select(F.input_file_name()).distinct().collect()
    assert named.count() == 3 and read and all("channel=a" in r[0] and "data_type=LINT" in r[0] for r in read)


def test_sessions_of_frames(spark, tmp_path):
    f = frame(spark, a=[(0, 1), (1, 2.5)], b=[(0, 2**40)])
    f = f.with_meta(data_type=F.when(F.col("channel") == "b", "DINT").otherwise("LREAL"))
    sinks.save_session(f, f"{tmp_path}/s")
    assert points(sinks.load_session(spark, f"{tmp_path}/s")) == points(f)
    assert points(sinks.load_session(spark, f"{tmp_path}/s", "b")) == [("b", 0, 2.0**40)]


def brute(name, path, value, bounds):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in brute(f"{name}.{k}", f"{path}.{k}", v, bounds)]
    if isinstance(value, list):
        if path in bounds:
            (low, high), (low2, high2) = bounds[path]
            n = high2 - low2 + 1
            return [x for k in range((high - low + 1) * n) for x in brute(f"{name}[{low + k // n},{low2 + k % n}]", path + "[]", value[k] if k < len(value) else None, bounds)]
        return [x for k, v in enumerate(value) for x in brute(f"{name}[{k}]", path + "[]", v, bounds)]
    return [] if isinstance(value, str) else [(name, value)]


def test_nested_values_of_any_depth(spark):
    rng = random.Random(5)

    def row(i):
        inner = lambda: {"x": rng.random(), "note": "t", "m": [[rng.randrange(9) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(3))]}
        return (i, i * 10, [inner() for _ in range(rng.randrange(4))], {"deep": {"g": [float(k) for k in range(4)], "ok": True}}, [[{"v": rng.randrange(5)} for _ in range(2)] for _ in range(rng.randrange(3))])

    rows = [row(i) for i in range(30)]
    schema = "seq long, ts long, a array<struct<x:double,note:string,m:array<array<int>>>>, s struct<deep:struct<g:array<double>,ok:boolean>>, q array<array<struct<v:int>>>"
    bounds = {"s.deep.g": [(1, 2), (5, 6)]}
    got, skipped, capped = catalog.flatten_channels(spark.createDataFrame(rows, schema), "ts", "seq", bounds)
    want = sorted((r[0], name, float(v)) for r in rows for col, value in zip(("a", "s", "q"), r[2:]) for name, v in brute(col, col, value, bounds))
    assert sorted((r["seq"], r["channel"], r["value"]) for r in got.collect()) == want
    assert skipped == ["a[].note"] and not capped and any(n == "a[0].m[1][0]" for _, n, _ in want) and any(n == "s.deep.g[2,5]" for _, n, _ in want)
    some, _, capped = catalog.flatten_channels(spark.createDataFrame(rows, schema), "ts", "seq", bounds, most_leaves=6, present=("s.deep.ok",))
    counts = [r["count"] for r in some.groupBy("seq").count().collect()]
    assert capped and max(counts) == 6 and some.filter("channel = 's.deep.ok'").isEmpty()


def test_null_arrays_and_members(spark):
    df = spark.createDataFrame([(1, 1, None, [None, (2, None)]), (2, 2, (5,), None)], "seq long, ts long, s struct<a:int>, l array<struct<b:int,c:array<int>>>")
    got = sorted((r["seq"], r["channel"], str(r["value"])) for r in catalog.flatten_channels(df, "ts", "seq")[0].collect())
    assert got == [(1, "l[0].b", "nan"), (1, "l[1].b", "2.0"), (1, "s.a", "nan"), (2, "s.a", "5.0")]
    with pytest.raises(ValueError):
        catalog.flatten_channels(df.select("seq", "ts", F.array(F.lit("x")).alias("t")), "ts", "seq")


def test_importing_a_file_again_replaces_its_channels(spark, tmp_path):
    profile = p.ImportProfile((p.ColumnMapping("A", p.X_TIME, unit="ns"), p.ColumnMapping("B", name="v")))
    path = str(tmp_path / "lib")

    def grid(**files):
        return spark.createDataFrame([(f"x/{n}.csv", i, [str(t), str(v)]) for n, rows in files.items() for i, (t, v) in enumerate(rows)], "file string, row_idx long, cells array<string>")

    def have(version=None):
        return [(c, t, v) for c, t, v in points(p.library(spark, path, version))]

    with pytest.raises(ValueError):
        p.library(spark, path)
    first = [("a.csv:v", 1, 10.0), ("a.csv:v", 2, 20.0), ("b.csv:v", 1, 5.0)]
    p.import_into(grid(a=[(1, 10), (2, 20)], b=[(1, 5)]), profile, path)
    assert have() == first
    p.import_into(grid(a=[(1, 10), (2, 20)], b=[(1, 5)]), profile, path)
    assert have() == first and p.library(spark, path).channels.count() == 2
    report = p.import_into(grid(a=[(3, 30)], c=[(9, 9)]), profile, path)
    third = [("a.csv:v", 3, 30.0), ("b.csv:v", 1, 5.0), ("c.csv:v", 9, 9.0)]
    assert have() == third and sorted(tuple(r) for r in report.select("file", "n_samples").collect()) == [("x/a.csv", 1), ("x/c.csv", 1)]
    # One that fails on the way, and one that gives nothing, leave all as it was; an old version can still be read.
    broken = grid(a=[(4, 40)]).withColumn("cells", F.when(F.col("row_idx") >= 0, F.raise_error(F.lit("unreadable")).cast("array<string>")))
    with pytest.raises(Exception, match="unreadable"):
        p.import_into(broken, profile, path)
    assert have() == third
    p.import_into(grid(b=[("no", "number")]).limit(0), profile, path)
    assert have() == third and have(1) == first
