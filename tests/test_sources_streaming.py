import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, points, sine, values
from tidemark.frame import TIME
from tidemark.operators import filters, spectra, windows
from tidemark.plans import queries
from tidemark.sources import json_files, sinks, tables, text
from tidemark.sources import profile as p
from tidemark.streaming import ingest, stateful


def put(path, content):
    path.write_text(content)
    return str(path)


def test_grid(spark, tmp_path):
    f = put(tmp_path / "g.csv", 'a,"b,""c""",d\n# note\n1,,3\n4\n')
    rows = text.read_grid_csv(spark, f).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["cells"]) for r in rows] == [(0, ["a", 'b,"c"', "d"]), (1, ["1", "", "3"]), (2, ["4"])]
    f = put(tmp_path / "h.txt", "1\t2|3\t4")
    assert [r["cells"] for r in text.read_grid_csv(spark, f, "\t", "|").orderBy("row_idx").collect()] == [["1", "2"], ["3", "4"]]


def grid(spark, *rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "row_idx long, cells array<string>")


def test_profile_units_ranges_and_bad_cells(spark):
    g = grid(spark, ("t", "v", "w"), ("0", "1", "x"), ("0,5", "2,5", ""), ("", "9", "9"), ("1", "3"))
    prof = p.ImportProfile((p.ColumnMapping("A", p.X_TIME, unit="ms"), p.ColumnMapping("B", name="v", unit="V", time_offset_s=5.0, relative_time=True), p.ColumnMapping("C")), header_row=1, decimal=",")
    got = p.import_profile(g, prof, "file")
    assert points(got.frame.only("v")) == [("v", 5_000_000_000, 1.0), ("v", 5_000_500_000, 2.5), ("v", 5_001_000_000, 3.0)]
    assert values(got.frame, "ColC") == [0.0, 0.0]
    bad = [tuple(r) for r in got.bad_cells.collect()]
    assert bad == [("C", False, 1, "x", 1)]
    assert {r["source_symbol"] for r in got.frame.channels.collect()} == {"file:B", "file:C"}


def test_profile_axes(spark):
    g = grid(spark, ("1704067200000000001", "1", "7"), ("1704067200000000002", "2", "8"), ("bad", "3", "9"))
    x = p.ColumnMapping("A", p.X_TIME, unit="ns")
    assert [t for _, t, _ in points(p.import_profile(g, p.ImportProfile((x, p.ColumnMapping("B", row_end=1)))).frame)] == [1704067200000000001, 1704067200000000002]
    got = p.import_profile(g, p.ImportProfile((x, p.ColumnMapping("B"), p.ColumnMapping("C"))))
    assert [tuple(r) for r in got.bad_cells.collect()] == [("A", True, 1, "bad", 2)]
    rate = p.import_profile(g, p.ImportProfile((p.ColumnMapping("B", sample_rate_hz=p.rate_hz(2, "ms"), row_start=1),)))
    assert [t for _, t, _ in points(rate.frame)] == [0, 2_000_000]
    freq = p.import_profile(grid(spark, ("1.5", "4")), p.ImportProfile((p.ColumnMapping("A", p.X_FREQUENCY, unit="kHz"), p.ColumnMapping("B"))))
    assert points(freq.frame)[0][1] == 1500 * 10**9 and freq.frame.channels.first()["domain"] == "frequency"
    both = (x, p.ColumnMapping("C", p.X_FREQUENCY), p.ColumnMapping("B"))
    for wrong in (both, (p.ColumnMapping("B"),), (p.ColumnMapping("B", x_column="Z"), x), (x,)):
        with pytest.raises(ValueError):
            p.import_profile(g, p.ImportProfile(wrong))
    assert p.unit_warnings(p.ImportProfile((p.ColumnMapping("A", p.X_TIME, unit="hours"),))) and p.column_letters(27) == "AB" and p.column_index("AB") == 27


def test_profile_collapse_and_files(spark):
    g = grid(spark, ("0", "1"), ("0", "3"), ("1", "3"))
    prof = p.ImportProfile((p.ColumnMapping("A", p.X_TIME), p.ColumnMapping("B", collapse_instants="mean", collapse_plateaus="last")))
    assert [v for _, _, v in points(p.import_profile(g, prof).frame)] == [2, 3]
    files = spark.createDataFrame([("d/one.csv", 0, ["0", "1"]), ("d/two.csv", 0, ["", "1"])], "file string, row_idx long, cells array<string>")
    f, report = p.import_files(files, p.ImportProfile((p.ColumnMapping("A", p.X_TIME), p.ColumnMapping("B", name="v"))))
    assert {r["file"]: (r["n_channels"], r["n_samples"]) for r in report.collect()} == {"d/one.csv": (1, 1), "d/two.csv": (0, 0)}
    assert [c for c, _, _ in points(f)] == ["one.csv:v"]


def test_signal_csv_layouts(spark, tmp_path):
    shared = put(tmp_path / "a.csv", "t [ms];a [V];b;f [kHz];g\n0;1,5;2;1;7\n1;;3;2;x\n")
    f = text.read_signal_csv(spark, shared)
    assert points(f) == [("a", 0, 1.5), ("b", 0, 2.0), ("b", 10**6, 3.0), ("g", 10**12, 7.0)]
    assert {r["channel"]: (r["unit"], r["domain"]) for r in f.channels.collect()} == {"a": ("V", TIME), "b": ("", TIME), "g": ("", "frequency")}
    pairs = put(tmp_path / "b.csv", "t_a [s],a,t_b [s],b\n0,1,0.5,2\n1,3,,\n")
    assert points(text.read_signal_csv(spark, pairs)) == [("a", 0, 1), ("a", 10**9, 3), ("b", 5 * 10**8, 2)]
    big = put(tmp_path / "c.csv", "t,a\n1704067200000000001,1\n")
    assert points(text.read_signal_csv(spark, big)) == [("a", 1704067200000000001, 1)]
    note = json.dumps({"v": 1, "columns": [{"role": "signal", "name": "q", "unit": "A", "refX": 1}, {"role": "x_time", "unit": "ms"}]})
    noted = put(tmp_path / "d.csv", f"# x-csv: {note}\nwhat,ever\n5,2\n")
    assert points(text.read_signal_csv(spark, noted)) == [("q", 2 * 10**6, 5)]
    for bad in ("", "only\n1\n"):
        with pytest.raises(ValueError):
            text.read_signal_csv(spark, put(tmp_path / "e.csv", bad))


def test_paired_export(spark, tmp_path):
    rows = [
        "Name;bench 7", "Operator;nobody", "Name;Inlet pressure;Name;Valve;Name;Idle", "Data-Type;LREAL;Data-Type;INT;Data-Type;INT", "SampleTime[ms];0,5;SampleTime[ms];20;SampleTime[ms];1", "Unit;(bar);Unit;(None);Unit;(A)",
        "0,5;1,25;7;-3;;", "1;1,5;27;4;;", "1,5;nope;;;;", "2;1,75;;;;",
    ]
    f = sinks.open_signals(spark, put(tmp_path / "bench.txt", "\n".join(rows)))
    assert points(f) == [("Inlet pressure", 500_000, 1.25), ("Inlet pressure", 1_000_000, 1.5), ("Inlet pressure", 2_000_000, 1.75), ("Valve", 7_000_000, -3), ("Valve", 27_000_000, 4)]
    assert {r["channel"]: r["unit"] for r in f.channels.collect()} == {"Inlet pressure": "bar", "Valve": ""}
    tabbed = tmp_path / "tabs.csv"
    tabbed.write_bytes("\r\n".join(r.replace(";", "\t") for r in rows).encode())
    assert points(sinks.open_signals(spark, str(tabbed))) == points(f)


def test_json_tables(spark, tmp_path):
    records = put(tmp_path / "r.json", '[{"t": 0, "speed": 1.5, "o": {"x": 1}}, {"t": 0.1, "torque": true}]')
    assert [tuple(r) for r in json_files.read_json_records(spark, records).orderBy("row_idx").collect()] == [(0, "0", "1.5", None, None), (1, "0.1", None, None, "true")]
    f = sinks.open_signals(spark, records)
    assert str(points(f.only("speed", "torque"))) == str([("speed", 0, 1.5), ("speed", 10**8, math.nan), ("torque", 0, math.nan), ("torque", 10**8, 1.0)])
    nested = put(tmp_path / "n.json", '{"meta": "x", "data": [{"t": 1, "v": 2}]}')
    assert points(sinks.open_signals(spark, nested)) == [("v", 10**9, 2)]
    columns = put(tmp_path / "c.json", '{"t": [0, 0.1, 0.2], "a": [1, 2]}')
    assert [tuple(r) for r in json_files.read_json_columnar(spark, columns).orderBy("row_idx").collect()] == [(0, "0", "1"), (1, "0.1", "2"), (2, "0.2", None)]
    assert [tuple(r) for r in json_files.read_json_columnar(spark, put(tmp_path / "d.json", "[[1, 2], [3]]")).orderBy("row_idx").collect()] == [(0, "1", "2"), (1, "3", None)]
    assert json_files.read_json_columnar(spark, put(tmp_path / "e.json", "[5, 6]")).count() == 2


def test_round_trips(spark, tmp_path):
    f = frame(spark, "V", a=[(1.5, 1.25), (2, math.nan)], b=[(0, -2e-7)])
    sinks.write_signal_json(f, f"{tmp_path}/s.json")
    sinks.save_session(f, f"{tmp_path}/session")
    for back in (sinks.open_signals(spark, f"{tmp_path}/s.json"), sinks.open_signals(spark, f"{tmp_path}/session")):
        assert str(points(back)) == str(points(f)) and {r["unit"] for r in back.channels.collect()} == {"V"}
    assert points(sinks.load_session(spark, f"{tmp_path}/session", "b")) == [("b", 0, -2e-7)]
    spectrum = spectra.fft(frame(spark, s=sine(1, 10, 64, 64)))
    mixed = type(f)(f.samples.unionByName(spectrum.samples.withColumn("channel", spectrum.samples["channel"])), f.channels.unionByName(spectrum.channels))
    written = sinks.save_split(mixed, f"{tmp_path}/split", sinks.save_session)
    assert [w.rsplit("_", 1)[1] for w in written] == ["time", "frequency"]


def test_long_signals_take_several_json_lines(spark, tmp_path, monkeypatch):
    n = 2 * 10_000 + 5
    f = frame(spark, "V", a=[(n - i if i % 2 else -i, i) for i in range(n)], b=[(0, math.nan), (0, 1)])
    sinks.write_signal_json(f, f"{tmp_path}/s.json")
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/s.json").collect()]
    assert sorted((r["name"], len(r["t"])) for r in lines) == [("a", 5), ("a", 10_000), ("a", 10_000), ("b", 2)]
    doc = put(tmp_path / "doc.json", json.dumps({"v": 1, "signals": lines[:1]}, indent=1))
    assert json_files.read_signal_json(spark, doc).samples.count() == len(lines[0]["t"])
    plain = put(tmp_path / "plain.json", '{"name": "q", "t": [3, 5], "v": [1, null]}\n')
    assert [(r["seq"], r["ts_ns"]) for r in json_files.read_signal_json(spark, plain).samples.orderBy("seq").collect()] == [(0, 3), (1, 5)]
    monkeypatch.setattr(json_files, "_whole", None)  # lines are never read as one value
    back = sinks.open_signals(spark, f"{tmp_path}/s.json")
    assert str(points(back)) == str(points(f)) and sorted(r["channel"] for r in back.channels.collect()) == ["a", "b"]
    assert [r["seq"] for r in back.only("a").samples.orderBy("ts_ns").collect()] == list(range(n))


def test_wide_csv(spark, tmp_path):
    f = frame(spark, "V", a=[(0, 1), (2, 3)], b=[(1, 5.5), (2, 6)])
    sinks.write_wide_csv(f, f"{tmp_path}/w.csv", sep=";", decimal=",")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/w.csv").collect()]
    assert lines == ["t [s];a [V];b [V]", "0;1;", "1;2;5,5", "2;3;6"]
    note = json.loads(spark.read.text(f"{tmp_path}/w.csv.meta").first()[0])
    assert [c["role"] for c in note["columns"]] == ["x_time", "signal", "signal"] and note["columns"][2]["refX"] == 0
    assert points(text.read_signal_csv(spark, f"{tmp_path}/w.csv"))[:2] == [("a", 0, 1), ("a", 10**9, 2)]
    sinks.write_wide_csv(f, f"{tmp_path}/p.csv", absolute_ns=True, paired=True)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/p.csv").collect()] == ["t_a [ns],a [V],t_b [ns],b [V]", "0,1,1000000000,5.5", "2000000000,3,2000000000,6"]


def test_number_format(spark):
    cases = {0.1: "0.1", 1e15: "1e+15", 123456.0: "123456", -2.5e-7: "-2.5e-07", 1 / 3: "0.333333333333333", 100.0: "100", 0.00012: "0.00012", 0.0: "0"}
    df = spark.createDataFrame([(v,) for v in cases] + [(math.nan,)], "v double")
    got = [r[0] for r in df.select(sinks.format_number(df["v"])).collect()]
    assert got == [*cases.values(), ""]


def test_noted_part_files(spark, tmp_path):
    f = frame(spark, "V", t=[(0, 1), (2, 3)], **{"f [x]": [(1, 5.5), (2, math.nan)]})
    sinks.write_wide_csv(f, f"{tmp_path}/n.csv", paired=True, noted=True)
    back = text.read_signal_csv(spark, f"{tmp_path}/n.csv")
    assert points(back) == [("f [x]", 10**9, 5.5), ("t", 0, 1), ("t", 2 * 10**9, 3)] and {r["unit"] for r in back.channels.collect()} == {"V"}
    with pytest.raises(ValueError, match="separator"):
        sinks.write_wide_csv(frame(spark, **{"a,b": [(0, 1)]}), f"{tmp_path}/m.csv", noted=True)


def test_late_rows_are_marked_whatever_the_batches(spark, tmp_path):
    rows = [("a", 0, 100, 1.0), ("a", 1, 40, 2.0), ("b", 2, 5, 3.0), ("a", 3, 90, 4.0), ("a", 4, 200, 5.0), ("a", 5, 139, 6.0), ("b", 6, 5, 7.0)]
    want = [("a", 0, False), ("a", 1, True), ("a", 3, False), ("a", 4, False), ("a", 5, True), ("b", 2, False), ("b", 6, False)]
    for i, cuts in enumerate(([], [1, 2, 5], [3])):
        stream = batches(spark, tmp_path / str(i), rows, cuts, "channel string, seq long, ts_ns long, value double")
        got = run(stateful.marked_late(stream, 60e-9), spark, f"late{i}")
        assert sorted((r["channel"], r["seq"], r["late"]) for r in got.collect()) == want


def test_unit_report_and_empty_files(spark):
    g = grid(spark, ("1", "2"), ("", "3"), ("4", ""))
    hours = p.ImportProfile((p.ColumnMapping("A", p.X_TIME, unit="hours"), p.ColumnMapping("B")))
    assert [tuple(r) for r in p.unit_report(g, hours).collect()] == [("A", "hours", "seconds", 2)]
    assert p.unit_report(g, p.ImportProfile((p.ColumnMapping("A", p.X_TIME, unit="ms"), p.ColumnMapping("B")))).count() == 0
    files = spark.createDataFrame([("x/a.csv", i, [str(i), str(i // 2)]) for i in range(6)] + [("y/b.csv", 0, ["9", "1", "5"])], "file string, row_idx long, cells array<string>")
    f, report = p.import_files(files, p.ImportProfile((p.ColumnMapping("A", p.X_TIME, unit="ns"), p.ColumnMapping("B", name="v", collapse_plateaus="last", relative_time=True), p.ColumnMapping("C", name="w"))))
    assert points(f) == [("a.csv:v", 1, 0), ("a.csv:v", 3, 1), ("a.csv:v", 5, 2), ("b.csv:v", 0, 1), ("b.csv:w", 9, 5)]
    assert sorted(tuple(r) for r in report.select("file", "n_channels", "n_samples").collect()) == [("x/a.csv", 1, 3), ("y/b.csv", 2, 2)]
    assert {r["channel"]: r["source_symbol"] for r in f.channels.collect()} == {"a.csv:v": "a.csv:B", "a.csv:w": "a.csv:C", "b.csv:v": "b.csv:B", "b.csv:w": "b.csv:C"}


def batches(spark, tmp_path, rows, cuts, schema):
    """A file stream that gives the rows in several micro-batches."""
    folder = tmp_path / "in"
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    data = [(i * 0.25 + (i % 3) * 0.1, math.sin(i)) for i in range(20)]
    f = frame(spark, a=data, b=data[:7])
    rows = [tuple(r) for r in f.samples.orderBy("ts_ns", "seq").select("channel", "seq", "ts_ns", "value").collect()]
    last = {c: max(r[1] for r in rows if r[0] == c) for c in "ab"}
    ended = [(*r, r[1] == last[r[0]]) for r in rows]
    stream = batches(spark, tmp_path, ended, [5, 11, 12], "channel string, seq long, ts_ns long, value double, ends boolean")
    key = lambda df: sorted((r["channel"], r["seq"], round(r["value"], 9)) for r in df.collect())
    assert key(run(stateful.lag_stages(stream, 0.8), spark, "low")) == key(filters.low_pass(f, 0.8).samples)
    assert key(run(stateful.lag_stages(stream, 0.8, 2, True), spark, "high")) == key(filters.pt(f, 1, 2, 0.8).samples)
    plain = stream.drop("ends")
    assert key(run(stateful.forward_fill(plain, 0.0, 0.5), spark, "fill")) == key(windows.forward_fill(f, 0.0, 0.5).samples)
    assert key(run(stateful.integral(plain), spark, "area")) == key(windows.integral(f).samples)


def test_ordered_stream_in_bounded_batches(spark, tmp_path, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    f = tables.events(spark, sf_dir)
    monkeypatch.setattr(ingest, "ROWS_PER_FILE", 150, raising=False)
    monkeypatch.setattr(queries, "new_folder", lambda spark, label: f"{tmp_path}/{label}")
    key = lambda df: sorted((r["channel"], r["seq"], round(r["value"], 2)) for r in df.collect())
    for label, got, want in (("integral", queries.t5_stream_integral, windows.integral(f)), ("fill", queries.t5_stream_forward_fill, windows.forward_fill(f, 50.0, 25.0))):
        assert key(got(spark, sf_dir)) == key(want.samples)
        assert len([c for c in os.listdir(f"{tmp_path}/{label}.state/commits") if c.isdigit()]) >= math.ceil(f.samples.count() / 150)
        assert max(r["count"] for r in spark.read.parquet(f"{tmp_path}/{label}.in").groupBy(F.input_file_name()).count().collect()) <= 150


def test_recording(spark, tmp_path):
    rows = [("a", 0, 0, 7, 8, 1.0), ("a", 1, 5, 9, 8, 2.0), ("a", 2, 6, 9, 3, 9.0), ("b", 0, 1, 1, 8, None)]
    stream = batches(spark, tmp_path, rows, [2], ingest.NOTIFICATION_SCHEMA)
    q = ingest.record(stream, f"{tmp_path}/rec/samples", f"{tmp_path}/cp", "0 seconds")
    q.processAllAvailable()
    q.stop()
    got = sorted((r["channel"], r["seq"], r["ts_ns"]) for r in spark.read.parquet(f"{tmp_path}/rec/samples").collect())
    assert got == [("a", 0, 7), ("a", 1, 5), ("b", 0, 1)]
    totals = run(ingest.running_totals(stream), spark, "totals", "complete")
    assert sorted(tuple(r) for r in totals.collect()) == [("a", 2, 1), ("b", 1, 0)]
    fan = ingest.fan_out(spark.createDataFrame([("a", 3, 1000, 2, [1.0, 2.0])], "channel string, seq long, ts_ns long, cycle_us int, values array<double>"))
    assert [tuple(r) for r in fan.collect()] == [("a", 6, 1000, 1.0), ("a", 7, 2000, 2.0)]
    live = ingest.live_window(frame(spark, a=[(0, 50), (9, 1), (10, 3)]).samples, 2.0).first()
    assert (live["low"], live["high"], live["n"]) == (0.9, 3.1, 2)
