"""Streams: the reorder buffer, typed payloads, two tables, overrun events, the live window."""

import math
import random
import struct
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from tests.test_sources_streaming import batches, run
from tidemark.functions import payloads
from tidemark.operators import filters, windows
from tidemark.plans import ORACLES, QUERIES, queries
from tidemark.streaming import ingest, stateful

SAMPLES = "channel string, seq long, ts_ns long, value double, ends boolean"
S = 10**9


def key(df, digits=6):
    return sorted((r["channel"], r["seq"], round(r["value"], digits)) for r in df.collect())


def arriving(rng, rows, delay):
    """Rows in an order of arrival: none comes when a row newer by more than ``delay`` has come; a channel's last row comes last."""
    last = {c: max((r[2], r[1]) for r in rows if r[0] == c) for c in {r[0] for r in rows}}
    marked = [(*r, (r[2], r[1]) == last[r[0]]) for r in rows]
    return sorted(marked, key=lambda r: r[2] + (delay if r[4] else rng.randrange(delay)))


@pytest.mark.parametrize("seed", [0])
def test_any_order_within_the_delay_and_any_batches_give_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    f = frame(spark, a=[(i * 0.5 + rng.random() * 0.1, rng.choice([0.0, i])) for i in range(60)], b=[(i, math.sin(i)) for i in range(25)], c=[(7, 3)])
    rows = arriving(rng, [tuple(r) for r in f.samples.select("channel", "seq", "ts_ns", "value").collect()], 5 * S)
    stream = batches(spark, tmp_path, rows, sorted(rng.sample(range(1, len(rows)), 4)), SAMPLES)
    for name, got, want in (
        ("low", stateful.lag_stages(stream, 0.8, delay_s=5.0), filters.low_pass(f, 0.8)),
        ("high", stateful.lag_stages(stream, 0.8, 2, True, 5.0), filters.pt(f, 1, 2, 0.8)),
        ("fill", stateful.forward_fill(stream, delay_s=5.0), windows.forward_fill(f)),
        ("area", stateful.integral(stream, 5.0), windows.integral(f)),
    ):
        made = run(got, spark, f"ordered_{name}_{seed}")
        assert key(made.filter("not late")) == key(want.samples) and made.filter("late").isEmpty()


def test_late_rows_go_beside_and_silent_channels_are_released(spark, tmp_path):
    rows = [("a", 0, 1 * S, 1.0), ("b", 0, 2 * S, 5.0), ("a", 1, 20 * S, 2.0), ("a", 2, 3 * S, 9.0), ("a", 3, 15 * S, 3.0), ("a", 4, 60 * S, 4.0), ("b", 1, 1 * S, 6.0), ("b", 2, 70 * S, 7.0)]
    stream = batches(spark, tmp_path, rows, [3, 5, 6], "channel string, seq long, ts_ns long, value double")
    got = {(r["channel"], r["seq"]): (r["value"], r["late"]) for r in run(stateful.integral(stream, 10.0), spark, "beside").collect()}
    # a at 3 s comes when a at 20 s has released what is older than 10 s; b at 1 s when a at 60 s has moved the watermark.
    assert got == {("a", 0): (0.0, False), ("a", 2): (9.0, True), ("a", 3): (28.0, False), ("a", 1): (40.5, False), ("b", 0): (0.0, False), ("b", 1): (6.0, True)}
    with pytest.raises(ValueError):
        stateful.integral(stream, -1.0)


def test_a_timer_releases_what_the_watermark_has_passed(spark, tmp_path):
    rows = [("b", 0, 2 * S, 5.0), ("b", 1, 4 * S, 5.0), ("a", 0, 1 * S, 1.0), ("a", 1, 60 * S, 4.0)]
    stream = batches(spark, tmp_path, rows, [2, 3], "channel string, seq long, ts_ns long, value double")
    q = stateful.integral(stream, 10.0, idle_s=0.2).writeStream.format("memory").queryName("timer").start()
    want, until = {("b", 0): 0.0, ("b", 1): 10.0, ("a", 0): 0.0}, time.time() + 60
    got = {}
    while got != want and time.time() < until:
        time.sleep(0.5)
        got = {(r["channel"], r["seq"]): r["value"] for r in spark.table("timer").collect()}
    q.stop()
    assert got == want


def test_a_channel_ends_and_begins_again(spark, tmp_path):
    rows = [("a", 0, 0, 1.0, False), ("a", 1, 2 * S, 1.0, True), ("a", 2, 10 * S, 4.0, False), ("a", 3, 12 * S, 4.0, True), ("a", 4, 11 * S, 0.0, False)]
    stream = batches(spark, tmp_path, rows, [2, 4], SAMPLES)
    got = {r["seq"]: (r["value"], r["late"]) for r in run(stateful.integral(stream, 1.0), spark, "again").collect()}
    assert got == {0: (0.0, False), 1: (2.0, False), 2: (0.0, False), 3: (8.0, False), 4: (0.0, True)}


def test_payloads_of_every_type(spark):
    rng, rows = random.Random(3), []
    codes = {"BOOL": "?", "SINT": "b", "USINT": "B", "INT": "h", "UINT": "H", "DINT": "i", "UDINT": "I", "LINT": "q", "ULINT": "Q", "REAL": "f", "LREAL": "d"}
    for kind, code in codes.items():
        size = struct.calcsize(code)
        assert payloads.TYPES[kind][0] == size
        for raw in [rng.randbytes(size) for _ in range(200)] + [bytes(size), b"\xff" * size, bytes(size - 1) + b"\x80", b"\x01" + bytes(size - 1)]:
            rows.append((len(rows), kind, bytearray(raw), struct.unpack("<" + code, raw)[0]))
    special = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, -1 / 3]
    rows += [(len(rows) + i, "LREAL", bytearray(struct.pack("<d", x)), x) for i, x in enumerate(special)]
    rows += [(len(rows) + i, "REAL", bytearray(struct.pack("<f", x)), struct.unpack("<f", struct.pack("<f", x))[0]) for i, x in enumerate([1e-45, 1.1754944e-38, 3.4028235e38, 0.1])]
    df = spark.createDataFrame([r[:3] for r in rows], "i int, kind string, payload binary").repartition(3)
    got = {r["i"]: r for r in df.select("i", payloads.decoded(F.col("payload"), F.col("kind")).alias("v"), payloads.exact(F.col("payload"), F.col("kind")).alias("e")).collect()}
    for i, kind, _, want in rows:
        v, e = got[i]["v"], got[i]["e"]
        assert (math.isnan(v) and math.isnan(want)) or v == float(want), (kind, v, want)
        assert e is None if kind in ("REAL", "LREAL") else int(e) == int(want)


def test_typed_notifications(spark, tmp_path):
    schema = "channel string, seq long, plc_ts_ns long, host_ts_ns long, payload binary"
    rows = [("f", 0, 0, 7, bytearray(struct.pack("<f", 1.5))), ("f", 1, 5, 9, bytearray(8)), ("i", 0, 6, 9, bytearray(struct.pack("<h", -2))), ("nobody", 0, 1, 1, bytearray(2)), ("i", 1, 8, 9, None)]
    stream = batches(spark, tmp_path, rows, [2], schema)
    channels = spark.createDataFrame([("f", "REAL"), ("i", "INT"), ("x", "ODD")], "channel string, data_type string")
    got = {(r["channel"], r["seq"]): (r["ts_ns"], r["value"] if r["valid"] else None, r["payload_len"], r["valid"]) for r in run(ingest.typed(stream, channels), spark, "typed").collect()}
    assert got == {("f", 0): (7, 1.5, 4, True), ("f", 1): (5, None, 8, False), ("i", 0): (6, -2.0, 2, True), ("nobody", 0): (1, None, 2, False), ("i", 1): (8, None, None, False)}


def test_a_failed_batch_repeats_nothing_in_either_table(spark, tmp_path):
    rows = [("a", i, 1, 2, 8 if i % 3 else 4, float(i)) for i in range(12)]
    stream = ingest.stamped(batches(spark, tmp_path, rows, [4, 8], ingest.NOTIFICATION_SCHEMA)).select("channel", "seq", "ts_ns", "value", "valid")
    path, cp = f"{tmp_path}/t", f"{tmp_path}/cp"
    failing = stream.withColumn("value", F.when(F.col("seq") == 9, F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        ingest.in_two_tables(failing, ~F.col("valid"), path, cp).awaitTermination()
    # A try that got half way: its folder is there, its batch isn't committed.
    spark.createDataFrame([("a", 99, 1, 1.0, True, False)], "channel string, seq long, ts_ns long, value double, valid boolean, side boolean").write.mode("overwrite").partitionBy("side").parquet(f"{path}/batch=2")
    for _ in range(2):
        ingest.in_two_tables(stream, ~F.col("valid"), path, cp).awaitTermination()
    columns = "channel string, seq long, ts_ns long, value double, valid boolean"
    main, side = (sorted(r["seq"] for r in ingest.table_of(spark, path, columns, s).collect()) for s in (False, True))
    assert main == [i for i in range(12) if i % 3] and side == [0, 3, 6, 9]


def test_one_event_a_rise_whatever_the_batches(spark, tmp_path):
    rows = [("a", 1 * S, True, False), ("a", 2 * S, False, False), ("a", 3 * S, False, False), ("a", 11 * S, True, False), ("b", 12 * S, True, False), ("a", 25 * S, False, False), ("a", 24 * S, True, False), ("a", 38 * S, True, True), ("b", 40 * S, False, True)]
    want = [("a", 0, 2, 2), ("a", 20 * S, 3, 1), ("b", 40 * S, 1, 1)]
    for i, cuts in enumerate(([], [1, 2, 3, 5, 6, 7], [4])):
        stream = batches(spark, tmp_path / str(i), rows, cuts, "channel string, ts_ns long, valid boolean, ends boolean")
        assert sorted(tuple(r) for r in run(stateful.overrun_events(stream, 10.0), spark, f"rises{i}").collect()) == want
    # Restarted from its checkpoint it goes on where it was.
    stream, told = batches(spark, tmp_path / "again", rows, [2, 5], "channel string, ts_ns long, valid boolean, ends boolean"), []
    for _ in range(2):
        q = stateful.overrun_events(stream, 10.0).writeStream.foreachBatch(lambda b, n: told.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(told) == want


def test_the_live_window_after_every_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i, int((i * 0.4 + rng.random() * 3) * S), rng.choice([math.nan, float(i % 17), -float(i)])) for i in range(120)]
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "channel string, group string")
    cuts = [30, 31, 80]
    stream = batches(spark, tmp_path, rows, cuts, "channel string, seq long, ts_ns long, value double")
    ingest.live_ranges(stream, 10.0, 2.0, f"{tmp_path}/live", f"{tmp_path}/cp", groups).awaitTermination()
    for n, end in enumerate([*cuts, len(rows)]):
        so_far = spark.createDataFrame(rows[:end], "channel string, seq long, ts_ns long, value double")
        want = sorted(tuple(r) for r in ingest.live_cells(so_far, 10.0, 2.0, groups).collect())
        assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/live/ranges/{n}").collect()) == want
        newest = max(r[2] for r in rows[:end])
        inside = [r for r in rows[:end] if r[2] // (2 * S) >= (newest - 10 * S) // (2 * S) and not math.isnan(r[3])]
        assert {w[0]: w[3] for w in want} == {g: k for g in "xy" if (k := sum((r[0] == "c") == (g == "y") for r in inside))}
    cells = spark.read.parquet(f"{tmp_path}/live/cells/3")
    assert cells.count() <= 2 * 6 and cells.agg(F.min("cell")).first()[0] * 2 * S > newest - 14 * S


@pytest.mark.parametrize("name", ["t1_stream_samples", "t1_stream_side"])
def test_many_users_arrive_in_few_batches(spark, tmp_path, monkeypatch, name):
    db = duckdb.connect()
    kind = "['click', 'view', 'error'][i % 3 + 1]"
    db.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * 7919 % 600 * INTERVAL 1 HOUR AS ts, i * 37 % 1500 AS user_id, {kind} AS event_type, i / 4.0 AS value FROM range(600) t(i)) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    monkeypatch.setattr(queries, "new_folder", lambda spark, label: f"{tmp_path}/{label}")
    got = QUERIES[name](spark, str(tmp_path))
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
    # Fifty numbers of users; a batch more where the last number of a file has rows beyond its share.
    assert 1 < len(list(Path(f"{tmp_path}/recorded").glob("batch=*"))) <= ingest.OWN_FILES + 1
