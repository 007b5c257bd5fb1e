import math

from tidemark.frame import SignalFrame


def frame(spark, unit="", domain="time", **channels):
    """A frame of {channel: [(seconds, value), ...]}."""
    rows = [(name, i, round(t * 1e9), float(v)) for name, points in channels.items() for i, (t, v) in enumerate(points)]
    return SignalFrame.of(spark.createDataFrame(rows, "channel string, seq long, ts_ns long, value double"), unit, domain)


def sine(amplitude, hz, rate, n, start=0.0, phase=0.0):
    return [(start + i / rate, amplitude * math.sin(2 * math.pi * hz * i / rate + phase)) for i in range(n)]


def values(f, channel=None):
    rows = f.samples if hasattr(f, "samples") else f
    rows = rows.filter(rows["channel"] == channel) if channel else rows
    return [r["value"] for r in rows.orderBy("channel", "ts_ns", "seq").collect()]


def points(f):
    return [(r["channel"], r["ts_ns"], r["value"]) for r in f.samples.orderBy("channel", "ts_ns", "seq").collect()]
