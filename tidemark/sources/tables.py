"""Signals from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import SignalFrame


def nanoseconds(ts: str) -> Column:
    """A timestamp column, read as UTC, in nanoseconds."""
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000


def signals(df: DataFrame, channel: str, ts: str, value: str, seq: str | Column, unit: str = "") -> SignalFrame:
    order = F.col(seq) if isinstance(seq, str) else seq
    return SignalFrame.of(df.select(F.col(channel).cast("string").alias("channel"), order.cast("long").alias("seq"), nanoseconds(ts).alias("ts_ns"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value")), unit)


def events(spark: SparkSession, sf_dir: str, channel: str = "event_type") -> SignalFrame:
    return signals(spark.read.parquet(f"{sf_dir}/events.parquet"), channel, "ts", "value", "event_id")


def orders(spark: SparkSession, sf_dir: str) -> SignalFrame:
    return signals(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
