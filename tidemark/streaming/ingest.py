"""Streaming: notifications to samples, running totals, the live window, oversampled ticks."""

from __future__ import annotations

import math
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.elementwise import nan
from tidemark.functions.payloads import decoded, size_of

PAYLOAD_BYTES = 8
#: Samples of a file, and so of a micro-batch, of ``in_time_order``.
ROWS_PER_FILE = 500_000
#: Numbers of ``in_time_order`` up to which each has a file of its own, though they may share.
OWN_FILES = 8
NOTIFICATION_SCHEMA = "channel string, seq long, plc_ts_ns long, host_ts_ns long, payload_len int, value double"


def stamped(notifications: DataFrame) -> DataFrame:
    """Adds ts_ns (the device's time, or the host's where that is 0) and whether the payload has the right size."""
    ts = F.coalesce(F.nullif(F.col("plc_ts_ns"), F.lit(0)), F.col("host_ts_ns"))
    return notifications.withColumn("ts_ns", ts).withColumn("valid", F.coalesce(F.col("payload_len") == PAYLOAD_BYTES, F.lit(False)))


def accepted(notifications: DataFrame) -> DataFrame:
    """Samples of the notifications that are whole."""
    return stamped(notifications).filter("valid").select("channel", "seq", "ts_ns", F.coalesce("value", F.lit(float("nan"))).alias("value"))


def typed(notifications: DataFrame, channels: DataFrame) -> DataFrame:
    """Notifications with column ``payload`` (bytes) in place of a value, read by their channels' types.

    Joined with (channel, data_type), static and small beside the stream; adds payload_len, value, and valid: whether the payload has just the
    type's size. A channel that isn't among them has no type, so nothing of
    it is valid.
    """
    kinds = channels.select("channel", "data_type")
    rows = notifications.join(kinds, "channel", "left").withColumn("payload_len", F.octet_length("payload"))
    valid = F.coalesce(F.col("payload_len") == size_of(F.col("data_type")), F.lit(False))
    value = F.when(valid, decoded(F.col("payload"), F.col("data_type"))).otherwise(nan())
    ts = F.coalesce(F.nullif(F.col("plc_ts_ns"), F.lit(0)), F.col("host_ts_ns"))
    return rows.select("channel", "seq", ts.alias("ts_ns"), "data_type", "payload_len", value.alias("value"), valid.alias("valid"))


def _files_in_order(staged: DataFrame) -> list[str]:
    """Part files by the number of their folder and their name."""
    names = [r[0] for r in staged.select(F.input_file_name()).distinct().collect()]  # a row a micro-batch
    return sorted(names, key=lambda n: (int(re.search(r"__batch=(\d+)", n)[1]), n))


def _sharing(samples: DataFrame) -> DataFrame:
    """``samples`` with neighbouring numbers ``__batch`` put together where there are more than ``OWN_FILES``.

    A number stays whole. So many share one that it has ``ROWS_PER_FILE`` rows
    or an ``OWN_FILES``th of all, and what its last number has beyond that.
    """
    counts = samples.groupBy("__batch").agg(F.count(F.lit(1)).alias("n"))
    numbers, rows = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if numbers <= OWN_FILES:
        return samples
    before = F.sum("n").over(Window.orderBy("__batch")) - F.col("n")  # a row a number
    shared = counts.select("__batch", F.floor(before / min(ROWS_PER_FILE, math.ceil(rows / OWN_FILES))).alias("__shared"))
    return samples.join(shared, "__batch", "left").drop("__batch").withColumnRenamed("__shared", "__batch")


def in_time_order(samples: DataFrame, path: str, order: tuple[str, ...] = ("ts_ns", "seq"), batch: Column | None = None, sharing: bool = False) -> DataFrame:
    """``samples`` as a stream of files that were written one after another in time order, one a micro-batch.

    A file has ``ROWS_PER_FILE`` rows at most, or, with ``batch``, the rows of
    one number. With ``sharing``, for results that don't depend on where a
    batch ends, many numbers share a file, so that micro-batches grow in number
    with the rows alone. A file stream takes its files by their modification
    times; where the store's clock doesn't tell two of them apart, they are
    written again with pauses.
    """
    spark, kind = samples.sparkSession, samples.schema
    if batch is None:
        parts = max(1, math.ceil(samples.count() / ROWS_PER_FILE))
        ranged = samples.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__batch", F.spark_partition_id())
    else:
        numbered = samples.withColumn("__batch", batch)
        ranged = (_sharing(numbered) if sharing else numbered).repartition("__batch").sortWithinPartitions("__batch", *order)
    ranged.write.partitionBy("__batch").option("maxRecordsPerFile", 0 if batch is not None else ROWS_PER_FILE).parquet(path + ".staged")
    files = _files_in_order(spark.read.schema(kind).parquet(path + ".staged")) if ranged.take(1) else []
    for pause, to in ((0.0, path), (1.1, path + ".paused")):
        if not files:
            samples.limit(0).write.parquet(to)
        for file in files:
            spark.read.schema(kind).parquet(file).coalesce(1).withColumn("__from", F.lit(file)).write.mode("append").parquet(to)
            time.sleep(pause)
        written = spark.read.parquet(to)
        times = {r[0]: r[1] for r in written.groupBy("__from").agg(F.max("_metadata.file_modification_time")).collect()} if files else {}
        if all(times[a] < times[b] for a, b in zip(files[:-1], files[1:], strict=True)):
            return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(to)
    raise OSError(f"{path}: the file system doesn't keep modification times")


def in_two_tables(stream: DataFrame, side: Column, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes a stream's rows to a main and, where ``side`` is true, a side table; returns the query.

    A micro-batch is written by one job to the folder of its number, which it
    replaces, so a batch that failed and is run again repeats nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("side", F.coalesce(side, F.lit(False))).write.mode("overwrite").partitionBy("side").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def table_of(spark: SparkSession, path: str, columns: str, side: bool) -> DataFrame:
    """The main or the side table that ``in_two_tables`` has written so far; ``columns`` is their schema."""
    rows = spark.read.schema(f"{columns}, batch long, side boolean").option("basePath", path).parquet(path)
    return rows.filter(F.col("side") == side).drop("batch", "side")


def record(notifications: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """Appends accepted samples to a session's Parquet files, partitioned by channel; returns the query."""
    return accepted(notifications).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("channel").trigger(processingTime=every).start()


def running_totals(notifications: DataFrame) -> DataFrame:
    """Per channel: samples received and overruns (payloads of the wrong size)."""
    return stamped(notifications).groupBy("channel").agg(F.sum(F.col("valid").cast("long")).alias("received"), F.sum((~F.col("valid")).cast("long")).alias("overruns"))


def fan_out(ticks: DataFrame) -> DataFrame:
    """One sample an element of each tick's array, spaced by the cycle's even part."""
    step = F.col("cycle_us") * 1000 / F.size("values")
    rows = ticks.select("channel", "seq", "ts_ns", F.size("values").alias("n"), step.alias("step"), F.posexplode("values").alias("i", "value"))
    return rows.select("channel", (F.col("seq") * F.col("n") + F.col("i")).alias("seq"), (F.col("ts_ns") + F.floor(F.col("i") * F.col("step"))).cast("long").alias("ts_ns"), "value")


def live_window(samples: DataFrame, seconds: float, groups: DataFrame | None = None) -> DataFrame:
    """(group, low, high, n): value range of the samples within ``seconds`` of the newest one.

    A batch operator for ``foreachBatch``; ``groups`` is (channel, group).
    """
    newest = samples.agg(F.max("ts_ns").alias("newest"))
    rows = samples.join(F.broadcast(newest), F.col("ts_ns") >= F.col("newest") - int(seconds * 1e9))  # one row
    rows = rows.join(groups, "channel") if groups is not None else rows.withColumn("group", F.lit(""))
    return _range(rows.filter(~F.isnan("value")).groupBy("group").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count(F.lit(1)).alias("n")))


def _range(ends: DataFrame) -> DataFrame:
    """(group, low, high, n) with margins, from the least and greatest value a and b."""
    margin = F.when(F.col("a") == F.col("b"), 0.5).otherwise((F.col("b") - F.col("a")) * 0.05)
    return ends.select("group", (F.col("a") - margin).alias("low"), (F.col("b") + margin).alias("high"), "n")


_CELLS = "group string, cell long, a double, b double, n long, newest long"


def _cells(samples: DataFrame, cell: int, groups: DataFrame | None) -> DataFrame:
    """Partial ranges of (group, cell of time); values that are no number only move the newest time."""
    rows = samples.join(groups, "channel") if groups is not None else samples.withColumn("group", F.lit(""))
    real = ~F.isnan("value")
    least = F.min(F.when(real, F.col("value")))
    return rows.groupBy("group", F.expr(f"(ts_ns - pmod(ts_ns, {cell})) div {cell}").alias("cell")).agg(least.alias("a"), F.max(F.when(real, F.col("value"))).alias("b"), F.count_if(real).alias("n"), F.max("ts_ns").alias("newest"))


def _within(cells: DataFrame, seconds: float, cell: int) -> DataFrame:
    """Cells that reach into the window behind the newest time."""
    newest = cells.agg(F.max("newest").alias("last"))
    start = F.col("last") - int(seconds * 1e9)
    return cells.join(F.broadcast(newest), F.col("cell") >= (start - F.pmod(start, F.lit(cell))) / cell).drop("last")  # one row


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("group").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).filter("n > 0")


def live_cells(samples: DataFrame, seconds: float, cell_s: float, groups: DataFrame | None = None) -> DataFrame:
    """``live_window`` with a window that begins with a whole cell of time: what the stream below tells, in one go."""
    cell = int(cell_s * 1e9)
    return _range(_summed(_within(_cells(samples, cell, groups), seconds, cell)))


def live_ranges(stream: DataFrame, seconds: float, cell_s: float, path: str, checkpoint: str, groups: DataFrame | None = None, every: str | None = None) -> StreamingQuery:
    """Keeps the live window's value range of each group up to date; returns the query.

    State is a small table of partial ranges, one row a group and cell of time
    in the window. A micro-batch is summed by cell first, joins the table of
    the batch before, drops cells the window has left behind, and writes
    ``path``/cells/N and ``path``/ranges/N, replacing what a failed try left.
    """
    cell = int(cell_s * 1e9)

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cells = _cells(batch, cell, groups)
        if number:
            before = spark.read.schema(_CELLS).parquet(f"{path}/cells/{number - 1}")
            cells = before.unionByName(cells.select(*before.columns)).groupBy("group", "cell").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.max("newest").alias("newest"))
        _within(cells, seconds, cell).write.mode("overwrite").parquet(f"{path}/cells/{number}")
        _range(_summed(spark.read.schema(_CELLS).parquet(f"{path}/cells/{number}"))).write.mode("overwrite").parquet(f"{path}/ranges/{number}")

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
