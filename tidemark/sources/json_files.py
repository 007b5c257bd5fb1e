"""JSON files: records, columns, and one object a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import CHANNEL_SCHEMA, FREQUENCY, SignalFrame
from tidemark.sources import json_pieces

# Names an axis column goes by.
AXIS_NAMES = ("t", "time", "timestamp", "x", "sec", "seconds", "s")
_SIGNAL = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "unit", "domain", "src")] + [T.StructField("sampleRateHz", T.DoubleType()), T.StructField("firstRow", T.LongType()), T.StructField("t", T.ArrayType(T.StringType())), T.StructField("v", T.ArrayType(T.DoubleType()))])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value")


#: Bytes of a file up to which a document is read by one task; larger ones are read in pieces.
WHOLE_BYTES = 16 << 20


def _is_large(spark: SparkSession, path: str) -> bool:
    return (spark.read.text(path).select("_metadata.file_size").agg(F.max("file_size")).first()[0] or 0) > WHOLE_BYTES


def _members(doc: DataFrame) -> list[tuple[str, str]]:
    """(key, beginning of its value) of a document's members in order, found in one pass."""
    named = doc.select("value", F.posexplode(F.json_object_keys("value")).alias("pos", "key"))
    member = F.call_function("get_json_object", "value", F.concat(F.lit("$['"), "key", F.lit("']")))
    starts = named.groupBy("key").agg(F.min("pos").alias("pos"), F.max(F.regexp_extract(member, r"^\s*(\[\s*\{|\[|)", 1)).alias("start"))
    return [(r["key"], r["start"]) for r in starts.orderBy("pos", "key").collect()]  # a row a key


def read_json_records(spark: SparkSession, path: str, json_lines: bool = False, in_pieces: bool | None = None) -> DataFrame:
    """Rows of an array of objects, of one nested a level down, or of JSON lines; columns in first-seen order.

    Only scalars count; other values become null. JSON lines are read in
    splits, a document of up to ``WHOLE_BYTES`` by one task, a larger one, or
    any with ``in_pieces``, in pieces by many.
    """
    if json_lines:
        df = spark.read.json(path)
        return df.select(*[_scalar(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    if _is_large(spark, path) if in_pieces is None else in_pieces:
        return _records_in_pieces(json_pieces.elements(spark, path))
    doc = _whole(spark, path)
    text = F.trim("value")
    if doc.filter(text.startswith("[")).isEmpty():
        nested = next((k for k, start in _members(doc) if start.endswith("{")), None)
        if nested is None:
            raise ValueError("no array of records")
        doc = doc.select(F.get_json_object("value", f"$['{nested}']").alias("value"))
    return _records(doc.select(F.posexplode(F.from_json("value", "array<string>")).alias("row_idx", "record")))


def _records_in_pieces(found: DataFrame) -> DataFrame:
    keyed = json_pieces.members(found)
    of_array = found.filter("key is null")
    if keyed and of_array.isEmpty():
        nested = next((k for k, objects in keyed if objects), None)
        if nested is None:
            raise ValueError("no array of records")
        of_array = found.filter(F.col("key") == nested)
    elif of_array.isEmpty():
        raise ValueError("no array of records")
    return _records(of_array.filter("text <> ''").select("row_idx", F.col("text").alias("record")))


def _records(rows: DataFrame) -> DataFrame:
    """(row_idx, record) as columns of the records' scalars."""
    keyed = rows.select("row_idx", "record", F.posexplode(F.json_object_keys("record")).alias("pos", "key"))
    order = keyed.groupBy("key").agg(F.min(F.struct("row_idx", "pos")).alias("first")).orderBy("first")
    names = [r["key"] for r in order.collect()]  # become columns
    cells = [_cell(F.get_json_object("record", f"$['{n}']")).alias(n) for n in names]
    return rows.select(F.col("row_idx").cast("long"), *cells)


def _cell(text: Column) -> Column:
    return F.when(~F.trim(text).rlike(r"^[\[{]"), text)


def _scalar(c: Column, kind: T.DataType) -> Column:
    return F.lit(None).cast("string") if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")


def read_json_columnar(spark: SparkSession, path: str, in_pieces: bool | None = None) -> DataFrame:
    """Rows of an object of arrays, an array of arrays (col1, ...) or an array of scalars (value); short columns end in null."""
    if _is_large(spark, path) if in_pieces is None else in_pieces:
        return _columns_in_pieces(json_pieces.elements(spark, path))
    doc = _whole(spark, path)
    if doc.filter(F.trim("value").startswith("{")).isEmpty():
        if doc.filter(F.trim("value").rlike(r"^\[\s*\[")).isEmpty():
            rows = doc.select(F.posexplode(F.from_json("value", "array<string>")).alias("row_idx", "value"))
            return rows.select(F.col("row_idx").cast("long"), "value")
        rows = doc.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("row_idx", "cells"))
        width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
        return rows.select(F.col("row_idx").cast("long"), *[F.get("cells", i).alias(f"col{i + 1}") for i in range(width)])
    columns = [k for k, start in _members(doc) if start]
    arrays = F.arrays_zip(*[F.coalesce(F.from_json(F.get_json_object("value", f"$['{k}']"), "array<string>"), F.array().cast("array<string>")).alias(k) for k in columns])
    rows = doc.select(F.posexplode(arrays).alias("row_idx", "r"))
    return rows.select(F.col("row_idx").cast("long"), *[F.col(f"r.`{k}`").alias(k) for k in columns])


def _columns_in_pieces(found: DataFrame) -> DataFrame:
    columns = [k for k, _ in json_pieces.members(found)]
    some = found.filter("text <> ''")
    if columns:
        # A row a document and place; its columns meet there, each element a cell.
        rows = some.groupBy("file", "row_idx").agg(*[F.max(F.when(F.col("key") == k, json_pieces.scalar(F.col("text")))).alias(k) for k in columns])
        return rows.select("row_idx", *[F.col(f"`{k}`") for k in columns])
    if some.filter(F.col("text").startswith("[")).isEmpty():
        return some.select("row_idx", json_pieces.scalar(F.col("text")).alias("value"))
    rows = some.select("row_idx", F.from_json("text", "array<string>").alias("cells"))
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    return rows.select("row_idx", *[F.get("cells", i).alias(f"col{i + 1}") for i in range(width)])


def read_signal_json(spark: SparkSession, path: str) -> SignalFrame:
    """A document with signals, or signal objects a line (splittable); axis integers are exact, null values NaN.

    Several lines may hold a signal, each from its firstRow on. A first line
    that is an object without signals tells lines from a document.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").select((~F.array_contains(F.json_object_keys("value"), "signals")).alias("lines")).first()
    named = None if first is None or first["lines"] else _whole(spark, path).select(F.get_json_object("value", "$.signals").alias("value")).filter("value is not null")
    if named is None or named.isEmpty():
        one = spark.read.schema(_SIGNAL).json(path)
    else:
        one = named.select(F.explode(F.from_json("value", T.ArrayType(_SIGNAL))).alias("s")).select("s.*")
    one = one.filter("name is not null and name <> ''").withColumn("src", F.coalesce("src", F.lit(path.rsplit("/", 1)[-1])))
    n = F.least(F.size("t"), F.size("v"))
    before = F.coalesce("firstRow", F.lit(0))
    pairs = one.filter(n > 0).select(F.col("name").alias("channel"), before.alias("before"), F.posexplode(F.slice(F.arrays_zip("t", "v"), F.lit(1), n)).alias("seq", "p"))
    t = F.coalesce(F.col("p.t").try_cast("long"), F.col("p.t").try_cast("double").cast("long"), F.lit(0))
    samples = pairs.select("channel", (F.col("before") + F.col("seq")).alias("seq"), t.alias("ts_ns"), F.coalesce("p.v", F.lit(float("nan"))).alias("value"))
    channels = one.filter((n > 0) & (before == 0)).select(
        F.col("name").alias("channel"), F.coalesce("unit", F.lit("")).alias("unit"), F.lit("LREAL").alias("data_type"), F.lit("imported").alias("mode"), F.coalesce("sampleRateHz", F.lit(0.0)).alias("sample_rate_hz"),
        F.lit(0).cast("long").alias("parent_task_cycle_us"), F.col("src").alias("source_symbol"), F.when(F.col("domain") == FREQUENCY, FREQUENCY).otherwise("time").alias("domain"), F.lit(None).cast("long").alias("source_start_ns"),
    )
    return SignalFrame(samples, channels)


def read_json_guess(spark: SparkSession, path: str) -> SignalFrame:
    """Any table of numbers: the axis is the first column named like one, else the first, in seconds."""
    try:
        table = read_json_records(spark, path)
    except ValueError:
        table = read_json_columnar(spark, path)
    names = [c for c in table.columns if c != "row_idx"]
    if len(names) < 2:
        raise ValueError("a table needs two columns")
    axis = next((c for c in names if c.strip().lower() in AXIS_NAMES), names[0])
    value = lambda c: F.when(F.col(f"`{c}`") == "true", 1.0).when(F.col(f"`{c}`") == "false", 0.0).otherwise(F.col(f"`{c}`").try_cast("double"))
    rows = table.withColumn("__x", value(axis)).filter("__x is not null")
    of = [F.struct(F.lit(c).alias("channel"), F.coalesce(value(c), F.lit(float("nan"))).alias("value")) for c in names if c != axis]
    out = rows.select(F.col("row_idx").alias("seq"), (F.col("__x") * 1e9).cast("long").alias("ts_ns"), F.explode(F.array(*of)).alias("s")).select("s.channel", "seq", "ts_ns", "s.value")
    meta = [(c, "", "LREAL", "imported", 0.0, 0, path.rsplit("/", 1)[-1], "time", None) for c in names if c != axis]
    return SignalFrame(out, spark.createDataFrame(meta, CHANNEL_SCHEMA))
