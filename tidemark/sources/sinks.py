"""Writing signals: wide and paired CSV, JSON lines of a signal's stretches, Parquet sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import FREQUENCY, TIME, SignalFrame
from tidemark.operators.align import interpolated
from tidemark.operators.kernels import ordinals, sliced
from tidemark.operators.segments import split_domains

#: Samples a JSON line holds at most.
ROWS_PER_LINE = 10_000


def format_number(v: Column, digits: int | None = None, decimal: str = ".") -> Column:
    """15 significant digits, or a fixed number of decimals; NaN is blank."""
    if digits is None:
        parts = r"^(-?\d\.\d+)e([+-]\d+)$"
        exact = F.format_string("%.14e", v)
        m, e = F.regexp_extract(exact, parts, 1), F.regexp_extract(exact, parts, 2).try_cast("int")
        short = F.regexp_replace(F.regexp_replace(m, r"0+$", ""), r"\.$", "")
        power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        plain = F.when(e.between(-5, 14), _plain(m, e)).otherwise(F.concat(short, power))
        out = F.when(v == 0, "0").otherwise(plain)
    else:
        out = F.format_string(f"%.{digits}f", v)
    out = F.when(F.isnan(v) | v.isNull(), "").otherwise(out)
    return F.replace(out, F.lit("."), F.lit(decimal)) if decimal != "." else out


def _plain(mantissa: Column, exponent: Column) -> Column:
    """The digits of ``d.ddde+x`` with the point moved."""
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(mantissa, r"[-.]", "")
    up = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(20)))
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return F.concat(sign, F.regexp_replace(F.regexp_replace(F.when(exponent >= 0, up).otherwise(down), r"0+$", ""), r"\.$", ""))


def wide_table(f: SignalFrame, names: list[str]) -> DataFrame:
    """ts_ns and a column a channel: every distinct instant, values linear in between, NaN outside a channel's span."""
    instants = f.samples.select("ts_ns").distinct()
    grid = instants.select(F.explode(F.array(*map(F.lit, names))).alias("channel"), F.lit(0).cast("long").alias("seq"), "ts_ns")
    at = interpolated(grid, f.samples, gaps=True)
    return at.groupBy("ts_ns").pivot("channel", names).agg(F.first("other"))


def paired_table(f: SignalFrame, names: list[str]) -> DataFrame:
    """row and an x and a v column a channel, by the samples' ordinals."""
    rows = ordinals(sliced(f.samples, longest=f.longest), "row").df
    return rows.groupBy("row").pivot("channel", names).agg(F.first("ts_ns").alias("x"), F.first("value").alias("v"))


def _named(f: SignalFrame) -> list[dict]:
    """Meta data of the channels a file gets as columns, in order of name."""
    return [r.asDict() for r in f.channels.select("channel", "unit", "domain", "source_symbol").orderBy("channel").collect()]


def _title(c: dict) -> str:
    return f"{c['channel']} [{c['unit']}]" if c["unit"] else c["channel"]


def write_lines(lines: DataFrame, path: str, head: list[str]) -> None:
    """Text part files of the one column of ``lines``, in its order, each beginning with the lines of ``head``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": head})
        yield from batches

    lines.toDF("value").mapInPandas(run, "value string").write.text(path)


def write_wide_csv(f: SignalFrame, path: str, sep: str = ",", decimal: str = ".", digits: int | None = None, absolute_ns: bool = False, paired: bool = False, metadata: bool = True, noted: bool = False) -> None:
    """CSV part files with titles, in axis order, and their description beside them in ``path``.meta.

    ``noted`` puts the description into the files instead, as their first
    line; names and units must then be free of the separator.
    Shared: time channels by instants, then frequency channels by bins, joined
    by row. Paired: an (x, value) pair of columns a channel.
    """
    channels = _named(f)
    if not channels:
        raise ValueError("no channels to write")
    unit = "ns" if absolute_ns else "s"
    spark, columns, notes, table = f.samples.sparkSession, [], [], None
    time, freq = split_domains(f)
    origin = time.samples.agg(F.coalesce(F.min("ts_ns"), F.lit(0))).first()[0]

    def x_text(c: Column, domain: str) -> Column:
        if domain == TIME:
            return F.coalesce(c.cast("string"), F.lit("")) if absolute_ns else format_number((c - origin) / 1e9, digits, decimal)
        return format_number(c / 1e9, digits, decimal)

    def note_axis(domain: str) -> int:
        notes.append({"role": "x_frequency" if domain == FREQUENCY else "x_time", "unit": "Hz" if domain == FREQUENCY else unit})
        return len(notes) - 1

    def note_signal(c: dict, x: int) -> None:
        notes.append({"role": "signal", "unit": c["unit"], "name": c["channel"], "src": c["source_symbol"], "refX": x})

    if paired:
        table = paired_table(f, [c["channel"] for c in channels])
        for c in channels:
            x = note_axis(c["domain"])
            note_signal(c, x)
            title = f"{'f' if c['domain'] == FREQUENCY else 't'}_{c['channel']} [{notes[x]['unit']}]"
            columns += [F.coalesce(x_text(F.col(f"`{c['channel']}_x`"), c["domain"]), F.lit("")).alias(title), format_number(F.col(f"`{c['channel']}_v`"), digits, decimal).alias(_title(c))]
    else:
        for domain, part in ((TIME, time), (FREQUENCY, freq)):
            own = [c for c in channels if c["domain"] == domain]
            if not own:
                continue
            axis = f"__x_{domain}"
            wide = wide_table(part, [c["channel"] for c in own]).withColumnRenamed("ts_ns", axis)
            # Rows are numbered as one channel whose axis is the grid.
            numbered = ordinals(sliced(wide.withColumn("channel", F.lit("")).withColumn("seq", F.lit(0).cast("long")).withColumn("ts_ns", F.col(axis))), "row").df.drop("channel", "seq", "ts_ns", "slice")
            table = numbered if table is None else table.join(numbered, "row", "full")
            x = note_axis(domain)
            columns.append(F.coalesce(x_text(F.col(axis), domain), F.lit("")).alias("f [Hz]" if domain == FREQUENCY else f"t [{unit}]"))
            for c in own:
                note_signal(c, x)
                columns.append(format_number(F.col(f"`{c['channel']}`"), digits, decimal).alias(_title(c)))
    ordered = table.orderBy("row").select(*columns)
    if noted:
        if any(sep in title for title in ordered.columns):
            raise ValueError("a title holds the separator")
        line = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ordered.columns])
        write_lines(ordered.select(line), path, ["# signal-csv: " + json.dumps({"v": 1, "columns": notes}), sep.join(ordered.columns)])
        return
    ordered.write.option("header", True).option("sep", sep).option("emptyValue", "").csv(path)
    if metadata:
        spark.createDataFrame([(json.dumps({"v": 1, "columns": notes}),)], "value string").coalesce(1).write.text(path + ".meta")


def write_signal_json(f: SignalFrame, path: str) -> None:
    """JSON objects a line: a stretch of a signal's samples each, firstRow before it; exact axis integers, NaN as null."""
    point = F.struct("ts_ns", "seq", F.when(~F.isnan("value"), F.col("value")).alias("value"))
    rows = ordinals(sliced(f.samples, longest=f.longest), "row").df.withColumn("line", F.expr(f"row div {ROWS_PER_LINE}"))
    packed = rows.groupBy("channel", "line").agg(F.sort_array(F.collect_list(point)).alias("p"))
    # Meta data once a line, so that the join spreads a long channel like its lines.
    last = f.samples.groupBy("channel").agg(F.expr(f"(count(*) - 1) div {ROWS_PER_LINE}").alias("last"))
    meta = f.channels.join(last, "channel").withColumn("line", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    out = packed.join(meta, ["channel", "line"]).select(
        F.col("channel").alias("name"), "unit", "domain", F.col("source_symbol").alias("src"), F.col("sample_rate_hz").alias("sampleRateHz"), (F.col("line") * ROWS_PER_LINE).alias("firstRow"),
        F.transform("p", lambda p: p["ts_ns"]).alias("t"), F.transform("p", lambda p: p["value"]).alias("v"),
    )
    out.write.option("ignoreNullFields", False).json(path)


# The physical column of a session that values of a type lie in.
_PHYSICAL = {"BOOL": "whole", "SINT": "whole", "USINT": "whole", "INT": "whole", "UINT": "whole", "DINT": "whole", "UDINT": "whole", "LINT": "whole", "ULINT": "large", "REAL": "real"}
_SESSION = "seq long, ts_ns long, whole long, large decimal(20,0), real float, number double, data_type string, channel string"


def append_typed(samples: DataFrame, path: str) -> None:
    """Appends (channel, seq, ts_ns, data_type, exact, value) to a session, each value in its type's physical column.

    ``exact`` (decimal) holds whole numbers that a double can't, and may be
    null; ``value`` is the same as a double. A value that its type's column
    can't hold as it is lies in the doubles' column. Files are partitioned by
    type and channel.
    """
    exact = F.coalesce("exact", F.when((F.abs(F.col("value")) < 2.0**53) & (F.floor("value") == F.col("value")), F.col("value").cast("decimal(20,0)")))
    kind = lambda name: F.col("data_type").isin(*[k for k, v in _PHYSICAL.items() if v == name])
    rows = samples.withColumn("exact", exact)
    rows = rows.withColumn("whole", F.when(kind("whole"), F.col("exact").try_cast("long"))).withColumn("large", F.when(kind("large"), F.col("exact")))
    rows = rows.withColumn("real", F.when(kind("real") & (F.isnan("value") | (F.col("value").cast("float").cast("double") == F.col("value"))), F.col("value").cast("float")))
    number = F.when(F.coalesce(F.col("whole").cast("double"), F.col("large").cast("double"), F.col("real").cast("double")).isNull(), F.col("value"))
    rows.select("seq", "ts_ns", "whole", "large", "real", number.alias("number"), "data_type", "channel").write.mode("append").partitionBy("data_type", "channel").parquet(f"{path}/samples")


def typed_samples(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """(channel, seq, ts_ns, data_type, exact, value) of a session or the named channels of it: others' files aren't read."""
    rows = spark.read.option("basePath", f"{path}/samples").schema(_SESSION).parquet(f"{path}/samples")
    rows = rows.filter(F.col("channel").isin(*names)) if names else rows
    exact = F.coalesce(F.col("large"), F.col("whole").cast("decimal(20,0)"))
    value = F.coalesce(F.col("number"), F.col("real").cast("double"), exact.cast("double"), F.lit(float("nan")))
    return rows.select("channel", "seq", "ts_ns", "data_type", exact.alias("exact"), value.alias("value"))


def save_session(f: SignalFrame, path: str) -> None:
    """Samples by type and channel, and the channels' meta data, as Parquet."""
    kinds = f.channels.select("channel", F.col("data_type"))
    append_typed(f.samples.join(kinds, "channel", "left").withColumn("data_type", F.coalesce("data_type", F.lit("LREAL"))).withColumn("exact", F.lit(None).cast("decimal(20,0)")), path)
    f.channels.write.parquet(f"{path}/channels")


def load_session(spark: SparkSession, path: str, *names: str) -> SignalFrame:
    """A session, or only the named channels of it: others' files aren't read."""
    f = SignalFrame(typed_samples(spark, path, *names).select("channel", "seq", "ts_ns", "value"), spark.read.parquet(f"{path}/channels"))
    return f.only(*names) if names else f


def save_split(f: SignalFrame, path: str, write) -> list[str]:
    """Time and frequency channels to ``path``_time and ``path``_frequency; what has no channel isn't written."""
    out = []
    for name, part in zip((TIME, FREQUENCY), split_domains(f), strict=True):
        if not part.channels.isEmpty():
            write(part, f"{path}_{name}")
            out.append(f"{path}_{name}")
    return out


def open_signals(spark: SparkSession, path: str) -> SignalFrame:
    """Signals by the path's ending: .csv and .txt, .json, else a session."""
    from tidemark.sources import json_files, text

    low = path.lower()
    if low.endswith((".csv", ".txt")):
        return text.read_paired_export(spark, path) if text.paired_layout(text.head(spark, path)) else text.read_signal_csv(spark, path)
    if low.endswith(".json"):
        f = json_files.read_signal_json(spark, path)
        return f if not f.channels.isEmpty() else json_files.read_json_guess(spark, path)
    return load_session(spark, path)


def save_signals(f: SignalFrame, path: str) -> None:
    """The counterpart of ``open_signals``."""
    low = path.lower()
    if low.endswith((".csv", ".txt")):
        write_wide_csv(f, path)
    elif low.endswith(".json"):
        write_signal_json(f, path)
    else:
        save_session(f, path)
