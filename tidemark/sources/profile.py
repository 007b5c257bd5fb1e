"""Importing a grid by a column mapping.

A profile says which columns are axes and which are channels, their units and
row ranges, and how repeated instants and values are collapsed. It is checked
on the driver; the grid becomes long rows by one explode.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import CHANNEL_SCHEMA, FREQUENCY, TIME, SignalFrame
from tidemark.operators.segments import collapse_instants, collapse_plateaus
from tidemark.sources.text import FREQUENCY_UNITS, TIME_UNITS, axis_value, number

X_TIME, X_FREQUENCY, SIGNAL, IGNORE = "x_time", "x_frequency", "signal", "ignore"


@dataclass(frozen=True)
class ColumnMapping:
    column: str
    role: str = SIGNAL
    name: str = ""
    unit: str = ""
    x_column: str = ""
    sample_rate_hz: float | None = None
    row_start: int | None = None
    row_end: int | None = None
    relative_time: bool = False
    time_offset_s: float = 0.0
    collapse_instants: str = ""
    collapse_plateaus: str = ""


@dataclass(frozen=True)
class ImportProfile:
    columns: tuple[ColumnMapping, ...]
    header_row: int = 0
    decimal: str = "."
    sample_rate_hz: float | None = None


@dataclass
class Imported:
    frame: SignalFrame
    bad_cells: DataFrame
    warnings: list[str] = field(default_factory=list)


def column_index(letters: str) -> int:
    """A is 0, Z is 25, AA is 26."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def rate_hz(value: float, unit: str) -> float:
    """A sample rate given as frequency or as period."""
    factor = {"hz": 1.0, "khz": 1e3, "mhz": 1e6}.get(unit.lower())
    if factor:
        return value * factor
    period = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}[unit.lower()] * value
    return 1.0 / period if period > 0 else 0.0


def unit_warnings(profile: ImportProfile) -> list[str]:
    """Axis columns whose unit is none of its ladder; they are read as seconds or Hz."""
    out = []
    for c in profile.columns:
        ladder = {X_TIME: TIME_UNITS, X_FREQUENCY: FREQUENCY_UNITS}.get(c.role)
        if ladder and c.unit and c.unit.lower() not in ladder:
            out.append(f'column {c.column}: unit "{c.unit}" is not known and read as {"seconds" if c.role == X_TIME else "Hz"}')
    return out


def _axis_of(y: ColumnMapping, profile: ImportProfile) -> ColumnMapping | float:
    """A channel's axis column, or its rate."""
    axes = {c.column: c for c in profile.columns if c.role in (X_TIME, X_FREQUENCY)}
    if y.sample_rate_hz is not None:
        return y.sample_rate_hz
    wanted = y.x_column or next(iter(axes), "")
    if wanted:
        if wanted not in axes:
            raise ValueError(f"the axis column {wanted} is not in the profile")
        if not y.x_column and len({c.role for c in axes.values()}) > 1:
            raise ValueError(f"channel {y.name or y.column} must name its axis, as the profile mixes time and frequency")
        return axes[wanted]
    if profile.sample_rate_hz is None:
        raise ValueError("there is neither an axis column nor a sample rate")
    return profile.sample_rate_hz


def unit_report(grid: DataFrame, profile: ImportProfile) -> DataFrame:
    """column, unit, read_as, cells: the axis columns of ``unit_warnings`` and how many of their cells that concerns."""
    warned = [c for c in profile.columns if unit_warnings(ImportProfile((c,)))]
    of = [F.when(F.trim(F.get("cells", column_index(c.column))) != "", F.struct(F.lit(c.column).alias("column"), F.lit(c.unit).alias("unit"), F.lit("seconds" if c.role == X_TIME else "Hz").alias("read_as"))) for c in warned]
    empty = F.array().cast("array<struct<column:string,unit:string,read_as:string>>")
    rows = grid.filter(F.col("row_idx") >= max(0, profile.header_row)).select(F.explode(F.array_compact(F.array(*of)) if of else empty).alias("w"))
    return rows.groupBy("w.column", "w.unit", "w.read_as").agg(F.count(F.lit(1)).alias("cells"))


def _mapped(grid: DataFrame, profile: ImportProfile, ys: list[ColumnMapping]) -> DataFrame:
    """A row a mapped cell, with k, the number of its channel's mapping; one explode for all channels and files."""
    start = max(0, profile.header_row)
    bounds = lambda c: (c.row_start if c.row_start is not None else start, c.row_end if c.row_end is not None else (1 << 62))
    decimal = lambda c: F.replace(c, F.lit(profile.decimal), F.lit(".")) if profile.decimal != "." else c
    structs = []
    for k, y in enumerate(ys):
        axis, (low, high) = _axis_of(y, profile), bounds(y)
        y_at = column_index(y.column)
        cell = F.trim(F.get("cells", y_at))
        value = F.when(cell == "", 0.0).otherwise(number(decimal(cell)))
        x_bad: Column = F.lit(None).cast("string")
        there = F.size("cells") > y_at
        x_name = ""
        if isinstance(axis, ColumnMapping):
            x_at, x_name = column_index(axis.column), axis.column
            if axis.row_start is not None or axis.row_end is not None:
                low, high = max(low, bounds(axis)[0]), min(high, bounds(axis)[1])
            x_cell = F.trim(F.get("cells", x_at))
            x = axis_value(decimal(x_cell), axis.unit, FREQUENCY if axis.role == X_FREQUENCY else TIME)
            x_bad = F.when(x.isNull(), x_cell)
            ts = F.coalesce(x, F.lit(0).cast("long"))
            there &= (F.size("cells") > x_at) & (x_cell != "")
        else:
            ts = ((F.col("row_idx") - low) * (1e9 / axis if axis > 0 else 0.0)).cast("long")
        structs.append(F.when(there & F.col("row_idx").between(low, high), F.struct(
            F.lit(k).alias("k"), F.lit(_name(y)).alias("channel"), ts.alias("ts_ns"), F.coalesce(value, F.lit(0.0)).alias("value"),
            F.when(value.isNull(), cell).alias("y_bad"), x_bad.alias("x_bad"), F.lit(x_name).alias("x_column"), F.lit(y.column).alias("y_column"))))
    return grid.select(*[c for c in ("file",) if c in grid.columns], "row_idx", F.explode(F.array_compact(F.array(*structs))).alias("s")).select("*", "s.*").drop("s")


def _name(y: ColumnMapping) -> str:
    return y.name or f"Col{y.column}"


def _meta(profile: ImportProfile, ys: list[ColumnMapping], source: str) -> list[tuple]:
    out = []
    for y in ys:
        axis = _axis_of(y, profile)
        by_column = isinstance(axis, ColumnMapping)
        domain = FREQUENCY if by_column and axis.role == X_FREQUENCY else TIME
        out.append((_name(y), y.unit, "LREAL", "imported", 0.0 if by_column else float(axis), 0, f"{source}:{y.column}", domain, None))
    return out


def _signals_of(profile: ImportProfile) -> list[ColumnMapping]:
    ys = [c for c in profile.columns if c.role == SIGNAL]
    if not ys:
        raise ValueError("the profile has no channels")
    return ys


def import_profile(grid: DataFrame, profile: ImportProfile, source: str = "grid") -> Imported:
    """Channels of ``grid`` (row_idx, cells), the cells that were no numbers, and warnings."""
    ys = _signals_of(profile)
    rows = _mapped(grid.drop("file"), profile, ys)
    channels = grid.sparkSession.createDataFrame(_meta(profile, ys, source), CHANNEL_SCHEMA)
    return Imported(SignalFrame(_arranged(rows, ys), channels), _bad_cells(rows), unit_warnings(profile))


def _arranged(rows: DataFrame, ys: list[ColumnMapping]) -> DataFrame:
    """Samples of mapped cells: relative times, offsets, collapsed instants, collapsed plateaus, in that order."""
    samples = rows.select("k", "channel", F.col("row_idx").alias("seq"), "ts_ns", "value")
    numbers = lambda test: [k for k, y in enumerate(ys) if test(y)]
    if relative := numbers(lambda y: y.relative_time):
        first = samples.filter(F.col("k").isin(relative)).groupBy("channel").agg(F.min_by("ts_ns", "seq").alias("t0"))
        samples = samples.join(first, "channel", "left").withColumn("ts_ns", F.col("ts_ns") - F.coalesce("t0", F.lit(0))).drop("t0")
    offset: Column = F.lit(0).cast("long")
    for k, y in enumerate(ys):
        if y.time_offset_s:
            offset = F.when(F.col("k") == k, int(y.time_offset_s * 1e9 + (0.5 if y.time_offset_s > 0 else -0.5))).otherwise(offset)
    samples = samples.withColumn("ts_ns", F.col("ts_ns") + offset)
    ways: dict[tuple[str, str], list[int]] = {}
    for k, y in enumerate(ys):
        ways.setdefault((y.collapse_instants, y.collapse_plateaus), []).append(k)
    parts = []
    for (instants, plateaus), of in ways.items():
        # A file's order is its rows, so runs are runs of rows.
        part = SignalFrame.of(samples if len(ways) == 1 else samples.filter(F.col("k").isin(of)))
        if instants:
            part = collapse_instants(part, instants)
        if plateaus:
            part = collapse_plateaus(part, plateaus)
        parts.append(part.samples)
    return reduce(DataFrame.unionByName, parts)


def _bad_cells(rows: DataFrame) -> DataFrame:
    """column, axis, count, first_cell, first_row: cells read as 0, an axis column's once however many share it."""
    y = rows.filter("y_bad is not null").select(F.col("y_column").alias("column"), F.lit(False).alias("axis"), "row_idx", F.col("y_bad").alias("cell"))
    x = rows.filter("x_bad is not null").select(F.col("x_column").alias("column"), F.lit(True).alias("axis"), "row_idx", F.col("x_bad").alias("cell")).distinct()
    return y.union(x).groupBy("column", "axis").agg(F.count(F.lit(1)).alias("count"), F.min_by("cell", "row_idx").alias("first_cell"), F.min("row_idx").alias("first_row"))


def _imported(grids: DataFrame, profile: ImportProfile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, channels with the file they are of, and a report with a row a file."""
    ys = _signals_of(profile)
    short = F.regexp_extract("file", r"([^/]*)$", 1)
    within = F.concat(short, F.lit(":"), F.col("channel"))
    samples = _arranged(_mapped(grids, profile, ys).withColumn("channel", within), ys)
    files = grids.select("file").distinct()
    meta = grids.sparkSession.createDataFrame([(k, *m) for k, m in enumerate(_meta(profile, ys, ""))], "k int, " + CHANNEL_SCHEMA)
    made = files.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(ys) - 1)))).join(F.broadcast(meta), "k")  # a row a mapped column
    made = made.withColumn("channel", within).withColumn("source_symbol", F.concat(short, "source_symbol"))
    counts = made.join(samples.groupBy("channel").agg(F.count(F.lit(1)).alias("n")), "channel", "left")
    report = counts.groupBy("file").agg(F.count("n").alias("n_channels"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"))
    return samples, made.select(*meta.columns[1:], "file"), report


def import_files(grids: DataFrame, profile: ImportProfile) -> tuple[SignalFrame, DataFrame]:
    """One profile over many files of a grid (file, row_idx, cells), all in one plan.

    Channels are named file:name by the file's last part; the report has a row
    a file with the channels and samples it gave, 0 for one that gave nothing.
    """
    samples, channels, report = _imported(grids, profile)
    return SignalFrame(samples, channels.drop("file")), report


_SAMPLES = "seq long, ts_ns long, value double, channel string"


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """All versions of a library's manifest (version, file, import_id), if there is one."""
    try:
        return spark.read.schema("file string, import_id string, version long").parquet(f"{path}/manifest")
    except AnalysisException:
        return None


def import_into(grids: DataFrame, profile: ImportProfile, path: str) -> DataFrame:
    """Imports files into a library at ``path``: what a file gave before is replaced. Returns the report.

    An import writes a folder of its own. Which folder holds a file's channels
    is said by the manifest, whose next version is written last, as one file;
    an import that fails before leaves all as it was, and readers of the
    version before go on reading it. A file that gives no samples keeps what
    it had.
    """
    spark, import_id = grids.sparkSession, uuid.uuid4().hex
    samples, channels, report = _imported(grids, profile)
    samples.select("seq", "ts_ns", "value", "channel").write.parquet(f"{path}/samples/import_id={import_id}")
    written = spark.read.schema(_SAMPLES).parquet(f"{path}/samples/import_id={import_id}")
    channels.join(written.select("channel").distinct(), "channel", "left_semi").write.parquet(f"{path}/channels/import_id={import_id}")
    now = spark.read.parquet(f"{path}/channels/import_id={import_id}").select("file", F.lit(import_id).alias("import_id")).distinct()
    old, version = _manifests(spark, path), 0
    if old is not None:
        version = old.agg(F.max("version")).first()[0]
        before = old.filter(F.col("version") == version).select("file", "import_id")
        now = now.unionByName(before.join(now.select("file"), "file", "left_anti"))
    now.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version + 1}")
    return report


def library(spark: SparkSession, path: str, version: int | None = None) -> SignalFrame:
    """The channels of a library, as its newest manifest or the one of a version says."""
    every = _manifests(spark, path)
    if every is None:
        raise ValueError(f"{path} holds no library")
    version = every.agg(F.max("version")).first()[0] if version is None else version
    said = every.filter(F.col("version") == version).select("file", "import_id")
    ids = [r[0] for r in said.select("import_id").distinct().collect()]  # folders still in use
    channels = spark.read.parquet(f"{path}/channels").filter(F.col("import_id").isin(ids)).join(said, ["file", "import_id"], "left_semi")
    of = channels.select("channel", "import_id")
    samples = spark.read.schema(_SAMPLES + ", import_id string").parquet(f"{path}/samples").filter(F.col("import_id").isin(ids)).join(of, ["channel", "import_id"], "left_semi")
    return SignalFrame(samples.select("channel", "seq", "ts_ns", "value"), channels.drop("file", "import_id"))
