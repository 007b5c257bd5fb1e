"""Character-delimited files: grids of cells, and the layouts signals are kept in.

A file's first lines are read on the driver as configuration; its body is
split and parsed on the executors. A grid is (row_idx, cells): rows keep
their own length, so a missing cell differs from an empty one.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.frame import CHANNEL_SCHEMA, FREQUENCY, TIME, SignalFrame

#: Lines that describe a file at most.
HEAD_LINES = 100
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"


def number(cell: Column) -> Column:
    """A trimmed cell as double, null if it is no number."""
    return F.when(cell.rlike(_NUMBER), cell.try_cast("double"))


def lines(spark: SparkSession, path: str, line_sep: str | None = None, keep: Column | None = None) -> DataFrame:
    """(file, row_idx, value): the lines of each file, numbered from 0 without gaps.

    Lines for which ``keep`` (on column value) is false are left out and not numbered. Lines are counted per piece of a file first; a line's number is its place
    in the piece and the lines of the pieces before it.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    text = reader.text(path)
    text = text.filter(keep) if keep is not None else text
    raw = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id"))
    pieces = raw.groupBy("file", "piece").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("file", "piece", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = raw.join(pieces, ["file", "piece"])
    return numbered.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("row_idx"), "value")


#: Marks of the coding below: a mark itself, and a separator within quotes.
_MARK, _MARK_IS, _SEP_IS = "\x01", "\x02", "\x03"


def split_cells(line: Column, sep: str = ",", quote: str | None = '"') -> Column:
    """The cells of a line: a quote anywhere opens or ends a quoted stretch, a doubled quote within one is a quote.

    Every quote changes between without and within, so of the pieces between
    quotes every second is within. A piece without, empty and between two
    quotes is the middle of a doubled quote. An open stretch ends with the
    line. Separators within are coded before the line is split, so any text
    comes back. ``sep`` counts by its first character, without one it is a
    comma.
    """
    sep = sep[:1] or ","
    cells = lambda c: F.split(c, re.escape(sep))
    if not quote:
        return cells(line)
    pieces = F.split(F.replace(line, F.lit(_MARK), F.lit(_MARK + _MARK_IS)), re.escape(quote))
    last = F.size(pieces) - 1
    within = lambda c: F.replace(c, F.lit(sep), F.lit(_MARK + _SEP_IS))
    read = F.transform(pieces, lambda c, i: F.when(i % 2 == 1, within(c)).when((c == "") & (i > 0) & (i < last), F.lit(quote)).otherwise(c))
    plain = lambda c: F.replace(F.replace(c, F.lit(_MARK + _SEP_IS), F.lit(sep)), F.lit(_MARK + _MARK_IS), F.lit(_MARK))
    quoted = F.transform(cells(F.array_join(read, "")), plain)
    return F.when(F.contains(line, F.lit(quote)), quoted).otherwise(cells(line))


def read_grid_csv(spark: SparkSession, path: str, sep: str = ",", row_sep: str | None = None, quote: str | None = '"') -> DataFrame:
    """(file, row_idx, cells); lines whose first sign is # are comments, left out and not counted.

    Lines end with \\n or \\r\\n, an empty one at a file's end is none. With
    a row separator of its own a file has no empty rows at all.
    """
    note = F.col("value").rlike(r"(?U)^\s*#")
    if row_sep not in (None, "\n", "\r\n"):
        rows = lines(spark, path, row_sep, ~note & (F.col("value") != ""))
        return rows.select("file", "row_idx", split_cells(F.col("value"), sep, quote).alias("cells"))
    rows = lines(spark, path, "\n", ~note).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    every = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id(), F.col("value").isin("", "\r").alias("empty")).alias("at"))
    ends = every.groupBy("file").agg(F.max("at").alias("at")).filter("at.empty").select(F.col("file").alias("of"))
    last = rows.groupBy("file").agg(F.max("row_idx").alias("last")).join(ends, F.col("file") == F.col("of"), "left_semi").select(F.col("file").alias("of"), "last")
    rows = rows.join(last, (F.col("file") == F.col("of")) & (F.col("row_idx") == F.col("last")), "left_anti")
    return rows.select("file", "row_idx", split_cells(F.col("value"), sep, quote).alias("cells"))


def head(spark: SparkSession, path: str, n: int = HEAD_LINES) -> list[str]:
    return [r[0].rstrip("\r") for r in spark.read.text(path).limit(n).collect()]


def split_name_unit(title: str) -> tuple[str, str]:
    m = re.fullmatch(r"\s*(.*?\S)\s*\[([^\[\]]*)\]\s*", title)
    return (m[1], m[2].strip()) if m else (title.strip(), "")


# Factors from a unit to the axis' integer.
TIME_UNITS = {"s": 1e9, "ms": 1e6, "us": 1e3, "µs": 1e3, "ns": 1.0}
FREQUENCY_UNITS = {"hz": 1e9, "khz": 1e12, "mhz": 1e15}


def axis_value(cell: Column, unit: str, domain: str, guess_ns: bool = False) -> Column:
    """A trimmed cell with decimal point on the axis, null if it is no number; integer ns never pass through double.

    With ``guess_ns`` integers of 1e15 and more without a unit are nanoseconds.
    """
    u = unit.strip().lower()
    whole = F.when(cell.rlike(r"^[+-]?\d+$"), cell.try_cast("long"))
    if domain == FREQUENCY:
        return (number(cell) * FREQUENCY_UNITS.get(u, 1e9)).try_cast("long")
    scaled = (number(cell) * TIME_UNITS.get(u, 1e9)).try_cast("long")
    if u == "ns":
        return F.coalesce(whole, scaled)
    return F.when(F.abs(whole) >= 10**15, whole).otherwise(scaled) if guess_ns and not u else scaled


@dataclass(frozen=True)
class Target:
    """Where a channel lies in a file: its column and that of its axis."""

    name: str
    unit: str
    x: int
    y: int
    domain: str
    x_unit: str


def _signals(rows: DataFrame, targets: list[Target], source: str, guess_ns: bool = True) -> SignalFrame:
    """Channels of (row_idx, cells): samples whose axis or value is no number are left out."""
    cell = lambda i: F.replace(F.trim(F.get(F.col("cells"), i)), F.lit(","), F.lit("."))
    of = [F.struct(F.lit(t.name).alias("channel"), axis_value(cell(t.x), t.x_unit, t.domain, guess_ns).alias("ts_ns"), number(cell(t.y)).alias("value")) for t in targets]
    out = rows.select(F.col("row_idx").alias("seq"), F.explode(F.array(*of)).alias("s")).select("s.channel", "seq", "s.ts_ns", "s.value").filter("ts_ns is not null and value is not null")
    spark = rows.sparkSession
    meta = spark.createDataFrame([(t.name, t.unit, "LREAL", "imported", 0.0, 0, source, t.domain, None) for t in targets], CHANNEL_SCHEMA)
    return SignalFrame(out, meta.join(out.select("channel").distinct(), "channel", "left_semi"))


def _header_targets(titles: list[str]) -> list[Target]:
    """A shared axis (t, f) with channels after it, or pairs of axis and channel."""
    is_axis = lambda h: re.match(r"\s*[tf](\s|\[|$)", h) is not None
    domain = lambda h: FREQUENCY if re.match(r"\s*f(\s|\[|_|$)", h) else TIME
    out, third = [], titles[2].strip() if len(titles) > 2 else ""
    if is_axis(titles[0]) and not third.startswith(("t_", "f_")):
        x = 0
        for i, title in enumerate(titles):
            if is_axis(title):
                x = i
            elif split_name_unit(title)[0]:
                out.append(Target(*split_name_unit(title), x, i, domain(titles[x]), split_name_unit(titles[x])[1]))
        return out
    for i in range(0, len(titles) - 1, 2):
        if split_name_unit(titles[i + 1])[0]:
            out.append(Target(*split_name_unit(titles[i + 1]), i, i + 1, domain(titles[i]), split_name_unit(titles[i])[1]))
    return out


def _noted_targets(note: dict, titles: list[str]) -> list[Target]:
    """Targets from a file's own description of its columns, which outranks the titles."""
    columns, out = note.get("columns", []), []
    for i, c in enumerate(columns):
        x = c.get("refX", -1)
        if c.get("role", "signal") != "signal" or x < 0:
            continue
        title = split_name_unit(titles[i]) if i < len(titles) else ("", "")
        name = c.get("name") or title[0]
        unit = c.get("unit") or ("" if c.get("name") else title[1])
        axis = columns[x] if x < len(columns) else {}
        if name:
            out.append(Target(name, unit, x, i, FREQUENCY if axis.get("role") == "x_frequency" else TIME, axis.get("unit", "")))
    return out


_NOTE = re.compile(r"#\s*[\w-]*csv:\s*(\{.*)")


def read_signal_csv(spark: SparkSession, path: str) -> SignalFrame:
    """A file of signals by the description in its first line, else by its column titles."""
    note, title_at, first = None, None, head(spark, path)
    for i, line in enumerate(first):
        if not line.strip():
            continue
        if (m := _NOTE.match(line.strip())) is not None:
            note = m[1]
            continue
        title_at = i
        break
    if title_at is None:
        raise ValueError("the file is empty")
    counts = Counter(first[title_at])
    sep = max(",;\t|", key=lambda c: counts[c])
    titles = first[title_at].split(sep)
    if len(titles) < 2:
        raise ValueError("one axis column and one value column are needed")
    targets: list[Target] = []
    if note:
        try:
            targets = _noted_targets(json.loads(note), titles)
        except (ValueError, AttributeError):
            targets = []
    targets = targets or _header_targets(titles)
    if not targets:
        raise ValueError("no data columns found")
    rows = lines(spark, path).filter((F.col("row_idx") > title_at) & (F.trim("value") != ""))
    return _signals(rows.select("row_idx", F.split(F.rtrim("value"), re.escape(sep)).alias("cells")), targets, path.rsplit("/", 1)[-1])


def paired_layout(first: list[str]) -> tuple[str, int, list[Target]] | None:
    """Separator, first data row and channels of an export with a Name row of pairs, if it is one."""
    best: tuple[int, str, int] | None = None
    for sep in "\t;,":
        for i, line in enumerate(first):
            c = [x.strip() for x in line.split(sep)]
            if len(c) >= 4 and c[0] == c[2] == "Name" and (best is None or len(c) > best[0]):
                best = (len(c), sep, i)
    if not best:
        return None
    _, sep, at = best
    rows = [[c.strip() for c in line.split(sep)] for line in first]
    keyed = {r[0]: r for r in reversed(rows) if r}
    data = next((i for i in range(at + 1, len(rows)) if re.match(_NUMBER.replace("(?i:nan|inf|infinity)", "nan"), rows[i][0].replace(",", "."))), None)
    if "SampleTime[ms]" not in keyed or data is None:
        return None
    units = keyed.get("Unit", [])
    out = []
    for y in range(1, len(rows[at]), 2):
        unit = re.sub(r"^\((.*)\)$", r"\1", units[y]) if y < len(units) else ""
        if rows[at][y]:
            out.append(Target(rows[at][y], "" if unit == "None" else unit, y - 1, y, TIME, "ms"))
    return (sep, data, out) if out else None


def read_paired_export(spark: SparkSession, path: str) -> SignalFrame:
    """An export whose channels each have a (time in ms, value) pair of columns of their own length."""
    layout = paired_layout(head(spark, path))
    if not layout:
        raise ValueError("no paired export")
    sep, data, targets = layout
    rows = lines(spark, path).filter((F.col("row_idx") >= data) & (F.col("value") != ""))
    return _signals(rows.select("row_idx", F.split(F.regexp_replace("value", "\r$", ""), re.escape(sep)).alias("cells")), targets, path.rsplit("/", 1)[-1])
