"""Time slices with carried state: how one long channel uses many tasks.

A channel with more than ``ROWS_PER_SLICE`` samples is cut into slices of
equal time; equal timestamps share a slice. Windows run within a slice, and
what a slice needs of its neighbours comes from a table with one row a slice.
Where no channel is that long, the plain window is planned. Which it is, is
asked of the data once for a frame and all that is made of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.frame import Longest

ROWS_PER_SLICE = 500_000
ORDER = ("ts_ns", "seq")


class Sliced:
    """``df`` with column slice, and whether there is more than one slice."""

    def __init__(self, df: DataFrame, many: bool):
        self.df, self.many = df, many

    @property
    def window(self):
        return Window.partitionBy("channel", "slice").orderBy(*ORDER)

    def with_columns(self, **columns: Column) -> Sliced:
        return Sliced(self.df.withColumns(columns), self.many)


#: Cells of equal time a slice's worth of rows is counted in before bounds are chosen.
CELLS_PER_SLICE = 64


def sliced(samples: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, longest: Longest | None = None) -> Sliced:
    """``samples`` cut into slices of about so many rows.

    Rows are counted in fine cells of equal time; a cell's slice is its place
    in the running count. Cells that alone hold more than a slice (samples
    crowd, or one lies far off) are cut into cells of their own, until none
    does that has more than one time.
    """
    if (longest or Longest.of(samples))() <= rows_per_slice:
        return Sliced(samples.withColumn("slice", F.lit(0).cast("long")), False)
    of, crowded = ["channel"], F.col("n") > rows_per_slice
    stats = samples.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    while True:
        span = F.col("t1") - F.col("t0") + 1
        width = F.when(crowded, F.ceil(span / (F.ceil(F.col("n") / rows_per_slice) * CELLS_PER_SLICE))).otherwise(span).cast("long")
        cell = f"c{len(of)}"
        samples = samples.join(stats.select(*of, "t0", width.alias("width")), of).withColumn(cell, F.expr("(ts_ns - t0) div width")).drop("t0", "width")
        of.append(cell)
        stats = samples.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
        if stats.filter(crowded & (F.col("t1") > F.col("t0"))).isEmpty():
            break
    before = F.sum("n").over(Window.partitionBy("channel").orderBy(*of[1:])) - F.col("n")
    slices = stats.select(*of, F.floor(before / rows_per_slice).alias("slice"))
    return Sliced(samples.join(slices, of).drop(*of[1:]), True)


def _over_slices() -> Window:
    return Window.partitionBy("channel").orderBy("slice")


def neighbours(s: Sliced, **columns: Column) -> Sliced:
    """Adds prev and next, structs of the given columns (ts_ns and value unless named) of the rows beside."""
    row = F.struct(*[c.alias(k) for k, c in columns.items()]) if columns else F.struct("ts_ns", "value")
    df = s.df.withColumn("prev", F.lag(row).over(s.window)).withColumn("next", F.lead(row).over(s.window))
    if not s.many:
        return Sliced(df, False)
    at = F.struct(*ORDER)
    edges = s.df.groupBy("channel", "slice").agg(F.min_by(row, at).alias("head"), F.max_by(row, at).alias("tail"))
    edges = edges.select("channel", "slice", F.lag("tail").over(_over_slices()).alias("before"), F.lead("head").over(_over_slices()).alias("after"))
    df = df.join(edges, ["channel", "slice"]).withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after"))
    return Sliced(df.drop("before", "after"), True)


def running_sum(s: Sliced, x: Column, name: str) -> Sliced:
    """The sum of ``x`` over all rows of the channel up to this one."""
    df = s.df.withColumn(name, F.sum(x).over(s.window.rowsBetween(Window.unboundedPreceding, 0)))
    if not s.many:
        return Sliced(df, False)
    totals = s.df.groupBy("channel", "slice").agg(F.sum(x).alias("total"))
    totals = totals.select("channel", "slice", F.sum("total").over(_over_slices().rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    return Sliced(df.join(totals, ["channel", "slice"]).withColumn(name, F.col(name) + F.when(F.col("carry").isNull(), 0).otherwise(F.col("carry"))).drop("carry"), True)


def last_known(s: Sliced, x: Column, name: str, order: tuple = ORDER) -> Sliced:
    """The last non-null ``x`` at or before this row."""
    by = Window.partitionBy("channel", "slice").orderBy(*order)
    df = s.df.withColumn(name, F.last(x, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    if not s.many:
        return Sliced(df, False)
    ends = s.df.filter(x.isNotNull()).groupBy("channel", "slice").agg(F.max_by(x, F.struct(*order)).alias("tail"))
    slices = s.df.select("channel", "slice").distinct().join(ends, ["channel", "slice"], "left")
    carry = F.last("tail", ignorenulls=True).over(_over_slices().rowsBetween(Window.unboundedPreceding, -1))
    df = df.join(slices.select("channel", "slice", carry.alias("carry")), ["channel", "slice"])
    return Sliced(df.withColumn(name, F.coalesce(name, "carry")).drop("carry"), True)


def next_known(s: Sliced, x: Column, name: str, order: tuple = ORDER) -> Sliced:
    """The first non-null ``x`` at or after this row."""
    # Read backwards: a frame that grows is a running value, one that shrinks is read anew for every row.
    by = Window.partitionBy("channel", "slice").orderBy(*[F.desc(c) for c in order])
    df = s.df.withColumn(name, F.last(x, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    if not s.many:
        return Sliced(df, False)
    ends = s.df.filter(x.isNotNull()).groupBy("channel", "slice").agg(F.min_by(x, F.struct(*order)).alias("head"))
    slices = s.df.select("channel", "slice").distinct().join(ends, ["channel", "slice"], "left")
    back = Window.partitionBy("channel").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last("head", ignorenulls=True).over(back)
    df = df.join(slices.select("channel", "slice", carry.alias("carry")), ["channel", "slice"])
    return Sliced(df.withColumn(name, F.coalesce(name, "carry")).drop("carry"), True)


def run_ids(s: Sliced, changed: Column, name: str = "run") -> Sliced:
    """Numbers runs of rows from 1; ``changed`` is true where a new one begins and may use prev and next."""
    return running_sum(neighbours(s), F.when(changed, 1).otherwise(0), name)


def ordinals(s: Sliced, name: str = "row") -> Sliced:
    """The position of a row in its channel, from 0, without gaps."""
    out = running_sum(s, F.lit(1), name)
    return Sliced(out.df.withColumn(name, F.col(name) - 1), s.many)
