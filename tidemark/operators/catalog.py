"""The catalog of channels, registered operators, nested values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import SignalFrame
from tidemark.operators.derived import Derived, Transformation

__all__ = ["Derived", "Operator", "add", "alias", "apply_operator", "clear", "contains", "flatten_channels", "get", "merge_unique", "names", "register_operator", "remove", "rename"]


def add(f: SignalFrame, more: SignalFrame) -> SignalFrame:
    """Channels of ``more`` go in, in place of those of the same name."""
    names = more.channels.select("channel")
    return SignalFrame(f.samples.join(names, "channel", "left_anti").unionByName(more.samples), f.channels.join(names, "channel", "left_anti").unionByName(more.channels), f.longest.plus(more.longest))


def names(f: SignalFrame) -> DataFrame:
    return f.channels.select("channel")


def contains(f: SignalFrame, name: str) -> bool:
    return not f.channels.filter(F.col("channel") == name).isEmpty()


def get(f: SignalFrame, name: str) -> SignalFrame:
    if not contains(f, name):
        raise KeyError(name)
    return f.only(name)


def remove(f: SignalFrame, *gone: str) -> SignalFrame:
    keep = ~F.col("channel").isin(*gone)
    return SignalFrame(f.samples.filter(keep), f.channels.filter(keep), f.longest)


def clear(f: SignalFrame) -> SignalFrame:
    return SignalFrame(f.samples.filter(F.lit(False)), f.channels.filter(F.lit(False)))


def rename(f: SignalFrame, old: str, new: str) -> SignalFrame:
    """Refuses a blank name, a missing channel and a name that is taken."""
    if not new.strip():
        raise ValueError("a name must not be blank")
    if not contains(f, old):
        raise KeyError(old)
    if old != new and contains(f, new):
        raise ValueError(f"{new} is taken")
    return f.renamed(F.when(F.col("channel") == old, new).otherwise(F.col("channel")))


def alias(f: SignalFrame, name: str, as_name: str) -> SignalFrame:
    """The frame with a copy of one channel under another name."""
    return add(f, get(f, name).renamed(as_name))


def merge_unique(f: SignalFrame, other: SignalFrame) -> SignalFrame:
    """All channels of both; one of ``other`` whose name is taken becomes name (2), name (3), ...

    The least number from 2 that is free: taken numbers of a name are
    counted off without a loop over channels.
    """
    taken = f.channels.select(F.col("channel").alias("name")).union(other.channels.select("channel"))
    numbered = taken.select(F.regexp_extract("name", r"^(.*) \((\d{1,9})\)$", 1).alias("channel"), F.regexp_extract("name", r"^(.*) \((\d{1,9})\)$", 2).try_cast("long").alias("n"))
    used = numbered.filter("n >= 2").distinct()
    rank = F.row_number().over(Window.partitionBy("channel").orderBy("n"))
    # Numbers 2, 3, ... without a gap satisfy n = rank + 1.
    free = used.withColumn("rank", rank).filter(F.col("n") == F.col("rank") + 1).groupBy("channel").agg((F.max("n") + 1).alias("free"))
    clash = other.channels.join(f.channels.select("channel"), "channel", "left_semi").select("channel").join(free, "channel", "left")
    new_names = clash.select("channel", F.concat("channel", F.lit(" ("), F.coalesce("free", F.lit(2)).cast("string"), F.lit(")")).alias("new"))

    def moved(df: DataFrame) -> DataFrame:
        return df.join(new_names, "channel", "left").withColumn("channel", F.coalesce("new", "channel")).drop("new").select(*df.columns)

    return SignalFrame(f.samples.unionByName(moved(other.samples)), f.channels.unionByName(moved(other.channels)), f.longest.plus(other.longest))


@dataclass(frozen=True)
class Operator:
    name: str
    run: Transformation
    least: int
    most: int | None


_OPERATORS: dict[str, Operator] = {}


def register_operator(name: str, run: Transformation, least: int = 1, most: int | None = 1, replace: bool = False) -> None:
    """Adds ``run(frame, *args)`` under a name with its least and greatest number of arguments (None: any)."""
    if name in _OPERATORS and not replace:
        raise ValueError(f"{name} is registered already")
    _OPERATORS[name] = Operator(name, run, least, most)


def apply_operator(name: str, *args) -> SignalFrame:
    if name not in _OPERATORS:
        raise KeyError(f"no operator {name}")
    op = _OPERATORS[name]
    if len(args) < op.least or op.most is not None and len(args) > op.most:
        raise ValueError(f"{name} takes {op.least} to {op.most or 'any number of'} arguments, got {len(args)}")
    return op.run(*args)


_LEAVES = "array<struct<channel:string,value:double>>"


def flatten_channels(df: DataFrame, ts_ns: str, seq: str, bounds: dict[str, list[tuple[int, int]]] | None = None, most_leaves: int = 10_000, present: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], bool]:
    """Samples with a channel for every scalar leaf of the columns, the leaves left out, and whether the cap was hit.

    A struct's member is a.b, an array's element a[i], and so on inwards:
    a[i].b, a[i][j]. An array is as long as each row has it. ``bounds`` gives
    an array the (low, high) of its dimensions, which then are written a[i,j]
    in row-major order; its key is the array's path with [] for every index
    before it. Leaves that are neither numbers nor booleans are left out and
    listed by such a path; names in ``present`` are not made again. Of a row
    at most ``most_leaves`` leaves are kept, elements counting one by one.
    """
    bounds, skipped = bounds or {}, []
    grows = False

    def leaves(path: str, name: Column, c: Column, kind: T.DataType) -> tuple[Column | None, int]:
        """An array of a value's leaves, and how many there are at least."""
        nonlocal grows
        if isinstance(kind, T.StructType):
            made = [leaves(f"{path}.{m.name}", F.concat(name, F.lit(f".{m.name}")), c[m.name], m.dataType) for m in kind]
            inner = [x for x, _ in made if x is not None]
            return (F.concat(*inner) if inner else None), sum(n for _, n in made)
        if isinstance(kind, T.ArrayType):
            tried = leaves(f"{path}[]", name, F.lit(None).cast(kind.elementType), kind.elementType)
            if tried[0] is None:
                return None, 0
            skips = len(skipped)

            def element(label: Column, x: Column) -> Column:
                out = leaves(f"{path}[]", F.concat(name, F.lit("["), label, F.lit("]")), x, kind.elementType)[0]
                del skipped[skips:]
                return out

            if path in bounds:
                sizes = [high - low + 1 for low, high in bounds[path]]
                total = math.prod(sizes)
                strides = [math.prod(sizes[d + 1 :]) for d in range(len(sizes))]
                label = lambda i: F.concat_ws(",", *[(F.floor(i / st) % n + low).cast("string") for st, n, (low, _) in zip(strides, sizes, bounds[path], strict=True)])
                return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda i: element(label(i), F.get(c, i)))), total * tried[1]
            grows = True
            return F.flatten(F.transform(F.coalesce(c, F.array().cast(kind)), lambda x, i: element(i.cast("string"), x))), 0
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            skipped.append(path)
            return None, 0
        return F.array(F.struct(name.alias("channel"), c.cast("double").alias("value"))), 1

    made = [leaves(m.name, F.lit(m.name), F.col(f"`{m.name}`"), m.dataType) for m in df.schema if m.name not in (ts_ns, seq)]
    found = [x for x, _ in made if x is not None]
    if not found:
        raise ValueError("there is no scalar leaf")
    every = F.concat(*[x.cast(_LEAVES) for x in found])
    if present:
        every = F.filter(every, lambda x: ~x["channel"].isin(*present))
    rows = df.select(F.col(seq).cast("long").alias("seq"), F.col(ts_ns).cast("long").alias("ts_ns"), every.alias("leaves"))
    if grows or present:
        capped = (rows.agg(F.max(F.size("leaves"))).first()[0] or 0) > most_leaves
    else:
        capped = sum(n for _, n in made) > most_leaves
    rows = rows.select("seq", "ts_ns", F.explode(F.slice("leaves", 1, most_leaves) if capped else F.col("leaves")).alias("l"))
    return rows.select("l.channel", "seq", "ts_ns", F.coalesce("l.value", F.lit(float("nan"))).alias("value")), skipped, capped
