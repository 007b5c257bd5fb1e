"""Derived channels: definitions as a graph, each result computed once from its inputs alone.

A definition is evaluated on frames of just the channels it reads. A result
that more than one definition reads, or whose plan has grown over
``MOST_RELATIONS`` relations, is written to the session's shared folder and
read back, so a chain or a ladder of definitions is a plan of a bounded size a
channel and no upstream runs twice.

Every result has a fingerprint: of a definition that is the version it was
defined with and its inputs' fingerprints, of a given channel its meta data,
count, ends and a sum of row hashes. What has the fingerprint it had at the
last recomputation is taken from there, so after a change only the changed
definitions and those behind them run. Names are in no fingerprint: a rename
recomputes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.frame import CHANNEL_SCHEMA, SAMPLE_COLUMNS, SignalFrame
from tidemark.scratch import new_folder

Transformation = Callable[..., SignalFrame]

#: Relations in the plan of a result that is still left unwritten.
MOST_RELATIONS = 12


def _relations(df: DataFrame) -> int:
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def _settled(result: SignalFrame) -> SignalFrame:
    """The result's meta data (a row) as a local relation."""
    columns = [c.split()[0] for c in CHANNEL_SCHEMA.split(", ")]
    rows = [tuple(r) for r in result.channels.select(*columns).collect()]
    return SignalFrame(result.samples, result.samples.sparkSession.createDataFrame(rows, CHANNEL_SCHEMA), result.longest)


def _written(result: SignalFrame) -> SignalFrame:
    spark = result.samples.sparkSession
    path = new_folder(spark, "derived")
    result.samples.write.parquet(path)
    return SignalFrame(spark.read.schema(result.samples.schema).parquet(path), result.channels, result.longest)


def fingerprints(f: SignalFrame, names: list[str]) -> dict[str, str]:
    """A fingerprint of each of these channels' samples and meta data, by one aggregate."""
    hashes = F.sum(F.xxhash64("seq", "ts_ns", "value").cast("decimal(38,0)"))
    f = f.only(*names)
    facts = f.samples.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"), hashes.alias("h"))
    meta = f.channels.select("channel", F.to_json(F.struct(*[c for c in f.channels.columns if c != "channel"])).alias("meta"))
    return {r["channel"]: hashlib.sha256(repr((r["n"], r["t0"], r["t1"], r["h"], r["meta"])).encode()).hexdigest() for r in meta.join(facts, "channel", "left").collect()}


@dataclass(frozen=True)
class Definition:
    run: Transformation
    reads: tuple[str, ...]
    version: str


_VERSIONS = count()


@dataclass
class Derived:
    """Named DataFrame transformations of channels; a definition names the channels it reads."""

    definitions: dict[str, Definition] = field(default_factory=dict)
    #: Results of the last recomputation by fingerprint, and the definitions that it evaluated.
    results: dict[str, SignalFrame] = field(default_factory=dict, repr=False)
    ran: list[str] = field(default_factory=list)

    def define(self, name: str, run: Transformation, *reads: str, version: str | None = None) -> None:
        """``version`` says that a definition is one known before; without it every definition is new."""
        if name in reads or name in self._behind(reads):
            raise ValueError(f"{name} would depend on itself")
        self.definitions[name] = Definition(run, reads, f"={version}" if version is not None else f"#{next(_VERSIONS)}")

    def forget(self, name: str) -> None:
        self.definitions.pop(name, None)

    def _behind(self, reads: tuple[str, ...]) -> set[str]:
        seen, todo = set(), list(reads)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.definitions[n].reads if n in self.definitions else ()
        return seen

    def dependents_of(self, name: str) -> set[str]:
        """Definitions that read a channel, directly or through others."""
        return {n for n, d in self.definitions.items() if name in self._behind(d.reads)}

    def rename(self, old: str, new: str) -> None:
        """A channel's new name, also where definitions read it."""
        if not new.strip() or old != new and new in self.definitions:
            raise ValueError(f"{new!r} is blank or taken")
        self.definitions = {(new if n == old else n): Definition(d.run, tuple(new if r == old else r for r in d.reads), d.version) for n, d in self.definitions.items()}

    def order(self) -> list[str]:
        """Definitions, each after those that it reads."""
        out: dict[str, None] = {}
        todo = list(reversed(self.definitions))
        while todo:
            n = todo.pop()
            waits = [r for r in self.definitions[n].reads if r in self.definitions and r not in out] if n not in out else []
            if waits:
                todo += [n, *waits]
            else:
                out[n] = None
        return list(out)

    def recompute(self, f: SignalFrame) -> tuple[SignalFrame, dict[str, str]]:
        """The frame with all derived channels, and why others failed.

        A definition outranks a given channel of its name. One that fails
        leaves out those that read it.
        """
        if not self.definitions:
            return f, {}
        readers: dict[str, int] = {}
        for d in self.definitions.values():
            for r in set(d.reads):
                readers[r] = readers.get(r, 0) + 1
        marks = fingerprints(f, sorted(set(readers) - set(self.definitions)))
        made: dict[str, SignalFrame] = {}
        kept: dict[str, SignalFrame] = {}
        failed: dict[str, str] = {}
        self.ran = []
        for name in self.order():
            d = self.definitions[name]
            lost = sorted({r for r in d.reads if r not in marks})
            if lost:
                failed[name] = "reads " + ", ".join(lost)
                continue
            mark = hashlib.sha256(repr((d.version, [marks[r] for r in d.reads])).encode()).hexdigest()
            result = kept.get(mark) or self.results.get(mark)
            if result is None:
                try:
                    result = _settled(d.run(*[made[r].renamed(r) if r in made else f.only(r) for r in d.reads]))
                except (ValueError, KeyError) as e:
                    failed[name] = str(e)
                    continue
                self.ran.append(name)
                if readers.get(name, 0) > 1 or _relations(result.samples) > MOST_RELATIONS:
                    result = _written(result)
            marks[name], made[name], kept[mark] = mark, result, result
        self.results = kept
        rest = ~F.col("channel").isin(*self.definitions)
        samples, channels, longest = f.samples.filter(rest).select(*SAMPLE_COLUMNS), f.channels.filter(rest), f.longest
        for name, result in made.items():
            result = result.renamed(name)
            samples, channels, longest = samples.unionByName(result.samples.select(*SAMPLE_COLUMNS)), channels.unionByName(result.channels), longest.plus(result.longest)
        return SignalFrame(samples, channels, longest), failed
