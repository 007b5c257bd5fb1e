"""Signals as DataFrames: one row a sample, and one row of meta data a channel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME, FREQUENCY = "time", "frequency"
SAMPLE_COLUMNS = ["channel", "seq", "ts_ns", "value"]
CHANNEL_SCHEMA = "channel string, unit string, data_type string, mode string, sample_rate_hz double, parent_task_cycle_us long, source_symbol string, domain string, source_start_ns long"


def channels_of(samples: DataFrame, unit: str = "", domain: str = TIME) -> DataFrame:
    """Plain meta data for every channel that has samples."""
    names = samples.select("channel").distinct()
    return names.select(
        "channel", F.lit(unit).alias("unit"), F.lit("LREAL").alias("data_type"), F.lit("irregular").alias("mode"), F.lit(0.0).alias("sample_rate_hz"),
        F.lit(0).cast("long").alias("parent_task_cycle_us"), F.lit("").alias("source_symbol"), F.lit(domain).alias("domain"), F.lit(None).cast("long").alias("source_start_ns"),
    )


class Longest:
    """An upper bound of the samples a channel has, asked of the data when first needed and once.

    Frames that keep or drop samples share their source's bound, so chained
    operators don't run their upstream again to learn it. Only the number of
    tasks follows from it, no result.
    """

    def __init__(self, ask: Callable[[], int]):
        self._ask, self._known = ask, None

    def __call__(self) -> int:
        if self._known is None:
            self._known = self._ask()
        return self._known

    @staticmethod
    def of(samples: DataFrame) -> Longest:
        return Longest(lambda: samples.groupBy("channel").count().agg(F.max("count")).first()[0] or 0)

    def plus(self, other: Longest) -> Longest:
        return Longest(lambda: self() + other())

    def times(self, n: int) -> Longest:
        return Longest(lambda: self() * n)


@dataclass(frozen=True)
class SignalFrame:
    """Many channels at once.

    ``samples`` (channel, seq, ts_ns, value) holds values that are never null;
    a missing one is NaN. Its order is (ts_ns, seq). ``ts_ns`` is nanoseconds,
    or Hz * 1e9 where the channel's domain is frequency.
    """

    samples: DataFrame
    channels: DataFrame
    longest: Longest = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        if self.longest is None:
            object.__setattr__(self, "longest", Longest.of(self.samples))

    @staticmethod
    def of(samples: DataFrame, unit: str = "", domain: str = TIME) -> SignalFrame:
        samples = samples.select(*SAMPLE_COLUMNS)
        return SignalFrame(samples, channels_of(samples, unit, domain))

    def with_samples(self, samples: DataFrame, longest: Longest | None = None) -> SignalFrame:
        """Other samples of the same channels; ``longest`` where a channel may have more of them than before."""
        return replace(self, samples=samples.select(*SAMPLE_COLUMNS), longest=longest or self.longest)

    def map_value(self, f: Callable[[Column], Column]) -> SignalFrame:
        return self.with_samples(self.samples.withColumn("value", f(F.col("value"))))

    def with_meta(self, **columns) -> SignalFrame:
        """The same samples with meta columns set to a value or a Column."""
        kinds = {f.name: f.dataType for f in self.channels.schema}
        return replace(self, channels=self.channels.withColumns({k: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[k]) for k, v in columns.items()}))

    def only(self, *names: str) -> SignalFrame:
        named = F.col("channel").isin(*names)
        return SignalFrame(self.samples.filter(named), self.channels.filter(named), self.longest)

    def renamed(self, name: Column | str) -> SignalFrame:
        """Every channel under another name; ``name`` may use column channel. Different channels keep different names."""
        new = F.lit(name) if isinstance(name, str) else name
        return SignalFrame(self.samples.withColumn("channel", new), self.channels.withColumn("channel", new), self.longest)

    def origins(self) -> DataFrame:
        """channel, origin_ns: where a channel's display starts; 0 for a spectrum's axis."""
        first = self.samples.groupBy("channel").agg(F.min("ts_ns").alias("first_ns"))
        origin = F.when(F.col("domain") == FREQUENCY, F.lit(0)).otherwise(F.coalesce("source_start_ns", "first_ns", F.lit(0)))
        return self.channels.join(first, "channel", "left").select("channel", origin.cast("long").alias("origin_ns"))
