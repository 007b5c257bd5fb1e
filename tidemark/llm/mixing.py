"""Mixing sources to target weights by the cube method.

Every source has a target of words. A document of a source with ratio
r = target / size is taken floor(r) times, and once more with probability
r - floor(r). The cube method draws these extra copies: a flight phase moves
the probabilities of three documents at a time along the null-space of the
two balancing constraints (words and documents) until one of them is 0 or 1,
so that both totals stay what they were. Blocks of one source fly in
parallel; each keeps eight documents of spread sizes back and leaves at most
two others undecided. Those fly together in the next, much smaller round. Once
a source fits one block, what that block kept back is landed with the two that
are left: a linear programme finds, among all designs over their subsets that
keep every probability, the one that misses words (and then documents) by
least in the mean, and one subset is drawn from it.

Documents that are long for their source are decided before all others, from
the longest down: the flight would leave them undecided and the landing could
not make up for them. After each the probabilities of all that follow are set
to the words left, and a choice that these can't make up for is avoided.

Units fly from the longest document to the shortest. Randomness comes from a seed and the block, never from the
partitioning: reruns agree.

Defined cases: null or empty text has size 0 and target share like any row;
a null source is a source of its own, last in order; repeated rows are
separate units, told apart by an ordinal; an empty table gives an empty result; further columns pass
through ``mixed`` and are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import all_ordinals, stored, text_or_empty, with_ordinals, word_count

#: Documents that fly together in one task; documents of a block kept for its source's landing.
BLOCK, LANDING = 2048, 8
#: A document is long above so many times the mean of its source, and above this share of its words (so at most 1,000 of a source are).
LONG_TIMES, LONG_SHARE = 6.0, 0.001
_SNAP = 1e-9


def source_targets(sized: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n, source_size, target: one row a source.

    The total is ``share`` of all sizes, dealt by the repeating ``weights`` in
    code-point order of the sources, null last. A target stops at ``most``
    times the source's size; the excess is dealt again by weight. That ends
    where the sources with the least size for their weight are full and the
    rest share one level, which the running sums below find directly. The
    windows hold one row a source.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most))
    before = every.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("weight", weight).withColumn("full", full).withColumn("total", total)
    per = per.withColumn("is_full", F.col("full") / F.col("weight") < level)
    free = F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(every)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("full"))).over(every), F.lit(0.0))
    target = F.when(F.col("is_full"), F.col("full")).otherwise(F.least(F.col("full"), rest / free * F.col("weight")))
    return per.select("source", "n", "source_size", target.alias("target"))


def fly(size: Sequence[float], pi: Sequence[float], draws: Iterable[float]) -> list[float]:
    """The flight phase over units in the given order: at most two of the result lie between 0 and 1."""
    pi, draws, held = list(map(float, pi)), iter(draws), []
    for i, p in enumerate(pi):
        if not _SNAP < p < 1 - _SNAP:
            pi[i] = float(round(p))
            continue
        held.append(i)
        while len(held) == 3 or len(held) == 2 and size[held[0]] == size[held[1]]:
            if len(held) == 3:
                a, b, c = (size[k] for k in held)
                u = (b - c, c - a, a - b)
                if not any(u):
                    u = (1.0, -1.0, 0.0)
            else:
                u = (1.0, -1.0)
            up = min((1 - pi[k]) / x if x > 0 else pi[k] / -x for k, x in zip(held, u, strict=True) if x)
            down = min(pi[k] / x if x > 0 else (1 - pi[k]) / -x for k, x in zip(held, u, strict=True) if x)
            step = up if next(draws) * (up + down) < down else -down
            for k, x in zip(held, u, strict=True):
                pi[k] += step * x
                if pi[k] < _SNAP or pi[k] > 1 - _SNAP:
                    pi[k] = float(round(pi[k]))
            held = [k for k in held if 0 < pi[k] < 1]
    return pi


def decide_long(size: Sequence[float], pi: float, total: float, draws: Iterable[float]) -> tuple[list[float], float]:
    """Decides units, longest first, out of ``total`` words of the same probability; also the others' probability then.

    Where either choice leaves words that the units after it can make up for,
    the draw decides and probabilities stay what they were in the mean.
    """
    out, want, rest = [], pi * total, total
    for s, draw in zip(size, draws, strict=False):
        chance, rest = min(1.0, max(0.0, want / rest)), rest - s
        off = [max(0.0, -w, w - rest) for w in (want, want - s)]
        take = off[1] < off[0] if off[0] != off[1] else draw < chance
        out.append(float(take))
        want -= s * take
    return out, min(1.0, max(0.0, want / rest)) if rest > 0 else 0.0


def held_for_landing(pi: np.ndarray, keep: int = LANDING) -> np.ndarray:
    """Undecided units at even ranks of the size order, which the landing decides with what the flight leaves.

    A longer document may be left undecided; shorter ones make up for its words.
    """
    open_ = np.flatnonzero((pi > _SNAP) & (pi < 1 - _SNAP))
    return open_ if len(open_) <= keep else open_[np.linspace(0, len(open_) - 1, keep).astype(int)]


def cheapest_design(pi: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsets (numbers whose bits are the units) and their probabilities: of all designs in which unit i has
    probability pi[i], one of least mean ``cost`` (a number a subset), by the simplex method.

    It begins with the nested subsets of the most likely units, which are a
    design already, as is every step after it.
    """
    m = len(pi)
    table = np.vstack([np.ones(1 << m), (np.arange(1 << m) >> np.arange(m)[:, None]) & 1])
    want = np.concatenate(([1.0], pi))
    base = np.concatenate(([0], np.cumsum(1 << np.argsort(-pi, kind="stable"))))
    cost = cost / max(cost.max(), 1e-300)
    for step in range(2000):
        inverse = np.linalg.inv(table[:, base])
        x, gain = inverse @ want, cost - (cost[base] @ inverse) @ table
        better = np.flatnonzero(gain < -1e-10)
        if not len(better):
            break
        # The steepest column, later the first one, which can't go in circles.
        enter = better[np.argmin(gain[better])] if step < 200 else better[0]
        along = inverse @ table[:, enter]
        ratio = np.where(along > 1e-10, np.maximum(x, 0) / np.where(along > 1e-10, along, 1), np.inf)
        ties = np.flatnonzero(ratio <= ratio.min() + 1e-12)
        base[ties[np.argmin(base[ties])]] = enter
    return base, np.maximum(np.linalg.inv(table[:, base]) @ want, 0)


def land(size: Sequence[float], pi: Sequence[float], draw: float) -> list[float]:
    """Decides the few units left with their probabilities kept, near their words and, a hundredth as heavy, their number."""
    pi = np.array(pi, float)
    left = np.flatnonzero((pi > 0) & (pi < 1))
    if len(left):
        sizes = np.asarray(size, float)[left]
        taken = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        cost = np.abs(taken @ sizes - sizes @ pi[left]) + 0.01 * sizes.mean() * np.abs(taken.sum(axis=1) - pi[left].sum())
        subsets, chance = cheapest_design(pi[left], cost)
        pi[left] = taken[subsets[min(np.searchsorted(np.cumsum(chance) / chance.sum(), draw), len(subsets) - 1)]]
    return pi.tolist()


def fly_block(size: Sequence[float], pi: np.ndarray, draws: np.ndarray, keep: int, last: bool) -> list[float]:
    """A block's flight over all but ``keep`` of its units, and its landing where it is its source's last."""
    waiting = held_for_landing(pi, keep)
    flown = np.array(fly(size, np.where(np.isin(np.arange(len(pi)), waiting), 0.0, pi), draws[1:]))
    flown[waiting] = pi[waiting]
    return land(size, flown.tolist(), draws[0]) if last else flown.tolist()


_FLIGHT = {"by": ["size", "tie", "doc_id"], "ascending": [False, True, True], "kind": "stable"}


def _long_first(units: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The long units, decided, and all others at their source's probability after that."""
    long = F.col("pi").between(_SNAP, 1 - _SNAP) & (F.col("size") > F.greatest(LONG_TIMES * F.col("source_size") / F.col("n"), LONG_SHARE * F.col("source_size")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(**_FLIGHT)
        draws = np.random.default_rng([seed, int(key[0]) & 0xFFFFFFFF]).random(len(rows))
        pi, after = decide_long(rows["size"].tolist(), float(rows["pi"].iloc[0]), float(rows["source_size"].iloc[0]), draws)
        return rows.assign(pi=pi, after=after)

    done = stored(units.filter(long).groupBy("source_key").applyInPandas(run, T.StructType([*units.schema, T.StructField("after", T.DoubleType())])), "cube-long")
    after = done.groupBy("source_key").agg(F.first("after").alias("after"))
    others = units.filter(~long).join(after, "source_key", "left").withColumn("pi", F.coalesce("after", "pi"))
    return done.select(*units.columns), others.select(*units.columns)


def _round(units: DataFrame, number: int, seed: int, keep: int) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, last = rows.sort_values(**_FLIGHT), bool(rows["blocks"].iloc[0] == 1)
        draws = np.random.default_rng([seed, number, int(key[0]) & 0xFFFFFFFF, int(key[1])]).random(2 * len(rows) + 8)
        return rows.assign(pi=fly_block(rows["size"].tolist(), rows["pi"].to_numpy(float), draws, LANDING if last else keep, last))

    return units.groupBy("source_key", "block").applyInPandas(run, units.schema)


def cube_copies(sized: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``sized`` (doc_id, source, size) with source_size, target and copies, the times a row is taken."""
    # Rows alike in all three are counted and numbered, so that they spread over blocks like others.
    sized = all_ordinals(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "nth")
    t = targets.withColumnRenamed("source", "__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    tie = F.xxhash64("doc_id", "size", "nth", F.lit(seed))
    blocks = F.ceil(F.col("n") / block)
    units = sized.join(t, sized["source"].eqNullSafe(t["__source"])).select(
        "doc_id", "source", "size", "source_size", "target", "n", F.floor(ratio).cast("long").alias("base"), (ratio - F.floor(ratio)).alias("pi"),
        tie.alias("tie"), F.xxhash64(F.col("source").isNull(), "source").alias("source_key"), blocks.alias("blocks"), F.pmod(tie, blocks).alias("block"),
    )
    long, units = _long_first(units, seed)
    most, number, decided = math.ceil((targets.agg(F.max("n")).first()[0] or 0) / block), 0, [long]
    # Kept back in a block that isn't its source's last; blocks at least halve from round to round.
    keep = max(0, min(LANDING, block // 2 - 2))
    while True:
        # Hashed blocks of 2,048 on average; a source's single block flies and lands whole.
        done = stored(_round(units, number, seed, keep), f"cube-{number}")
        if most <= 1:
            decided.append(done)
            break
        undecided = F.col("pi").between(_SNAP, 1 - _SNAP)
        decided.append(done.filter(~undecided))
        most, number = math.ceil(most * (2 + keep) / block), number + 1
        units = done.filter(undecided).withColumn("blocks", F.ceil(F.col("blocks") * (2 + keep) / block)).withColumn("block", F.pmod(F.xxhash64("tie", F.lit(number)), "blocks"))
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("pi").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row a document: doc_id, source, size (words), source_size, target, copies. Texts are read once."""
    sized = stored(docs.select("doc_id", "source", word_count(text_or_empty("text")).alias("size")), "sizes")
    return cube_copies(sized, stored(source_targets(sized, weights, share, most), "targets"), seed)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, all columns as they were.

    Rows alike in doc_id, source and size are taken alike often in sum.
    """
    copies = mix(docs, **how)
    size = word_count(text_or_empty("text"))
    taken = copies.groupBy("doc_id", "source", F.col("size").alias("__size")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    plan = stored(taken, "copies").withColumnsRenamed({"doc_id": "__id", "source": "__of"})
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__of")) & (F.col("__size") == F.col("__words"))
    out = docs.withColumn("__words", size).join(plan.filter("copies > 0"), on)
    if not plan.filter("rows > 1").isEmpty():
        # Of alike rows each takes the even share and the first ones the rest.
        alike = with_ordinals(out.filter("rows > 1"), ["__id", "__of", "__words"], "__nth")
        out = out.filter("rows = 1").withColumn("__nth", F.lit(0).cast("long")).unionByName(alike)
    else:
        out = out.withColumn("__nth", F.lit(0).cast("long"))
    times = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("__nth") < F.col("copies") % F.col("rows"), 1).otherwise(0)
    return out.withColumn("__times", times.cast("int")).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
