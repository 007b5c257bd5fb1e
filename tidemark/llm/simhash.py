"""SimHash near-dedup: fingerprints, a grid range-join on segment popcounts, exact verification.

Fingerprint: A-Z lowered, words are runs without ASCII white space, shingles
of three words; each of the 64 bits is the majority of the shingles' XXH64.

Links: fingerprints that differ in at most three bits. Each 32-bit half is
embedded as sixteen popcounts of its 2-bit segments. The Manhattan distance
of two such vectors never exceeds the Hamming distance of the halves, and of
three differing bits one half has at most one, so every link lies within
distance 1 in the grid of one of the halves. An equi-join on grid cells, one
side also asking the up to sixteen cells one step above, finds all such
pairs; the join itself verifies them by the exact bit count, so only links
leave it. Copies are one row before the join: it runs over distinct
fingerprints, and no group of equal documents is ever paired with itself.

The law of texts alike (``similar_groups``, which the pipeline's stage uses)
is another one: sets of five-word shingles with a Jaccard likeness of 0.8 and
more. Three differing bits of 64 can't tell these, so texts get a longer
fingerprint of the same kind, the majority bits of their distinct words.
Its parts are embedded as popcounts of 2-bit segments; texts meet in the grid
cell of a part where that distance is zero. A part has so many segments that
unrelated texts seldom share a cell, and there are so many parts that alike
ones nearly always do: both follow from the number of texts. In a cell all
meet a few leaders, drawn anew for every cell, and of those the nearest ones
are verified by shingle sets, so rows grow in proportion however dense a group
of near copies is.

That leaves most links found and dense groups as one each. An exact join finds
all the others (``links_across``): shingles have one order, the commonest last,
and of two sets alike the first fifth of the longer and the first ninth of the
shorter share a shingle. A shingle whose texts are of several groups is a cell;
all texts that aren't of its greatest group meet all others there. Pairs of
one group, of sizes too far apart, and those whose parity bits differ in more
than sets alike can differ never leave the join. A pair that meets in many cells
leaves it at the first of them: a row knows its text's last few cells, and two
that have one of these in common met before. Tallies of shingles by bucket then
rule out pairs of long texts, and the rest is verified. No text, cell or pair is
left out, so the groups are those of brute force. Before it, in such cells, texts
meet one text each that is drawn from the greatest group (``bridges``), as often as
that finds many links: a dense group of loose edits then is one group, or nearly so,
when all pairs across groups are tried.

Defined cases: null and wordless texts have fingerprint zero and link like
any other; fewer than three words are one shingle; a null id is never the
component's id unless all ids are null; repeated rows are separate rows of
one component; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import keep_rows, stored

#: Differing bits that still link.
MOST_BITS = 3
WORDS = 3
_SEED = 42
_PIECE = 1 << 16


def simhash(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = np.frombuffer(b" ".join(words), np.uint8)
    blanks = np.flatnonzero(joined == 32)
    starts = np.concatenate(([0], blanks + 1))
    stops = np.concatenate((blanks, [joined.size]))
    n = max(1, len(words) - WORDS + 1)
    starts, stops = starts[:n], stops[-n:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        h = np.array([digest(view[a:b], _SEED) for a, b in zip(starts[at : at + _PIECE].tolist(), stops[at : at + _PIECE].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))


def half_cell(fp: Column, upper: bool) -> Column:
    """Sixteen popcounts of 2-bit segments of one half, two bits each, as one number."""
    half = F.shiftrightunsigned(fp, 32) if upper else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))


def links(fingerprints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """a < b: every pair of distinct values of column ``fp`` that differ in at most ``most_bits`` bits (3 or fewer)."""
    if most_bits > MOST_BITS:
        raise ValueError("one step in the grid of a half covers at most three bits")
    halves = F.array(*[F.struct(F.lit(u).alias("half"), half_cell(F.col("fp"), u).alias("cell")) for u in (False, True)])
    points = fingerprints.select("fp", F.explode(halves).alias("at")).select("at.half", "at.cell", "fp")
    # A step up exists where the segment's popcount is 0 or 1.
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30), F.lit(2)), lambda s: F.lit(1).cast("long") * F.pow(F.lit(2.0), s).cast("long")), lambda step: F.col("cell").bitwiseAND(step * 2) == 0)
    asks = points.select("half", F.explode(F.concat(F.array(F.lit(0).cast("long")), steps)).alias("step"), "cell", F.col("fp").alias("a")).select("half", (F.col("cell") + F.col("step")).alias("cell"), "a", (F.col("step") == 0).alias("same"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= most_bits
    once = ~F.col("same") | (F.col("a") < F.col("fp"))
    found = asks.join(points, ["half", "cell"]).filter(near & once)
    return found.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the component's smallest node.

    Alternating large-star and small-star steps; the minimum of a node's
    neighbours is an aggregate joined back, so a node with many neighbours is
    not one task's work. Every round is written and read again.
    """
    edges, before = stored(edges, "edges"), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.*").filter("u <> m").distinct()
        edges = stored(small.toDF("a", "b"), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before:
            return edges.toDF("node", "root").union(edges.select("b", "b").distinct())
        before = now


def near_groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, fp, text_key and the component's root fingerprint and smallest doc_id."""
    rows = stored(docs.select("doc_id", F.xxhash64("text").alias("text_key"), simhash_column("text").alias("fp")), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = placed.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(of, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


#: Texts alike: words of a shingle, and the likeness from which on they are.
SHINGLE, ALIKE = 5, 0.8
#: The long fingerprint: words of a feature, and those of 64 bits beside that sift pairs, with their greatest distance.
FEATURE, SIFT_FEATURE, SIFT_MOST = 1, 2, 18
#: Leaders of a cell and the nearest of all those a text meets that are verified; ``links_across`` finds what these miss.
LEADERS, NEAREST = 3, 3
#: Rounds of ``bridges`` go on while one finds a link to so many texts at least; any number of rounds gives the same groups.
WORTH_A_ROUND = 50
#: Longs of parity bits of a shingle set, and its shingles to a bucket of its tally at most.
PARITY, TALLY = 8, 8
#: Cells of a text before one, in the order of shingles, that tell whether a pair has met; any number gives the same links.
BEFORE = 4
#: Bits of the map that tells which rows of a table are not asked for.
SIEVE_BITS = 1 << 23
#: Texts whose shingles are counted and shingles that are known as common at most: these order shingles, and any order gives the same links.
ORDER_ROWS, ORDER_SHINGLES = 20_000, 1 << 17
#: The part of its bits in which a pair just alike differs, and the part of such pairs that shares no cell.
_DIFFER, _MISSED = 0.075, 0.07
# How often a segment of unrelated texts of a language agrees.
_UNRELATED = 0.42


def grid(n: int) -> tuple[int, int]:
    """2-bit segments of a part and parts, for so many texts: some two unrelated ones a cell, and pairs alike in one cell at least."""
    segments = max(12, math.ceil(math.log(max(n, 2) / 2) / -math.log(_UNRELATED)))
    same = (1 - _DIFFER) ** 2 + _DIFFER**2 / 2
    return segments, math.ceil(math.log(_MISSED) / math.log(1 - same**segments))


def _hashes(joined: np.ndarray, words: int, n_words: int) -> np.ndarray:
    """XXH64 of the distinct runs of so many words of a text, joined by blanks."""
    blanks = np.flatnonzero(joined == 32)
    starts, stops = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [joined.size]))
    n = max(1, n_words - words + 1)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(view[a:b], _SEED) for a, b in zip(starts[:n].tolist(), stops[-n:].tolist(), strict=True)), np.uint64, n))


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of hashes."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(features: np.ndarray, wide: int) -> np.ndarray:
    """The majority bits of hashes, ``wide`` times 64 of them."""
    ones = np.zeros(64 * wide, np.int64)
    for at in range(0, len(features), 1 << 13):
        some = features[at : at + (1 << 13)]
        bits = np.stack([_spread(some, k) for k in range(wide)], axis=1).view(np.uint8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones > len(features)


def long_fingerprint(text: str | None, segments: int, parts: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Grid cell of every part, the sifting word, and the text's shingle set as sorted 32-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = np.frombuffer(b" ".join(words), np.uint8)
    of = lambda n: _hashes(joined, n, len(words)) if words else np.zeros(0, np.uint64)
    bits = _majority(of(FEATURE), -(-2 * segments * parts // 64))[: 2 * segments * parts]
    counts = bits.reshape(parts, segments, 2).sum(axis=2)
    sift = int(np.packbits(_majority(of(SIFT_FEATURE), 1), bitorder="little").view(np.int64)[0])
    return counts @ 3 ** np.arange(segments), sift, np.unique((of(SHINGLE) >> np.uint64(32)).astype("<u4"))


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Of ``PARITY`` times 64 bits, each shingle flips one: two sets' bits differ in no more places than the sets differ in shingles."""
    odd = np.bincount(shingles % (64 * PARITY), minlength=64 * PARITY) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def tally(shingles: np.ndarray) -> np.ndarray:
    """Shingles by bucket of their hash, 255 at most; the number of buckets, a power of two, follows from that of shingles."""
    buckets = 1 << max(5, (len(shingles) // TALLY).bit_length())
    return np.minimum(np.bincount(shingles % buckets, minlength=buckets), 255).astype(np.uint8)


def tallies_differ(x: np.ndarray, y: np.ndarray) -> int:
    """In so many shingles at least do their sets differ; the larger tally is folded to the smaller."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    least = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, least).sum(axis=0) - y.reshape(-1, least).sum(axis=0)).sum())


def long_fingerprints(segments: int, parts: int):
    """A column function of texts."""
    cell = T.IntegerType() if 3**segments < 1 << 31 else T.LongType()
    made_of = T.StructType([T.StructField("cells", T.ArrayType(cell)), T.StructField("sift", T.LongType()), T.StructField("shingles", T.BinaryType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("tally", T.BinaryType())])

    @F.pandas_udf(made_of)
    def of(texts: pd.Series) -> pd.DataFrame:
        made = [long_fingerprint(t, segments, parts) for t in texts]
        kind = np.int32 if 3**segments < 1 << 31 else np.int64
        return pd.DataFrame({"cells": [m[0].astype(kind) for m in made], "sift": [m[1] for m in made], "shingles": [m[2].tobytes() for m in made], "bits": [parity_bits(m[2]) for m in made], "tally": [tally(m[2]).tobytes() for m in made]})

    return of


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard likeness of packed shingle sets; two empty ones are alike."""

    def one(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        both = len(np.intersect1d(p, q, assume_unique=True))
        return both / (len(p) + len(q) - both) if len(p) + len(q) else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _most_differ(sizes: Column) -> Column:
    """Shingles in which two sets alike differ at most, of the sum of their sizes."""
    return (1 - ALIKE) / (1 + ALIKE) * sizes + 1e-9


@F.pandas_udf(T.LongType())
def tallies_apart(p: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series([tallies_differ(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(p, q, strict=True)], dtype="int64")


def _asked_for(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row of ``table`` for each node of pairs (a, b). A map of bits spares most others the shuffle; the join decides."""
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    bit = F.col("node").bitwiseAND(F.lit(SIEVE_BITS - 1))
    words = needed.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("word")).toPandas()
    bits = np.zeros(SIEVE_BITS // 64, np.int64)
    bits[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)

    @F.pandas_udf(T.BooleanType())
    def may_be(nodes: pd.Series) -> pd.Series:
        at = nodes.to_numpy(np.int64) & (SIEVE_BITS - 1)
        return pd.Series((bits[at >> 6] >> (at & 63)) & 1 == 1)

    return table.filter(may_be("node")).join(needed, "node", "left_semi").dropDuplicates(["node"])


def _sides(pairs: DataFrame, some: DataFrame, column: str) -> DataFrame:
    """The pairs with a column of both nodes, as p and q."""
    side = lambda node, name: some.select(F.col("node").alias(node), F.col(column).alias(name))
    return pairs.join(side("a", "p"), "a").join(side("b", "q"), "b")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose shingle sets are alike."""
    pairs = stored(pairs, "pairs")
    some = stored(_asked_for(sets, pairs), "sets")
    return stored(_sides(pairs, some, "shingles").filter(likeness("p", "q") >= ALIKE).select("a", "b"), "links")


def common_shingles(sets: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in three and more of some texts, and in how many. Only the order of shingles follows from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"shingle": np.frombuffer(b"".join(batch["shingles"]), "<u4").view(np.int32)})

    some = sets.filter(F.pmod("node", F.lit(-(-max(texts, 1) // ORDER_ROWS))) == 0).dropDuplicates(["node"]).select("shingles")
    counted = some.mapInPandas(run, "shingle int").groupBy("shingle").count().filter("count >= 3")
    found = counted.orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES).toPandas().sort_values("shingle")
    return found["shingle"].to_numpy(np.int32), found["count"].to_numpy(np.int64)


def prefixes(n: int) -> tuple[int, int]:
    """Of two sets alike, in any one order, so many first shingles of the longer and of the shorter have one in common, for a set of n."""
    return n - math.ceil(ALIKE * n - 1e-9) + 1, n - math.ceil(2 * ALIKE / (1 + ALIKE) * n - 1e-9) + 1


def postings(sets: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """shingle, node, place, short: a row for each of the first shingles of each text, with its place; short says that it is among those of a shorter set."""
    known, times = common

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                first, places, short = [], [], []
                for x in part["shingles"]:
                    h = np.frombuffer(x, "<u4").view(np.int32)
                    if len(known):
                        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        h = h[np.lexsort((h, np.where(known[i] == h, times[i], 0)))]
                    longer, shorter = prefixes(len(h))
                    first.append(h[:longer])
                    places.append(np.arange(len(first[-1]), dtype=np.int32))
                    short.append(places[-1] < shorter)
                yield pd.DataFrame({"shingle": np.concatenate(first), "node": part["node"].to_numpy().repeat([len(x) for x in first]), "place": np.concatenate(places), "short": np.concatenate(short)})

    return sets.select("node", "shingles").mapInPandas(run, "shingle int, node long, place int, short boolean")


def shared_cells(sets: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows of ``postings`` whose shingle several texts have, a short one among them."""
    at = postings(sets, common).repartition("shingle")  # one shuffle serves the aggregate and the join
    cells = at.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("short").alias("any")).filter("low <> high and any").select("shingle")
    return stored(at.join(cells.hint("merge"), "shingle").distinct(), "cells")


def split_cells(cells: DataFrame, roots: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of cells with texts of several groups, with their root, the cell's greatest group and a text drawn from that."""
    at = cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition("shingle")
    drawn = F.max_by("node", F.xxhash64("node", "shingle", F.lit(seed))).alias("leader")
    groups = at.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("count"), drawn).groupBy("shingle")
    groups = groups.agg(F.max_by(F.struct("root", "leader"), F.struct("count", "root")).alias("of"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    return at.join(groups.select("shingle", F.col("of.root").alias("greatest"), F.col("of.leader").alias("leader")).hint("merge"), "shingle")


def differing_bits(bits: str, others: str) -> Column:
    return reduce(add, [F.bit_count(F.col(bits)[k].bitwiseXOR(F.col(others)[k])) for k in range(PARITY)])


def bridges(cells: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """a, b: texts alike whose roots differ, of which one is drawn in a cell of shingles from its greatest group.

    A text meets one other a cell, so rows grow in proportion to the texts' first shingles.
    """
    asks = split_cells(cells, roots, seed).filter("root <> greatest").groupBy("node").agg(F.collect_set("leader").alias("leaders"))
    met = asks.join(nodes.select("node", "sift"), "node").select("node", "sift", F.explode("leaders").alias("leader"))
    met = met.join(nodes.select(F.col("node").alias("leader"), F.col("sift").alias("l_sift")), "leader")
    met = met.filter(F.bit_count(F.col("sift").bitwiseXOR(F.col("l_sift"))) <= SIFT_MOST).select("node", "leader")
    met = met.join(nodes.select("node", "n", "bits"), "node").join(nodes.select(F.col("node").alias("leader"), F.col("n").alias("l_n"), F.col("bits").alias("l_bits")), "leader")
    differ = differing_bits("bits", "l_bits")
    near = met.filter(differ <= _most_differ(F.col("n") + F.col("l_n"))).groupBy("node").agg(F.collect_set(F.struct(differ.alias("d"), F.col("leader").alias("b"))).alias("near"))
    return _alike(nearest(near), sets)


def meetings(cells: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: every pair of texts whose roots differ and that may be alike, by the first shingles, sizes and parity bits. Some twice."""
    at = split_cells(cells, roots).select("shingle", "node", "root", "place", "short", (F.col("root") == F.col("greatest")).alias("main"))
    last = Window.partitionBy("node").orderBy("place").rowsBetween(-BEFORE, -1)
    at = at.withColumn("before", F.collect_list("shingle").over(last)).drop("place")
    bits = [f"b{k}" for k in range(PARITY)]
    at = stored(at.join(nodes.select("node", "n", *[F.col("bits")[k].alias(b) for k, b in enumerate(bits)]), "node"), "postings")
    asks = at.filter("not main").select("shingle", *[F.col(c).alias(f"a_{c}") for c in ["node", "root", "n", "short", "before", *bits]])
    small, large = F.least("n", "a_n"), F.greatest("n", "a_n")
    fits = (F.col("root") != F.col("a_root")) & (F.col("main") | (F.col("node") > F.col("a_node"))) & (small >= ALIKE * large - 1e-9)
    shared = F.when(F.col("n") < F.col("a_n"), F.col("short")).when(F.col("n") > F.col("a_n"), F.col("a_short")).otherwise(F.col("short") & F.col("a_short"))
    differ = reduce(add, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"a_{b}"))) for b in bits])
    # Of the cells in which a pair is compared, the first has none of them before it.
    first = ~F.arrays_overlap("before", "a_before")
    found = asks.join(at, "shingle").filter(fits & shared & (differ <= _most_differ(small + large)) & first)
    return found.select(F.least("node", "a_node").alias("a"), F.greatest("node", "a_node").alias("b"))


def links_across(cells: DataFrame, sets: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: every pair of texts alike whose roots differ. ``nodes`` has the parity bits, tally and number of shingles."""
    pairs = stored(meetings(cells, nodes, roots).distinct(), "meetings")
    some = _asked_for(nodes.select("node", F.struct("n", "tally").alias("has")), pairs)
    near = _sides(pairs, stored(some, "tallies"), "has").filter(tallies_apart("p.tally", "q.tally") <= _most_differ(F.col("p.n") + F.col("q.n")))
    return _alike(near.select("a", "b"), sets)


def nearest(near: DataFrame) -> DataFrame:
    """a, b: each node with the first of ``near``, which are its distance and the other node."""
    pairs = near.select("node", F.explode(F.slice(F.sort_array("near"), 1, NEAREST)).alias("p"))
    return pairs.select(F.least("node", "p.b").alias("a"), F.greatest("node", "p.b").alias("b")).distinct()


def leader_links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: texts alike of which one is a leader of a cell of the grid."""
    at = nodes.select("node", F.posexplode("cells").alias("part", "cell"))
    # Nodes are hashes, so the least one after a flip of bits is drawn at random, and the flip gives it back.
    flips = [F.xxhash64("part", F.lit(k)) for k in range(LEADERS)]
    least = [F.min(F.col("node").bitwiseXOR(f)).alias(f"l{k}") for k, f in enumerate(flips)]
    leaders = at.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), *least).filter("n > 1")
    leaders = leaders.select("part", "cell", F.array_distinct(F.array(*[F.col(f"l{k}").bitwiseXOR(f) for k, f in enumerate(flips)])).alias("leaders"))
    met = at.join(leaders, ["part", "cell"]).select("node", F.explode("leaders").alias("leader")).filter("node <> leader").distinct()
    known = nodes.select("node", "sift")
    met = met.join(known, "node").join(known.select(F.col("node").alias("leader"), F.col("sift").alias("l_sift")), "leader")
    differ = F.bit_count(F.col("sift").bitwiseXOR(F.col("l_sift")))
    near = met.filter(differ <= SIFT_MOST).groupBy("node").agg(F.collect_set(F.struct(differ.alias("d"), F.col("leader").alias("b"))).alias("near"))  # a few a part
    return _alike(nearest(near), sets)


def similar_groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_key and root, the same for all texts linked by a likeness of 0.8 and more.

    Texts of the same shingles are one node. The links are all there are:
    leaders only spare the exact join the pairs within a group.
    """
    texts = docs.count()
    made = long_fingerprints(*grid(texts))("text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), made.alias("f"))
    rows = stored(rows.select("doc_id", "text_key", F.xxhash64("f.shingles").alias("node"), "f.*"), "long-fingerprints")
    size = (F.octet_length("shingles") / 4).cast("int")
    nodes = stored(rows.withColumn("n", size).groupBy("node").agg(*[F.first(c).alias(c) for c in ("cells", "sift", "bits", "tally", "n")]), "nodes")
    sets = rows.select("node", "shingles")
    links = leader_links(nodes, sets)
    roots = stored(components(links), "roots")
    cells = shared_cells(sets, common_shingles(sets, texts))
    found, k = texts, 0
    while found and found * WORTH_A_ROUND >= texts:
        more = bridges(cells, nodes, sets, roots, k)
        found, k = more.count(), k + 1
        links = links.union(more)
        roots = stored(components(links), "roots") if found else roots
    links = links.union(links_across(cells, sets, nodes, roots))
    roots = stored(components(links), "roots")
    return rows.join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of texts alike stays, the one with the smallest id; all columns as they were."""
    groups = stored(similar_groups(docs), "near-groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    chosen = groups.groupBy("root").agg(F.min(order).alias("o")).select("o.doc_id", F.col("o.text_key").alias("key"))
    match = groups["doc_id"].eqNullSafe(chosen["doc_id"]) & (groups["text_key"] == chosen["key"])
    times = groups.join(chosen, match).groupBy(chosen["doc_id"], chosen["key"]).agg(F.count(F.lit(1)).alias("times"))
    return keep_rows(docs, F.xxhash64("text"), stored(times, "kept"))
