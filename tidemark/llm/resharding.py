"""Minimum-cost-flow resharding: new shards of near equal bytes, the fewest bytes moved.

Old shard sizes and new capacities form a small transport problem: a byte
that stays in its shard costs nothing, one that moves costs 1 (or what the
caller's cost function says). Successive shortest paths solve it on the
driver, over shards alone. The flows are then cut into block transfers: an old
shard is a line of blocks, the flows are stretches of it (what stays comes
first), and a block goes where its stretch goes. A document that is large
against a new shard is a block of its own, the largest at the line's
beginning; all others lie in hashed blocks behind them. Where the large ones
end up decides the room that is left, for which the flow of the others is
solved again, so that small documents make up for where a large one was cut
off. Only the few blocks at a stretch's end are cut between documents. At last
the affected shards are rewritten, each with gapless slots.

Defined cases: null text counts no bytes besides the fixed 8 and stays null;
rows alike in id, size and checksum are told apart by an ordinal and may go
to different shards; a null id is an id like any other and a null old shard
is shard 0; an empty table gives empty shards; further columns travel with their rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import all_ordinals, stored, text_or_empty, with_ordinals
from tidemark.scratch import new_folder

#: Bytes of a row besides its text.
ROW_BYTES = 8
#: A document above this part of a shard is a block of its own: new shards times this many at most.
HEAVY_PART = 64
#: Documents of a block on average; blocks of an old shard at most.
BLOCK_DOCS, MOST_BLOCKS = 512, 1 << 16
#: Ordinals of alike rows that one task makes.
_RUN = 100_000


def stay_or_move(old: int, new: int) -> float:
    return 0.0 if old == new else 1.0


def min_cost_flow(supply: Sequence[int], room: Sequence[int], cost: Callable[[int, int], float] = stay_or_move) -> dict[tuple[int, int], int]:
    """Cheapest flow of all ``supply`` into ``room`` (equal sums), as {(old, new): bytes}.

    Successive shortest paths on the bipartite residual graph; the graph has
    a node a shard, whatever the data's size.
    """
    m, n = len(supply), len(room)
    left, free, flow = list(supply), list(room), {}
    price = {(i, j): cost(i, j) for i in range(m) for j in range(n)}
    while any(left):
        # Bellman-Ford from every old shard with bytes left to a new one with room left.
        far = [0.0 if x else math.inf for x in left] + [math.inf] * n
        came: list[int | None] = [None] * (m + n)
        changed = True
        while changed:
            changed = False
            for (i, j), c in price.items():
                if far[i] + c < far[m + j] - 1e-12:
                    far[m + j], came[m + j], changed = far[i] + c, i, True
                if flow.get((i, j)) and far[m + j] - c < far[i] - 1e-12:
                    far[i], came[i], changed = far[m + j] - c, m + j, True
        end = min((j for j in range(n) if free[j]), key=lambda j: (far[m + j], j))
        path = [m + end]
        while (before := came[path[-1]]) is not None:
            path.append(before)
        path.reverse()
        edges = list(zip(path, path[1:], strict=False))
        amount = min([left[path[0]], free[end], *(flow[b, a - m] for a, b in edges if a >= m)])
        for a, b in edges:
            if a < m:
                flow[a, b - m] = flow.get((a, b - m), 0) + amount
            else:
                flow[b, a - m] -= amount
        left[path[0]] -= amount
        free[end] -= amount
    return {k: v for k, v in flow.items() if v}


def even_rooms(loads: Sequence[int], extra: int) -> list[int]:
    """Room of every shard so that ``extra`` bytes fill the lowest loads to one level."""
    low, high = 0, max(loads, default=0) + extra
    while low < high:
        level = (low + high) // 2
        low, high = (low, level) if sum(max(0, level - x) for x in loads) >= extra else (level + 1, high)
    rooms = [max(0, low - x) for x in loads]
    over = sum(rooms) - extra
    for j in range(len(rooms)):
        cut = min(over, 1, rooms[j])
        rooms[j] -= cut
        over -= cut
    return rooms


@dataclass
class Plan:
    """pieces: __old, __block, shard, lo, hi, n, first_slot; one row for a run of documents that go one way.

    Block -1 has the large documents, a piece each. ``alike`` has __old and
    __h of rows that only an ordinal tells apart.
    """

    pieces: DataFrame
    alike: DataFrame
    heavy_above: int
    n_blocks: int
    flow: dict[tuple[int, int], int]
    touched: list[int]
    untouched: list[int]


def _keyed(docs: DataFrame, old_shard: str) -> DataFrame:
    text = text_or_empty("text")
    size = F.octet_length(text).cast("long") + ROW_BYTES
    return docs.withColumn("__old", F.coalesce(F.col(old_shard).cast("int"), F.lit(0))).withColumn("__size", size).withColumn("__h", F.xxhash64("doc_id", "__size", F.crc32(text.cast("binary"))))


def _told_apart(ordinal: Column) -> Column:
    return F.xxhash64("__h", "__size", ordinal.cast("long"))


def _all_apart(counted: DataFrame) -> DataFrame:
    """__old, __size, __h for every row that ``counted`` (.., n) counts."""
    return all_ordinals(counted, "ordinal", _RUN).withColumn("__h", _told_apart(F.col("ordinal"))).drop("ordinal")


def _apart(rows: DataFrame) -> DataFrame:
    """Alike rows with their own __h."""
    return with_ordinals(rows, ["__old", "__h", "__size"], "__ordinal").withColumn("__h", _told_apart(F.col("__ordinal"))).drop("__ordinal")


def _stretches(flow: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int, int]]]:
    """The flow as stretches (new shard, start, stop) of every old shard's line; what stays comes first."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i, j in sorted(flow, key=lambda e: (e[0], e[0] != e[1], e[1])):
        at = out[i][-1][2] if i in out else 0
        out.setdefault(i, []).append((j, at, at + flow[i, j]))
    return out


def place_heavy(heavy: Sequence[tuple[int, int, int]], flow: dict[tuple[int, int], int]) -> list[int]:
    """The new shard of every large document (old shard, hash, size), largest first, by its middle on the line."""
    at, lines, out = {}, _stretches(flow), []
    for old, _, size in heavy:
        middle = at.get(old, 0) + size / 2
        out.append(next(j for j, _, stop in lines[old] if middle <= stop))
        at[old] = at.get(old, 0) + size
    return out


def plan_reshard(docs: DataFrame, old_shard: str, shards: int, cost: Callable[[int, int], float] = stay_or_move, block_docs: int = BLOCK_DOCS) -> Plan:
    """Where every document goes. ``old_shard`` names a column of shard numbers from 0."""
    spark = docs.sparkSession
    sized = stored(_keyed(docs.select("doc_id", "text", F.col(old_shard)), old_shard).select("__old", "__size", "__h"), "shard-sizes")
    alike = stored(sized.groupBy("__old", "__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "alike")
    if not alike.isEmpty():
        counted = sized.join(alike, ["__old", "__h"], "left_semi").groupBy("__old", "__h", "__size").agg(F.count(F.lit(1)).alias("n"))
        sized = stored(sized.join(alike, ["__old", "__h"], "left_anti").unionByName(_all_apart(counted)), "shard-sizes")
    per = {r[0]: r[1:] for r in sized.groupBy("__old").agg(F.sum("__size"), F.count(F.lit(1))).collect()}  # a row a shard
    total, n_old = sum(x[0] for x in per.values()), max(per, default=-1) + 1
    supply = [per.get(i, (0, 0))[0] for i in range(n_old)]
    heavy_above = max(ROW_BYTES, total // shards // HEAVY_PART)
    # Each holds more than a HEAVY_PART-th of a shard, so there are shards * HEAVY_PART at most, whatever the data.
    heavy = sorted(((r["__old"], r["__h"], r["__size"]) for r in sized.filter(F.col("__size") > heavy_above).collect()), key=lambda r: (r[0], -r[2], r[1]))
    to = place_heavy(heavy, min_cost_flow(supply, even_rooms([0] * shards, total), cost))
    loads, light = [0] * shards, list(supply)
    for (old, _, size), j in zip(heavy, to, strict=True):
        loads[j] += size
        light[old] -= size
    flow = min_cost_flow(light, even_rooms(loads, sum(light)), cost)
    spans = [(i, j, a, b) for i, line in _stretches(flow).items() for j, a, b in line]
    spans_df = F.broadcast(spark.createDataFrame(spans, "__old int, shard int, start long, stop long"))  # old shards + new shards rows at most
    n_blocks = max(1, min(MOST_BLOCKS, math.ceil(max((x[1] for x in per.values()), default=0) / block_docs)))
    lit = sized.filter(F.col("__size") <= heavy_above).withColumn("__block", _block(n_blocks))
    blocks = lit.groupBy("__old", "__block").agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi"))
    before = F.sum("bytes").over(Window.partitionBy("__old").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = stored(blocks.withColumn("at", F.coalesce(before, F.lit(0))), "blocks")
    whole = blocks.join(spans_df, "__old").filter("at >= start and at + bytes <= stop")
    whole = stored(whole.select("__old", "__block", "shard", "lo", "hi", "n"), "whole-blocks")
    cut = blocks.join(whole.select("__old", "__block"), ["__old", "__block"], "left_anti").select("__old", "__block", "at")
    upto = F.sum("__size").over(Window.partitionBy("__old", "__block").orderBy("__h"))
    placed = lit.join(cut, ["__old", "__block"]).withColumn("middle", F.col("at") + upto - F.col("__size") / 2)
    placed = placed.join(spans_df, "__old").filter("middle >= start and middle < stop")
    parts = placed.groupBy("__old", "__block", "shard").agg(F.min("__h").alias("lo"), F.max("__h").alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = [(old, -1, j, h, h, 1) for (old, h, _), j in zip(heavy, to, strict=True)]
    pieces = whole.unionByName(parts.select(whole.columns)).union(spark.createDataFrame(rows, "__old int, __block long, shard int, lo long, hi long, n long"))
    slot = F.sum("n").over(Window.partitionBy("shard").orderBy("__old", "__block", "lo").rowsBetween(Window.unboundedPreceding, -1))
    pieces = stored(pieces.withColumn("first_slot", F.coalesce(slot, F.lit(0))), "pieces")
    ways = pieces.select("__old", "shard").distinct().collect()  # at most old shards x new shards
    touched = {x for r in ways if r["__old"] != r["shard"] for x in r}
    moved = dict(flow)
    for (old, _, size), j in zip(heavy, to, strict=True):
        moved[old, j] = moved.get((old, j), 0) + size
    return Plan(pieces, alike, heavy_above, n_blocks, moved, sorted(touched), sorted({r["shard"] for r in ways} - touched))


def _block(n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned("__h", 20), F.lit(n_blocks)).cast("long")


def assign(docs: DataFrame, old_shard: str, plan: Plan) -> DataFrame:
    """``docs`` with shard and slot (gapless from 0 in every shard)."""
    rows = _keyed(docs, old_shard)
    if not plan.alike.isEmpty():
        keys = ["__old", "__h"]
        rows = rows.join(plan.alike, keys, "left_anti").unionByName(_apart(rows.join(plan.alike, keys, "left_semi")))
    rows = rows.withColumn("__block", F.when(F.col("__size") > plan.heavy_above, -1).otherwise(_block(plan.n_blocks)).cast("long"))
    # A large document is its own join key, so that no key holds all of them.
    large = F.when(F.col("__block") == -1, F.col("__h")).otherwise(0)
    pieces = plan.pieces.drop("n").withColumn("__large", F.when(F.col("__block") == -1, F.col("lo")).otherwise(0))
    joined = rows.withColumn("__large", large).join(pieces, ["__old", "__block", "__large"]).filter("__h between lo and hi")
    nth = F.row_number().over(Window.partitionBy("__old", "__block", "shard", "lo").orderBy("__h"))
    return joined.withColumn("slot", F.col("first_slot") + nth - 1).select(*docs.columns, "shard", "slot")


def rewrite(docs: DataFrame, old_shard: str, plan: Plan, out_dir: str) -> DataFrame:
    """Writes every shard that gains or loses rows below ``out_dir`` and returns what was written.

    A shard that only keeps its rows has no file written.
    """
    rows = assign(docs, old_shard, plan)
    rows.filter(F.col("shard").isin(plan.touched)).write.partitionBy("shard").parquet(out_dir)
    return docs.sparkSession.read.schema(rows.drop("shard").schema.add("shard", T.IntegerType())).parquet(out_dir).select(rows.columns)


def reshard(docs: DataFrame, old_shard: str, shards: int, out_dir: str | None = None) -> DataFrame:
    """All rows in their new shards: those of rewritten shards from the new files, the rest as they lay."""
    plan = plan_reshard(docs, old_shard, shards)
    written = rewrite(docs, old_shard, plan, out_dir or new_folder(docs.sparkSession, "shards"))
    if plan.untouched:
        still = docs.filter(F.col(old_shard).isin(plan.untouched))
        written = written.union(assign(still, old_shard, plan).filter(F.col("shard").isin(plan.untouched)))
    return written
