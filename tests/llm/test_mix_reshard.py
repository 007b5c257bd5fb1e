import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, documents, prose
from tidemark.llm import mixing, resharding


def water(sizes, weights, share=1.5, most=2.0):
    """Targets by dealing the excess again until none is above."""
    got = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        per = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in sorted(open_):
            got[s] += per * weights[s]
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                open_.discard(s)
    return got


def test_targets(spark):
    sizes = {"a": 10, "b": 500, "c": 90, "d": 2, "e": 700, "ÿ": 40}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()] + [(None, 30)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    order = sorted(sizes) + ["~null"]
    want = water({**sizes, "~null": 30}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    want[None] = want.pop("~null")
    assert got == pytest.approx(want)


def test_flight_keeps_totals():
    rng = random.Random(2)
    size = sorted((rng.randrange(0, 900) for _ in range(300)), reverse=True)
    pi = [rng.random() for _ in size]
    done = mixing.fly(size, pi, (rng.random() for _ in range(2000)))
    assert sum(0 < p < 1 for p in done) <= 2
    assert sum(done) == pytest.approx(sum(pi), abs=1e-4) and sum(s * p for s, p in zip(size, done)) == pytest.approx(sum(s * p for s, p in zip(size, pi)), abs=1e-2)


def test_flight_keeps_probabilities():
    rng = random.Random(4)
    pi, size, hits = [0.2, 0.5, 0.7, 0.4, 0.6], [5, 3, 8, 1, 2], [0.0] * 5
    for _ in range(4000):
        for i, p in enumerate(mixing.fly(size, pi, (rng.random() for _ in range(40)))):
            hits[i] += p
    assert [h / 4000 for h in hits] == pytest.approx(pi, abs=0.03)


@pytest.mark.parametrize("size, pi", [([40, 31, 31, 17, 12, 9, 5, 3, 3, 1, 1, 1], 0.4), ([7, 7, 7, 7], 0.5), ([100, 1, 1], 0.7), ([500] + [9, 8, 7, 6, 5] * 12, 0.25)])
def test_probabilities_are_kept_through_the_landing(size, pi):
    hits, miss = [0.0] * len(size), []
    for seed in range(3000):
        done = mixing.fly_block(size, np.full(len(size), pi), np.random.default_rng(seed).random(2 * len(size) + 8), mixing.LANDING, True)
        assert set(done) <= {0.0, 1.0}
        hits = [h + p for h, p in zip(hits, done)]
        miss.append(abs(sum(s * p for s, p in zip(size, done)) - pi * sum(size)))
    assert [h / 3000 for h in hits] == pytest.approx([pi] * len(size), abs=0.04)
    assert sum(miss) / 3000 <= max(size)


def test_cheapest_design_is_one_and_no_dearer():
    rng = np.random.default_rng(3)
    for m in (1, 3, 6):
        pi, cost = rng.random(m), rng.random(1 << m)
        subsets, chance = mixing.cheapest_design(pi, cost)
        assert chance.sum() == pytest.approx(1) and [sum(c for s, c in zip(subsets, chance) if s >> i & 1) for i in range(m)] == pytest.approx(list(pi))
        for _ in range(200):
            # Another design: one uniform draw for all units, taken from below or from above.
            above = rng.random(m) < 0.5
            ends = sorted([0.0, 1.0, *np.where(above, 1 - pi, pi)])
            other = sum((b - a) * cost[sum(1 << i for i in range(m) if (mid >= 1 - pi[i] if above[i] else mid < pi[i]))] for a, b in zip(ends, ends[1:]) for mid in [(a + b) / 2])
            assert chance @ cost[subsets] <= other + 1e-9


def test_mix_of_hot_repeated_rows(spark):
    docs = [(None, "five words are in here", "en", "hot")] * 3000 + [(i, "a b c", "en", "b") for i in range(200)]
    df = documents(spark, docs)
    runs = [sorted((r["doc_id"] or -1, r["copies"]) for r in mixing.mix(part).collect()) for part in (df, df.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 3200
    got, out = mixing.mix(df), mixing.mixed(df)
    per = {r["source"]: (r["t"], r["w"]) for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("w")).collect()}
    assert all(abs(t - w) <= 6 for t, w in per.values()) and out.count() == got.agg(F.sum("copies")).first()[0]


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice(["hot"] * 4 + ["b", "c", None])) for i in range(900)]
    docs += [(900 + i, None if i % 2 else "", "en", "b") for i in range(6)]
    df = documents(spark, docs)
    sized = df.select("doc_id", "source", mixing.word_count(F.coalesce("text", F.lit(""))).alias("size"))
    targets = mixing.source_targets(sized)
    runs = [sorted((r["doc_id"], r["copies"]) for r in mixing.cube_copies(part, targets, block=64).collect()) for part in (sized, sized.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == len(docs)
    got = mixing.mix(df).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 60
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)


def test_very_long_documents_beside_a_large_source(spark):
    rng = random.Random(8)
    sizes = {"large": [rng.randrange(5, 60) for _ in range(2500)], "small": [rng.randrange(5, 30) for _ in range(300)] + [2500], "two": [rng.randrange(5, 30) for _ in range(3000)] + [20000, 9000]}
    sized = spark.createDataFrame([(i, s, n) for s, v in sizes.items() for i, n in enumerate(v)], "doc_id long, source string, size long")
    share = {"large": 1.5, "small": 1.5, "two": 0.45}
    targets = spark.createDataFrame([(s, len(v), sum(v), share[s] * sum(v)) for s, v in sizes.items()], "source string, n long, source_size long, target double")
    for seed in (1, 2, 3):
        got = mixing.cube_copies(sized, targets, seed=seed)
        assert got.count() == sized.count()
        for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"), F.min("copies").alias("least"), F.max("copies").alias("most")).collect():
            floor = int(share[r["source"]])
            assert abs(r["words"] - share[r["source"]] * sum(sizes[r["source"]])) <= 5 and floor <= r["least"] <= r["most"] <= floor + 1


def test_long_documents_keep_probabilities():
    rng = random.Random(9)
    hits, after = [0.0] * 3, 0.0
    for _ in range(4000):
        taken, p = mixing.decide_long([90, 60, 30], 0.4, 600.0, [rng.random() for _ in range(3)])
        assert p * 420 + sum(k * s for k, s in zip(taken, [90, 60, 30])) == pytest.approx(240)
        hits, after = [h + k for h, k in zip(hits, taken)], after + p
    assert [h / 4000 for h in hits] == pytest.approx([0.4] * 3, abs=0.03) and after / 4000 == pytest.approx(0.4, abs=0.01)


def test_mix_of_awkward_rows(spark):
    df = documents(spark, awkward())
    got = mixing.mix(df)
    assert got.count() == df.count() and mixing.mixed(df).count() == got.agg(F.sum("copies")).first()[0]


def brute_cost(supply, room):
    return sum(max(0, s - (room[i] if i < len(room) else 0)) for i, s in enumerate(supply))


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(6)
    for _ in range(50):
        m, n = rng.randrange(1, 6), rng.randrange(1, 7)
        supply = [rng.randrange(0, 90) for _ in range(m)]
        room = resharding.even_rooms([rng.randrange(0, 20) for _ in range(n)], sum(supply))
        flow = resharding.min_cost_flow(supply, room)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(m)] == supply
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(n)] == room
        assert sum(v for (i, j), v in flow.items() if i != j) == brute_cost(supply, room)


def test_flow_with_costs():
    cost = {(0, 0): 4, (0, 1): 1, (1, 0): 2, (1, 1): 3}
    flow = resharding.min_cost_flow([5, 5], [5, 5], lambda i, j: cost[i, j])
    assert flow == {(0, 1): 5, (1, 0): 5}


def check_shards(rows, docs, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    have = sorted((r["doc_id"] or -1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert have == sorted((d[0] or -1, zlib.crc32((d[1] or "").encode())) for d in docs)


def test_reshard_balances_bytes(spark):
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randrange(1, 40)), "en", "s") for i in range(1500)]
    df = documents(spark, docs).withColumn("old", F.pmod("doc_id", F.lit(5)).cast("int"))
    for how in (512, 50):
        plan = resharding.plan_reshard(df, "old", 8, block_docs=how)
        rows = resharding.assign(df, "old", plan).collect()
        check_shards(rows, docs, 8)
        size = defaultdict(int)
        for r in rows:
            size[r["shard"]] += len((r["text"] or "").encode()) + 8
        assert max(size.values()) < 1.1 * sum(size.values()) / 8 and min(size.values()) > 0.9 * sum(size.values()) / 8


def shard_bytes(rows):
    size = defaultdict(int)
    for r in rows:
        size[r["shard"]] += len((r["text"] or "").encode()) + 8
    return size


@pytest.mark.parametrize("large", [0, 12, 200])
def test_reshard_moves_the_fewest_bytes_with_large_documents(spark, large):
    rng = random.Random(large)
    docs = [(i, "y" * rng.randrange(1, 200), "en", "s") for i in range(900)] + [(900 + i, "z" * rng.randrange(1000, 4000), "en", "s") for i in range(large)]
    df = documents(spark, docs).withColumn("old", F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int"))
    plan = resharding.plan_reshard(df, "old", 6)
    rows = resharding.assign(df, "old", plan).collect()
    check_shards(rows, docs, 6)
    size, biggest = shard_bytes(rows), max(len(d[1]) + 8 for d in docs)
    supply = [sum(len(r["text"]) + 8 for r in rows if r["old"] == i) for i in range(4)]
    level = sum(supply) / 6
    moved = sum(len(r["text"]) + 8 for r in rows if r["old"] != r["shard"])
    # A cut is off by half a document at most, and there are old shards + new shards of them at most.
    assert abs(moved - sum(max(0, s - level) for s in supply)) <= 10 * (biggest if large else 208)
    assert max(size.values()) - min(size.values()) <= (2 * biggest if large > 100 else 900)


def test_reshard_splits_alike_rows_and_takes_any_null(spark, monkeypatch):
    monkeypatch.setattr(resharding, "_RUN", 7)
    docs = [(None, "same text of a row that is there very often", "en", "s")] * 400 + [(5, None, "en", "s")] * 3 + [(i, "other" * i, "en", "s") for i in range(20)]
    df = documents(spark, docs).withColumn("old", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(1).cast("int"))
    rows = resharding.reshard(df.repartition(5), "old", 4).collect()
    check_shards(rows, docs, 4)
    size = shard_bytes(rows)
    assert len(size) == 4 and max(size.values()) - min(size.values()) <= 250


def test_reshard_very_long_text(spark):
    docs = [(i, "short text" * (i % 9), "en", "s") for i in range(200)] + [(200, "long " * 4_000_000, "en", "s")]
    df = documents(spark, docs).withColumn("old", F.pmod("doc_id", F.lit(2)).cast("int"))
    rows = resharding.reshard(df, "old", 3).withColumn("n", F.length("text")).drop("text").withColumn("text", F.lit("")).collect()
    assert sorted(r["n"] for r in rows) == sorted(len(d[1]) for d in docs) and {r["shard"] for r in rows} == {0, 1, 2}


def test_reshard_rewrites_only_affected_shards(spark):
    docs = [(i, "x" * 50, "en", "s") for i in range(300)]
    # Shards 0 and 1 have what they should, 2 has all of 3's.
    df = documents(spark, docs).withColumn("old", F.when(F.col("doc_id") < 75, 0).when(F.col("doc_id") < 150, 1).otherwise(2))
    plan = resharding.plan_reshard(df, "old", 4)
    assert plan.touched == [2, 3] and plan.untouched == [0, 1]
    rows = resharding.reshard(df, "old", 4).collect()
    check_shards(rows, docs, 4)
    assert all(r["shard"] == r["old"] for r in rows if r["old"] < 2)


def test_reshard_awkward_and_empty(spark):
    df = documents(spark, awkward()).withColumn("old", F.lit(0))
    check_shards(resharding.reshard(df, "old", 3).collect(), awkward(), 3)
    assert resharding.reshard(spark.createDataFrame([], DOCS).withColumn("old", F.lit(0)), "old", 3).count() == 0


def test_empty_mix(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0
