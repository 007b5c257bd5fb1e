import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, documents, prose
from tidemark.llm import exact_dedup, simhash


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups_equal_brute_force(spark):
    docs = awkward()
    groups = defaultdict(list)
    for d in docs:
        groups[lowered(d[1])].append(d[0])
    got = exact_dedup.exact_groups(documents(spark, docs)).collect()
    want, have = defaultdict(list), defaultdict(list)
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[hashlib.sha256(text.encode()).hexdigest()].append((i, keep, len(ids)))
    for r in got:
        have[r["text_sha256"]].append((r["doc_id"], r["keep_id"], r["group_size"]))
    key = lambda x: [(a is None, a or 0, b or 0, c) for a, b, c in x]
    assert {k: sorted(key(v)) for k, v in have.items()} == {k: sorted(key(v)) for k, v in want.items()}
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_hot_repeated_rows_leave_one(spark):
    docs = [(None, "the same row", "en", "s")] * 300 + [(3, None, "en", "s")] * 200 + [(4, "THE same row", "en", "s")] * 5 + [(5, "x", "en", "s")]
    got = exact_dedup.exact_groups(documents(spark, docs).repartition(7)).collect()
    assert len(got) == len(docs)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]) == [(3, 3, 200), (4, 4, 305), (5, 5, 1)]
    assert exact_dedup.drop_exact_copies(documents(spark, docs)).count() == 3


def test_exact_pipeline_form_keeps_one_of_each(spark):
    docs = documents(spark, awkward())
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    texts = [lowered(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({lowered(d[1]) for d in awkward()})


def test_chunks_join_to_the_text_and_shift(spark):
    rng = random.Random(1)
    text = ". ".join(prose(rng, 30) for _ in range(60))
    df = spark.createDataFrame([(text,), ("Intro. " + text,), ("",)], "t string").select(exact_dedup.chunks_of(F.col("t")).alias("c"))
    a, b, c = (r["c"] for r in df.collect())
    assert "".join(a) == text and "".join(b) == "Intro. " + text and c == []
    assert len(set(a) & set(b)) > len(a) // 2 and max(map(len, a)) <= exact_dedup.CHUNK_MAX


def test_colliding_identifiers_are_drawn_anew(spark):
    make = lambda c, seed: F.length(c).cast("long") if seed < 2 else F.xxhash64(c)
    chunks = spark.createDataFrame([("ab",), ("cd",), ("ab",)], "chunk string")
    assert exact_dedup.verified_seed(chunks, make) == 2


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for _, text, _, _ in awkward():
        assert simhash.simhash(text) == brute_fingerprint(text)
    one = spark.range(1).select(F.xxhash64(F.lit("the quick fox"))).first()[0]
    assert simhash.simhash("The quick  FOX") == one % 2**64


def near(fps):
    return {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if 0 < (a ^ b).bit_count() <= 3}


def test_links_are_all_and_only_the_near(spark):
    rng = random.Random(7)
    fps = {0, 2**64 - 1, 7, 2**63}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(0, 4)):
                x ^= 1 << b
    signed = {x: x - 2**64 if x >= 2**63 else x for x in fps}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long")).collect()
    want = {tuple(sorted((signed[a], signed[b]))) for a, b in near(sorted(fps))}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_near_groups_equal_brute_force(spark):
    docs = awkward()
    rng = random.Random(9)
    long = prose(rng, 900)
    docs += [(100 + i, long.replace(" ", "  ", i) + (" more" if i > 2 else ""), "en", "s") for i in range(6)]
    got = simhash.near_groups(documents(spark, docs)).collect()
    fps = [brute_fingerprint(d[1]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[find(i)].append(d[0])
    want = sorted((d[0] or -1, fps[i], min(least[find(i)], default=None)) for i, d in enumerate(docs))
    assert sorted((r["doc_id"] or -1, r["fp"] % 2**64, r["component_id"]) for r in got) == [(a if a else -1, b, c) for a, b, c in want]
    kept = simhash.drop_near_copies(documents(spark, docs))
    assert kept.count() == len({find(i) for i in range(len(docs))}) and kept.columns == documents(spark, docs).columns


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, exact_dedup.drop_exact_copies, simhash.near_groups, simhash.drop_near_copies])
def test_empty(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0
