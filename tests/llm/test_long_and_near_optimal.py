"""Very long texts through whole operators, and results held close to the best there is."""

import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.helpers import documents, prose
from tidemark.llm import bpe, exact_dedup, mixing, queries, resharding, simhash, warc

SF = "/root/testdata/sf0.01"


def long_text(rng, n=1_500_000):
    some = prose(rng, 20_000)
    return (some + "\n") * (n // len(some) + 1)


def test_long_texts_through_exact_dedup_and_simhash(spark):
    rng = random.Random(1)
    long = long_text(rng)
    docs = [(1, long, "en", "s"), (2, long.upper(), "en", "s"), (3, long[:-1] + "x", "en", "s"), (4, "z" * 2_000_000, "en", "s"), (5, "z" * 2_000_001, "en", "s"), (6, "short", "en", "s")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(documents(spark, docs)).collect()}
    assert [got[i]["keep_id"] for i in range(1, 7)] == [2, 2, 3, 4, 5, 6]
    assert got[1]["text_sha256"] == hashlib.sha256(long.lower().encode()).hexdigest()
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(documents(spark, docs)).collect()}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[6] == 6
    roots = {r["doc_id"]: r["root"] for r in simhash.similar_groups(documents(spark, docs)).collect()}
    assert roots[1] == roots[2] == roots[3] and len({roots[i] for i in (1, 4, 5, 6)}) == 4


def test_a_long_text_through_the_tokenizer(spark):
    text = long_text(random.Random(2)) + "x" * 300_000
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    r = bpe.round_trip(documents(spark, [(1, text, "en", "s")]), vocabulary, public_tokenizers.PATTERN).first()
    ids = bpe.encoder(vocabulary, public_tokenizers.PATTERN).encode_ordinary(text)
    assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_long_pages_through_archives(spark, tmp_path):
    html = "<p>" + long_text(random.Random(3), 6_000_000) + "</p>"
    rows = [(1, "u", html, "clash", 5), (2, "v", html, "clash", 6), (3, "w", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, payload_bytes int")
    got = {r["page_id"]: r for r in warc.read_indexed(warc.write_archives(df, f"file://{tmp_path}/warc")[1]).collect()}
    assert [(got[i]["payload_bytes"], got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3)] == [(len(html.encode()), "response", None), (len(html.encode()), "revisit", 1), (0, "response", None)]
    assert got[1]["payload_digest"] == got[2]["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()


def test_resharding_is_near_the_optimum_on_a_table(spark):
    docs = queries.table(spark, SF, "documents").withColumn("old_shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    plan = resharding.plan_reshard(docs, "old_shard", 24)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    rows = resharding.assign(docs, "old_shard", plan).select("old_shard", "shard", size.alias("size")).toPandas()
    level = rows["size"].sum() / 24
    supply = rows.groupby("old_shard")["size"].sum()
    best = (supply - level).clip(lower=0).sum()
    moved = rows.loc[rows["old_shard"] != rows["shard"], "size"].sum()
    shards = rows.groupby("shard")["size"].sum()
    assert abs(moved / best - 1) <= 0.01 and len(shards) == 24 and abs(shards / level - 1).max() <= 0.02


def test_the_mix_is_near_its_targets_on_a_table(spark):
    docs = queries.table(spark, SF, "documents")
    rows = mixing.mix(docs).toPandas()
    rows["taken"] = rows["copies"] * rows["size"]
    by = rows.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "max"), size=("size", "sum"))
    miss = abs(by["taken"] / by["target"] - 1)
    assert miss.mean() <= 0.015 and miss.max() <= 0.08 and abs(by["taken"].sum() / (1.5 * by["size"].sum()) - 1) <= 0.005
