"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe, exact_dedup, filter_audit, fingerprints, html_text, langid, mixing, quality, resharding, secrets, simhash, warc
from tidemark.llm.common import table, text_or_empty

SHARDS, OLD_SHARDS = 24, 16
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ALIGNED_A, ALIGNED_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by a hash of doc_id to 24 of equal bytes; the rows are read from the shards written."""
    docs = table(spark, sf_dir, "documents").withColumn("old_shard", F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)).cast("int"))
    rows = resharding.reshard(docs, "old_shard", SHARDS)
    text = text_or_empty("text")
    return rows.select("doc_id", (F.octet_length(text).cast("long") + resharding.ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_warc_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_indexed(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(ALIGNED_A), public_tokenizers.path(ALIGNED_B))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_cube_mix, op2_flow_reshard, op3_weighted_fingerprints, op4_simhash_groups, op5_secret_spans, op6_main_text, op7_bpe_round_trip, op8_language_id, op9_chunk_dedup, op10_warc_normalised, op11_token_alignment, op12_filter_audit, op13_quality_forest)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op9_chunk_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWERED} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm),
             r AS (SELECT doc_id, norm, row_number() OVER (PARTITION BY norm, doc_id) AS nth FROM d)
        SELECT r.doc_id, g.keep_id, g.group_size,
               (r.doc_id IS NOT DISTINCT FROM g.keep_id) AND r.nth = 1 AS kept,
               sha256(r.norm) AS text_sha256
        FROM r JOIN g ON r.norm = g.norm""",
    "op10_warc_normalised": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {warc.LEAST_REVISIT} GROUP BY payload_digest),
             j AS (SELECT p.*, CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
                   FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
        FROM j""",
    "op12_filter_audit": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
             least AS (SELECT text, min(doc_id) AS least_id FROM d GROUP BY text),
             l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
             bits AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                        CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
                        + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
                        + CASE WHEN 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 4 ELSE 0 END
                        + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
                        + CASE WHEN d.doc_id > least.least_id THEN 16 ELSE 0 END AS failed
                      FROM d JOIN least ON d.text = least.text LEFT JOIN l ON d.doc_id = l.doc_id),
             sets AS (SELECT part, failed, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY part, failed),
             letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
             grown(word, mask) AS (SELECT '', 0 UNION ALL SELECT word || letter, mask + bit FROM grown, letters WHERE mask & bit = 0),
             steps AS (SELECT w.word AS filter_order, k AS step, l.bit,
                         (SELECT coalesce(sum(e.bit), 0) FROM letters e WHERE position(e.letter IN w.word) < k)::INTEGER AS earlier
                       FROM grown w, range(1, 6) s(k), letters l WHERE w.mask = 31 AND l.letter = substr(w.word, k::INTEGER, 1)),
             counted AS (SELECT part, filter_order, step::INTEGER AS step, bit,
                           sum(CASE WHEN failed & (earlier | bit) = 0 THEN docs ELSE 0 END) AS kept,
                           sum(CASE WHEN failed & bit <> 0 AND failed & earlier = 0 THEN docs ELSE 0 END) AS removed,
                           sum(CASE WHEN failed & bit <> 0 AND failed & earlier <> 0 THEN docs ELSE 0 END) AS redundant,
                           sum(CASE WHEN failed = bit THEN docs ELSE 0 END) AS unique_fails,
                           sum(CASE WHEN failed & bit <> 0 AND failed & earlier = 0 THEN good ELSE 0 END) AS good_lost,
                           sum(CASE WHEN failed & bit <> 0 AND failed & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
                         FROM sets, steps GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM counted""",
}
