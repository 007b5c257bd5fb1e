"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is its words with their counts as weights. For each of K samples every
word draws r and c from Gamma(2, 1) and b from [0, 1), all from its hash and
the sample's number; with t = floor(ln w / r + b) the word with the least
ln c - r (t + 1 - b) is taken, and the sample is a hash of the word and t.
Two texts agree in a sample with the probability of their generalised Jaccard
similarity, sum of the lesser over sum of the greater counts.

The edited texts need each document's neighbour by id. Ids and text hashes
are put in order first, and every 250th of them bounds a bucket, however the
ids are spread. Documents are then dealt once by bucket; neighbours, words,
counts and the least draws are all found within a bucket, without another
shuffle, and only a bucket's first text is sent to the one before it. Rows
alike in id and text go through once, with their number.

Defined cases: null text is the empty text; a text without words has all
samples -1 and is like another such text; a null id comes last, rows with
equal ids follow by the text's hash; a repeated row is followed by its twin;
the only row is its own neighbour; an empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_or_empty

#: Samples of a fingerprint; rows of a bucket and of a task on average; buckets and tasks at most.
SAMPLES, BUCKET_ROWS, TASK_ROWS, MOST_BUCKETS, MOST_TASKS = 32, 250, 1000, 1 << 18, 100_000
#: Rows that one task of the bounds' search puts in order.
SORT_ROWS = 500_000
_BITS = 21
_LOW = (1 << 32) - 1


def _uniform(h: Column, part: int) -> Column:
    """A number in (0, 1) from 21 of the hash's bits."""
    return (F.shiftrightunsigned(h, part * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)) + 0.5) * (1.0 / (1 << _BITS))


def draw(term: Column, log_weight: Column, number: int) -> Column:
    """One word's draw for one sample: the least wins; its low 32 bits are the sample."""
    one = F.xxhash64(term, F.lit(number))
    two = F.xxhash64(one)
    r = -F.log(_uniform(one, 0) * _uniform(one, 1))
    c = -F.log(_uniform(two, 0) * _uniform(two, 1))
    b = _uniform(two, 2)
    t = F.floor(log_weight / r + b)
    rank = F.log(c) - r * (t + 1 - b)
    # The rank with 22 bits after the point above the sample's bits; |rank| stays below 256.
    key = ((F.greatest(rank, F.lit(-255.0)) + 256) * (1 << 22)).cast("long")
    return F.shiftleft(key, 32).bitwiseOR(one.bitwiseXOR(t * 2654435761).bitwiseAND(F.lit(_LOW)))


_KEY = "struct<d:bigint,h:bigint>"


def bucket_bounds(keys: DataFrame, n: int, bucket_rows: int = BUCKET_ROWS, sort_rows: int = SORT_ROWS) -> list[tuple[int | None, int]]:
    """The least (id, hash) of every bucket but the first, in order: one each ``bucket_rows`` rows, MOST_BUCKETS at most."""
    step = max(bucket_rows, math.ceil(n / MOST_BUCKETS))
    ranged = keys.repartitionByRange(math.ceil(n / sort_rows), "doc_id", "h").withColumn("part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "h"))
    least = ranged.withColumn("nth", nth).filter((F.col("nth") - 1) % step == 0).select("doc_id", "h").distinct().collect()
    return sorted(((r["doc_id"], r["h"]) for r in least), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))[1:]


def bucket_of(doc_id: Column, h: Column, bounds: list[tuple[int | None, int]]) -> Column:
    """How many bounds are not above (id, hash), by halving; null ids are below all."""
    # Text that the optimizer turns into one constant array.
    table = F.from_json(F.lit(json.dumps([{"d": d, "h": x} for d, x in bounds])), f"array<{_KEY}>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]) if bounds else F.array().cast("array<int>")
    key = F.struct(doc_id.alias("d"), h.alias("h"))
    below = lambda at, step: (at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key)
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(below(at, step), F.lit(False)), step).otherwise(0))
    # Never null, so that no branch filters it and both of ``fingerprint_edits`` share one exchange.
    return F.coalesce(found, F.lit(0)).cast("long")


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """Rows (bucket, nth, doc_id, text, next_text, times), next by descending id, and the number of buckets.

    A bucket's last row is followed by the first of the bucket below, the
    lowest bucket by the highest. ``times`` rows are alike in id and text.
    """
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("h", F.xxhash64("text"))
    keys = stored(rows.select("doc_id", "h"), "keys")
    n = keys.count()
    again = stored(keys.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "repeated")
    rows = rows.withColumn("times", F.lit(1).cast("long"))
    if not again.isEmpty():
        a = again.toDF("__id", "__h", "__times")
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
        once = rows.join(a, same, "left_semi").groupBy("doc_id", "h").agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("times"))
        rows = rows.join(a, same, "left_anti").unionByName(once)
        keys = stored(keys.distinct(), "keys")
    bounds = bucket_bounds(keys, n, bucket_rows) if n else []
    bucket = bucket_of(F.col("doc_id"), F.col("h"), bounds)
    tops = keys.withColumn("bucket", bucket).groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").alias("d"), F.col("h").alias("h"))).alias("top"))
    above = F.when(F.col("bucket") == len(bounds), 0).otherwise(F.col("bucket") + 1).cast("long")
    tops = stored(tops.select(above.alias("__before"), F.col("top.d").alias("__d"), F.col("top.h").alias("__t")), "buckets")
    heads = rows.join(tops, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__t"))).select("__before", F.col("text").alias("head"))
    heads = stored(heads, "bucket-heads")
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    # A task's words have to fit its memory: tasks follow the rows, not the bytes of text.
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(MOST_TASKS, max(math.ceil(n / TASK_ROWS), min(math.ceil(n / 64), usual), 1))
    placed = rows.withColumn("bucket", bucket).repartition(tasks, "bucket").withColumn("nth", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))
    out = placed.join(heads, (F.col("bucket") == F.col("__before")) & F.col("next_text").isNull(), "left")
    return out.select("bucket", "nth", "doc_id", "text", F.coalesce("next_text", "head").alias("next_text"), "times"), len(bounds) + 1


def samples(texts: DataFrame, keys: list[str], count: int = SAMPLES) -> DataFrame:
    """keys and samples (array of ``count`` ints) for every row of ``texts`` with column text.

    Rows without words are missing. No shuffle where ``texts`` is dealt by one of the keys.
    """
    words = texts.select(*keys, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    weighted = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    weighted = weighted.select(*keys, "term", F.log(F.col("n").cast("double")).alias("log_n"))
    least = weighted.groupBy(*keys).agg(*[F.min(draw(F.col("term"), F.col("log_n"), k)).alias(f"s{k}") for k in range(count)])
    return least.select(*keys, F.array(*[F.shiftright(F.shiftleft(f"s{k}", 32), 32).cast("int") for k in range(count)]).alias("samples"))


def likeness(a: Column, b: Column, count: int = SAMPLES) -> Column:
    """The part of the samples in which two fingerprints agree."""
    same = [F.when(F.element_at(a, k + 1) == F.element_at(b, k + 1), 1).otherwise(0) for k in range(count)]
    return reduce(lambda x, y: x + y, same) / float(count)


def as_hex(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(_LOW))), 8, "0")), ""))


def fingerprint_edits(docs: DataFrame, count: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, buckets = with_next(docs)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    ends_with = lambda after: F.concat(F.substring("text", F.lit(1), n - third), F.substring(after, F.lit(1), third))
    # Side 0 is the text, 1 its edited text; 2, of repeated rows, the text edited by its twin. All read the same exchange by bucket.
    about = rows.select("bucket", "nth", "doc_id", "times", n.cast("long").alias("n_chars"), F.sha2(ends_with("next_text"), 256).alias("sha1"), F.when(F.col("times") > 1, F.sha2(ends_with("text"), 256)).alias("sha2"))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), t.alias("text")) for k, t in enumerate((F.col("text"), ends_with("next_text"), F.when(F.col("times") > 1, ends_with("text"))))])
    taken = samples(rows.select("bucket", "nth", F.explode(sides).alias("s")).select("bucket", "nth", "s.side", "s.text"), ["bucket", "nth", "side"], count)
    none = F.array_repeat(F.lit(-1), count)
    both = taken.groupBy("bucket", "nth").agg(*[F.max(F.when(F.col("side") == k, F.col("samples"))).alias(f"s{k}") for k in (0, 1, 2)])
    done = about.join(both, ["bucket", "nth"], "left").withColumns({f"s{k}": F.coalesce(f"s{k}", none) for k in (0, 1, 2)})
    done = stored(done, "samples")
    above = F.when(F.col("bucket") == buckets - 1, 0).otherwise(F.col("bucket") + 1).cast("long")
    first = done.filter("nth = 1").select(above.alias("__before"), F.col("s0").alias("head"))
    after = F.lead("s0").over(Window.partitionBy("bucket").orderBy("nth"))
    done = done.withColumn("after", after).join(first, (F.col("bucket") == F.col("__before")) & F.col("after").isNull(), "left").withColumn("after", F.coalesce("after", "head"))
    # The last of alike rows is followed by another document, those before it by a twin.
    last = F.struct(F.lit(1).cast("long").alias("copies"), F.col("sha1").alias("sha"), F.col("s1").alias("edited"), F.col("after"))
    twin = F.struct((F.col("times") - 1).alias("copies"), F.col("sha2").alias("sha"), F.col("s2").alias("edited"), F.col("s0").alias("after"))
    done = done.withColumn("r", F.explode(F.when(F.col("times") > 1, F.array(last, twin)).otherwise(F.array(last))))
    out = done.select(
        "doc_id", "n_chars", F.col("r.sha").alias("edited_sha256"), as_hex(F.col("s0")).alias("fingerprint"), as_hex(F.col("r.edited")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("r.edited"), count).alias("near_edited"), likeness(F.col("s0"), F.col("r.after"), count).alias("near_next"), F.col("r.copies").alias("copies"),
    )
    # Runs of copies, so that no row makes an array as long as a hot row's number.
    runs = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 10000"))))
    return runs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(10_000).cast("long"), F.col("copies") - F.col("run") * 10_000)))).drop("copies", "run", "copy")
