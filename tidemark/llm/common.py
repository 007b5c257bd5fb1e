"""What the training-data operators share: reading tables, the shared folder, lineage cuts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.scratch import new_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage.

    A lost executor costs a re-read of files, and the planner knows the size
    of what it reads.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the builtin's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def with_ordinals(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows that share ``keys`` numbered from 0 without gaps; no key, however hot, is one task's work.

    Rows are written once with the task that wrote them. A row's number is its
    place among the key's rows of its task and those of the tasks before.
    """
    rows = stored(rows.withColumn("__key_at", F.monotonically_increasing_id()), "numbered").withColumn("__key_task", F.shiftright("__key_at", 33))
    same = [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)]
    counts = rows.groupBy(*keys, "__key_task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("__key_task").rowsBetween(Window.unboundedPreceding, -1))  # a row a task
    counts = counts.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)], F.col("__key_task").alias("__key_part"), F.coalesce(before, F.lit(0)).alias("__key_before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "__key_task").orderBy("__key_at")) - 1
    out = rows.withColumn("__key_nth", nth).join(counts, reduce(and_, same, F.col("__key_task") == F.col("__key_part")))
    return out.withColumn(name, F.col("__key_before") + F.col("__key_nth")).drop("__key_at", "__key_task", "__key_nth", "__key_before", "__key_part", *[f"__key_{i}" for i in range(len(keys))])


def all_ordinals(counted: DataFrame, name: str, run: int = 100_000) -> DataFrame:
    """A row for each of the ``n`` that ``counted`` says there are, numbered from 0; a great number is many tasks' work."""
    rest = [c for c in counted.columns if c != "n"]
    runs = counted.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {run}"))))
    runs = runs.repartition(*rest, "__run")
    return runs.select(*rest, F.explode(F.sequence(F.col("__run") * run, F.least(F.col("n"), (F.col("__run") + 1) * run) - 1)).alias(name))


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (doc_id, key, times) names, once each, columns as they were.

    ``times`` says how many rows of ``docs`` share id and key; only such
    repeated rows are dealt by key to leave one of them.
    """
    kept = kept.select(F.col("doc_id").alias("__keep_id"), F.col("key").alias("__keep_key"), "times")
    tagged = docs.withColumn("__key", key)
    match = (F.col("__key") == F.col("__keep_key")) & F.col("doc_id").eqNullSafe(F.col("__keep_id"))
    if kept.filter("times > 1").isEmpty():
        return tagged.join(kept, match, "left_semi").drop("__key")
    once = tagged.join(kept.filter("times = 1"), match, "left_semi")
    repeated = tagged.join(kept.filter("times > 1"), match, "left_semi")
    return once.union(repeated.dropDuplicates(["doc_id", "__key"])).drop("__key")
