"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text (A-Z lowered) is cut where its content says so: at the first sentence
end after 256 characters, and after 2,048 at the latest. Every chunk gets a
64-bit identifier; the identifiers are verified against the distinct chunk
texts of the whole corpus, and drawn anew with the next seed if two different
chunks share one. A document is then its ordered list of identifiers, and two
texts are equal exactly if their lists are. Long texts move once, as distinct
chunks pre-aggregated before the shuffle; all later steps move recipes.

Defined cases: null text is the empty text (recipe of no chunks, one group);
a null id counts as smaller than any id; rows repeating both id and text are
one document of which one row stays; an empty table gives an empty table;
further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, keep_rows, stored, text_or_empty, with_ordinals

#: Least and greatest characters of a chunk.
CHUNK_MIN, CHUNK_MAX = 256, 2048


def chunks_of(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    cut = rf"(?s).{{{least},{most - 1}}}?[.!?\n]\s?|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_id(chunk: Column, seed: int) -> Column:
    return F.xxhash64(chunk, F.lit(seed)) if seed else F.xxhash64(chunk)


def verified_seed(chunk_table: DataFrame, make_id: Callable[[Column, int], Column] = chunk_id) -> int:
    """The first seed under which no two distinct values of column ``chunk`` share an identifier."""
    for seed in count():
        distinct = chunk_table.select(make_id(F.col("chunk"), seed).alias("h"), "chunk").distinct()
        if distinct.groupBy("h").count().filter("count > 1").isEmpty():
            return seed
    raise AssertionError


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make_id: Callable[[Column, int], Column] = chunk_id) -> DataFrame:
    """One row a document: doc_id, text_sha256 and recipe, the ordered verified chunk identifiers."""
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_or_empty(text_col)).alias("norm"))
    seed = verified_seed(norm.select(F.explode(chunks_of(F.col("norm"))).alias("chunk")), make_id)
    return norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks_of(F.col("norm")), lambda c: make_id(c, seed)).alias("recipe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(recipes(docs, id_col, text_col).withColumn("key", F.xxhash64("recipe")), "recipes")
    # Only lists that occur again are joined back, from a written table: a hot list can then be split.
    groups = stored(rows.groupBy("key", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "copies")
    joined = rows.join(groups, ["key", "recipe"], "left")
    joined = joined.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    joined = joined.withColumn("last", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    columns = ["doc_id", "keep_id", "group_size", F.col("last").alias("kept"), "text_sha256"]
    # Rows that repeat the id that stays as well: one of them stays. There are seldom any.
    twins = joined.filter("last and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twins = stored(twins.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")), "twins")
    if twins.isEmpty():
        return joined.select(*columns)
    same = F.col("last") & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_sha256") == F.col("__sha"))
    numbered = with_ordinals(joined.join(twins, same, "left_semi").select("doc_id", "keep_id", "group_size", "last", "text_sha256"), ["doc_id", "text_sha256"], "nth")
    return joined.join(twins, same, "left_anti").select(*columns).union(numbered.withColumn("last", F.col("nth") == 0).select(*columns))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    groups = exact_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = stored(groups.groupBy("doc_id", F.col("text_sha256").alias("key")).agg(F.count(F.lit(1)).alias("times")), "kept")
    return keep_rows(docs, F.sha2(ascii_lower(text_or_empty("text")), 256), kept)
