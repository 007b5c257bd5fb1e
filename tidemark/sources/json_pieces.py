"""One large JSON document read by many tasks.

The text source cuts a file at commas, splits of it side by side. Whether a
piece begins within a string, and how deep it lies, follows from the pieces
before: a piece says for either case whether it changes it and by how many
brackets, splits sum that up (a row a split), and a running sum over splits
and then over the pieces of a split tells every piece. A comma outside
strings at the elements' depth ends an element; its pieces are put together
again, so only an element has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.scratch import new_folder

_SPLIT = ("file", "split")


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: each running sum reads its rows twice."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _carried(pieces: DataFrame, **sums: Column) -> DataFrame:
    """Adds the sums of columns over all pieces of the file before each one."""
    pieces = _written(pieces, "json-sums")
    within = Window.partitionBy(*_SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*_SPLIT).agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    totals = totals.select(*_SPLIT, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"of_{name}") for name in sums])
    out = pieces.join(totals, list(_SPLIT))
    return out.withColumns({name: F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"of_{name}") for name, x in sums.items()}).drop(*[f"of_{name}" for name in sums])


def _depth_change(text: Column) -> Column:
    """Brackets opened less closed, of a text without escapes that begins outside strings."""
    bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, key, row_idx, text): the elements of a document's array, or of the arrays of an object's members.

    Of an array of elements member is 0 and key null. A member that is no
    array isn't listed; an empty array gives one row with an empty text.
    """
    raw = spark.read.option("lineSep", ",").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("piece"))
    plain = F.regexp_replace("piece", r"\\.", "")
    within = F.regexp_replace(plain, r'^[^"]*("|$)', "")
    top = F.regexp_extract("piece", r"^\s*(\S)", 1)
    facts = raw.select("*", top.alias("sign"), (F.regexp_count(plain, F.lit('"')) % 2).alias("odd"), _depth_change(plain).alias("if_out"), F.when(F.contains(plain, F.lit('"')), _depth_change(within)).otherwise(0).alias("if_in"))
    facts = _written(facts, "json-pieces")
    known = _carried(facts.drop("piece"), quotes=F.col("odd"))
    known = known.withColumn("change", F.when(F.col("quotes") % 2 == 1, F.col("if_in")).otherwise(F.col("if_out"))).withColumn("open", (F.col("quotes") + F.col("odd")) % 2 == 1)
    known = _carried(known.drop("odd", "if_in", "if_out", "quotes"), before=F.col("change")).withColumn("after", F.col("before") + F.col("change"))
    tops = facts.filter("sign <> ''").groupBy("file").agg(F.min_by("sign", F.struct("split", "id")).alias("top"))
    known = known.drop("sign", "before", "change").join(tops, "file")
    object_ = F.col("top") == "{"
    ends_member = (~F.col("open") & object_ & (F.col("after") == 1)).cast("long")
    ends = (~F.col("open") & (F.col("after") <= F.when(object_, 2).otherwise(1))).cast("long")
    known = _carried(known, member=ends_member, element=ends).join(facts.select(*_SPLIT, "id", "piece"), [*_SPLIT, "id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "id", "piece"))), lambda p: p["piece"]), ",")
    whole = known.groupBy("file", "top", "member", "element").agg(joined.alias("text"), F.max_by("after", F.struct("split", "id")).alias("after"))
    whole = _written(whole, "json-elements")
    first = whole.groupBy("file", "member").agg(F.min("element").alias("first"), F.max("element").alias("last"), F.min_by("text", "element").alias("head"))
    named = r'^\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*'
    is_array = F.when(F.col("top") == "{", F.col("head").rlike(named + r"\[")).otherwise(F.col("top") == "[")
    begin = F.when(F.col("top") == "{", F.regexp_replace("text", named + r"\[", "")).otherwise(F.regexp_replace("text", r"^\s*\[", ""))
    text = F.when(F.col("element") == F.col("first"), begin).otherwise(F.col("text"))
    shut = F.when(F.col("top") == "{", r"\]\s*\}?\s*$").otherwise(r"\]\s*$")
    text = F.when(F.col("element") == F.col("last"), F.regexp_replace(text, shut, F.lit(""))).otherwise(text)
    # A key as it is written between quotes, read as JSON reads it.
    key = F.when(F.col("top") == "{", F.get(F.from_json(F.concat(F.lit('["'), F.regexp_extract("head", named, 1), F.lit('"]')), "array<string>"), F.lit(0)))
    out = whole.join(first, ["file", "member"]).filter(is_array)
    return out.select("file", "member", key.alias("key"), (F.col("element") - F.col("first")).alias("row_idx"), F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("text"))


def members(found: DataFrame) -> list[tuple[str, bool]]:
    """(key, whether it holds objects) of an object's arrays, in order; a row a key."""
    rows = found.filter("key is not null").groupBy("key").agg(F.min("member").alias("at"), F.min_by(F.col("text").startswith("{"), "row_idx").alias("objects")).orderBy("at", "key").collect()
    return [(r["key"], r["objects"]) for r in rows]


def scalar(text: Column) -> Column:
    """An element's value as text: a string without its quotes, null for null; what is no scalar as it is written."""
    return F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))
