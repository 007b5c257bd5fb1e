"""Filter interaction audit: what each filter removes alone, after others, and on average over all orders.

Documents are told apart by the set of filters that they fail, one bit a
filter, so a part of the corpus is a table of counts by set (at most 32 rows
for five filters), whatever its size. Coalitions of filters play a removal
game: v(S) is the number of documents that fail any filter of S. Its
Hart-Mas-Colell potential follows by recursion over the coalitions,
P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, and a filter's
Shapley value is P(all) - P(all without it). What a step of an order removes
is a difference of two coalitions, v(S with i) - v(S).

The potential is kept times n! for n filters, which makes it a whole number
and the Shapley value the sum over all n! orders of what the filter removes.

Defined cases: null text is the empty text; a null source is the part ''; of
equal texts the rows with the smallest id don't count as copies, so rows
repeated whole are no copies of each other; a row without an id is never a
copy and makes none; a document with several label rows has a quality of 1 or
is toxic where any of them says so; documents without labels count in all but
the lost ones; a row without an id has no labels; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored, text_or_empty, word_count

#: Name of the filter that fails copies of a smaller id's text.
COPIES = "E"


def text_filters() -> dict[str, Column]:
    """Failure conditions by name, on column ``text``, null free. Their limits."""
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: dict[str, Column], copies: str | None = COPIES) -> DataFrame:
    """doc_id, part, failed: a bit a filter in the order of ``filters``, the copies filter last.

    Texts are compared by their SHA-256 and only digests travel. A row is no
    copy where its id is the least of its text, so ids are part of the join's
    key and a text that a third of all rows share is no hot key.
    """
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty("text").alias("text"))
    rows = rows.select("doc_id", "part", bits.alias("failed"), *([F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")] if copies else []))
    rows = stored(rows, "failures")
    if not copies:
        return rows
    least = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least_id")).select(F.col("digest").alias("of"), "least_id")
    copy = F.col("doc_id").isNotNull() & F.col("least_id").isNull()
    return rows.join(least, (F.col("doc_id") == F.col("least_id")) & (F.col("digest") == F.col("of")), "left").select("doc_id", "part", F.when(copy, F.col("failed") + (1 << len(filters))).otherwise(F.col("failed")).alias("failed"))


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed, docs, good, toxic: how many documents of a part fail just this set of filters."""
    says = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failed.join(says, F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic"))


def removal_game(counts: np.ndarray, n: int) -> np.ndarray:
    """v of every coalition, a column each: documents whose failed set meets it. ``counts`` has a column a failed set."""
    coalition = np.arange(1 << n)
    meets = (coalition[:, None] & coalition[None, :]) != 0
    return counts @ meets.astype(np.int64)


def potentials(v: np.ndarray, n: int) -> np.ndarray:
    """The Hart-Mas-Colell potential of every coalition times n!, whole numbers."""
    p = np.zeros_like(v)
    for s in range(1, 1 << n):
        members = [i for i in range(n) if s >> i & 1]
        p[:, s] = (factorial(n) * v[:, s] + sum(p[:, s & ~(1 << i)] for i in members)) // len(members)
    return p


AUDITED = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts: DataFrame, names: str) -> DataFrame:
    """A row a part, order of all filters and step, from ``set_counts``; ``names`` has a letter a filter, in bit order."""
    n, full = len(names), (1 << len(names)) - 1
    sets = [F.coalesce(F.sum(F.when(F.col("failed") == s, F.col(c))), F.lit(0)).alias(f"{c}_{s}") for c in ("docs", "good", "toxic") for s in range(full + 1)]
    orders = list(permutations(range(n)))
    before = np.array([[sum(1 << i for i in order[:k]) for k in range(n)] for order in orders]).ravel()
    which = np.array(orders).ravel()
    spelled = ["".join(names[i] for i in order) for order in orders for _ in range(n)]

    def games(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                parts = batch.iloc[at : at + 256]
                docs, good, toxic = (removal_game(parts[[f"{c}_{s}" for s in range(full + 1)]].to_numpy(np.int64), n) for c in ("docs", "good", "toxic"))
                everyone = parts[[f"docs_{s}" for s in range(full + 1)]].to_numpy(np.int64).sum(axis=1)
                p = potentials(docs, n)
                bit = 1 << which
                removed = docs[:, before | bit] - docs[:, before]
                shapley = p[:, [full]] - p[:, full & ~bit]
                yield pd.DataFrame({
                    "part": np.repeat(parts["part"].to_numpy(object), len(which)), "filter_order": spelled * len(parts), "step": np.tile(np.arange(len(which)) % n + 1, len(parts)),
                    "kept": (everyone[:, None] - docs[:, before | bit]).ravel(), "removed": removed.ravel(), "redundant": (docs[:, bit] - removed).ravel(), "unique_fails": (docs[:, [full]] - docs[:, full & ~bit]).ravel(),
                    "good_lost": (good[:, before | bit] - good[:, before]).ravel(), "toxic_lost": (toxic[:, before | bit] - toxic[:, before]).ravel(), "shapley": shapley.ravel(),
                })

    return counts.groupBy("part").agg(*sets).mapInPandas(games, AUDITED)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four text filters and the copies filter."""
    filters = text_filters()
    return audit(set_counts(failures(docs, filters), labels), "".join(filters) + COPIES)
