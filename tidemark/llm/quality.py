"""Quality rules: statistics of rules, and an isolation forest over them with a threshold from labelled rows.

One pass over the texts counts, for every document, what rules look at:
words, their characters, symbols, capitals, digits and other marks, lines that
repeat an earlier one, and words in eight-word windows that come again.
Windows are compared exactly: words are numbered, then pairs of numbers, pairs
of pairs and pairs of those, so equal numbers are equal windows. Only the
statistics, a row of numbers a document, are stored and used further.

A forest is a set of trees of random splits over rates of these statistics.
A document that few splits set apart is unusual; its score is the usual
2^(-mean path / mean path of a random search). Every group of rules that look
at one thing (marks, capitals, repeats, shape) has a forest of its own, so a
document that is unusual in one way isn't outvoted by its other rates. A tree grows on a draw, as is usual, of its own
from all labelled rows of either quality, nearly all good, so that junk is rare
in it. A forest's threshold is the least score that leaves out no more than its
part of ``GOOD_LOST`` of all good labelled rows, or midway from there to the
first junk row above, of all as well. A document stays where no forest puts it
above its threshold.

Labelled rows are drawn, scored and ranked by Spark. The driver reads the
draws, as numbers (``TREES`` times ``TREE_ROWS`` at most), counts and
thresholds; how many rows are labelled doesn't bear on that.

Defined cases: null and wordless texts have no words and fail the base rules;
lines are split at \\n only; a labelled row counts as good where any of its
labels has quality 1, as junk where one has 0 and none 1; without good and
junk labelled rows that pass the base rules there is no threshold and the
base rules decide alone; repeated rows are scored again, alike rows alike; an
empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: The part of the good labelled rows that the thresholds may cost.
GOOD_LOST = 0.001
#: Trees, rows a tree is grown on and how many of these are junk.
TREES, TREE_ROWS, TREE_JUNK = 200, 256, 4
#: Words of a window.
WINDOW = 8
_WHITE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Words that are numbered together at most, but for longer texts.
_TOGETHER = 1 << 19

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")


def repeated_words(words: list[bytes], lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For texts of so many words each, how many words lie in windows found twice or more in their text.

    ``window`` is a power of two.
    """
    out = np.zeros(len(lengths), np.int64)
    n = len(words)
    if n < window:
        return out
    code = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    width = 1
    while width < window:
        code = pd.factorize(code[:-width] << 32 | code[width:])[0].astype(np.int64)
        width *= 2
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(np.arange(len(code)) + window <= ends[of[: len(code)]])
    key, found = pd.factorize(of[at] << 32 | code[at])
    again = at[np.bincount(key, minlength=len(found))[key] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return np.bincount(of[np.cumsum(cover[:n]) > 0], minlength=len(lengths))


def _counts(text: str, data: bytes, n_words: int) -> tuple[int, ...]:
    lines = [x for x in data.split(b"\n") if x.strip(_WHITE)]
    without = lambda some: len(data) - len(data.translate(None, some))
    return n_words, len(text) - without(_WHITE), without(_SYMBOLS), len(lines) - len(set(lines)), len(lines), without(_UPPER), without(_DIGITS), without(_MARKS)


def statistics(texts: list[str | None]) -> pd.DataFrame:
    """The rules' statistics, a row a text."""
    rows: list[tuple[int, ...]] = []
    repeats: list[np.ndarray] = []
    words: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal held
        repeats.append(repeated_words(words, np.array([r[0] for r in rows[held:]], np.int64)))
        words.clear()
        held = len(rows)

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        some = data.split()
        if words and len(words) + len(some) > _TOGETHER:
            flush()
        words += some
        rows.append(_counts(text or "", data, len(some)))
    flush()
    out = pd.DataFrame(rows, columns=[s for s in STATISTICS if s != "n_repeat_words"], dtype="int64")
    out["n_repeat_words"] = np.concatenate(repeats).astype(np.int64)
    return out[list(STATISTICS)]


#: What each forest looks at: columns of ``rates``.
RULES = {"marks": (1, 6), "capitals": (4,), "repeats": (2, 3), "shape": (0, 5)}


def rates(stats: pd.DataFrame) -> np.ndarray:
    """What the forests split: rates, so that a text's length alone is nothing unusual.

    Low rates are spread by a logarithm, as splits are drawn evenly between
    the least and the greatest.
    """
    s = stats.astype("float64")
    words, chars = s["n_words"].clip(lower=1), s["word_chars"].clip(lower=1)
    made = [s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / s["n_lines"].clip(lower=1), s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / words]
    return np.log1p(20 * np.stack([x.to_numpy() for x in made], axis=1))


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays, a row a tree and a column a node; a leaf is its own child and holds its path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    rows: int
    threshold: float = float("inf")

    def score(self, x: np.ndarray) -> np.ndarray:
        total, at = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                new = np.where(x[at, self.feature[t, node]] < self.split[t, node], self.left[t, node], self.right[t, node])
                if (new == node).all():
                    break
                node = new
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.feature) / float(_mean_path(self.rows)))


def grow(good: np.ndarray, junk: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, junk_rows: int = TREE_JUNK, seed: int = 13) -> Forest:
    """A forest on draws from good rows and a few junk ones each, of rows at hand."""
    rng = np.random.default_rng(seed)
    some, most = draw_sizes(len(good), len(junk), rows, junk_rows)
    return grown([np.concatenate([junk[rng.choice(len(junk), some, replace=False)], good[rng.choice(len(good), most, replace=False)]]) for _ in range(trees)], rng)


def draw_sizes(good: int, junk: int, rows: int = TREE_ROWS, junk_rows: int = TREE_JUNK) -> tuple[int, int]:
    """Junk and good rows of a tree, where there are so many good and junk ones."""
    rows = min(rows, good + min(junk_rows, junk))
    some = min(junk_rows, junk, rows - 1)
    return some, rows - some


def grown(draws: list[np.ndarray], rng: np.random.Generator) -> Forest:
    """A forest of a tree a draw; draws have the same number of rows."""
    rows = len(draws[0])
    deepest, trees = int(np.ceil(np.log2(max(2, rows)))), []
    for x in draws:
        nodes: list[list[float]] = []

        def split(x: np.ndarray, depth: int, nodes: list[list[float]] = nodes) -> int:
            me = len(nodes)
            nodes.append([0, 0.0, me, me, depth + float(_mean_path(len(x)))])
            low, high = x.min(axis=0), x.max(axis=0)
            able = np.flatnonzero(high > low)
            if depth < deepest and len(x) > 1 and len(able):
                f = int(able[rng.integers(len(able))])
                cut = float(rng.uniform(low[f], high[f]))
                less = x[:, f] < cut
                if less.any() and not less.all():
                    nodes[me][:4] = [f, cut, split(x[less], depth + 1), split(x[~less], depth + 1)]
            return me

        split(x, 0)
        trees.append(nodes)
    size = max(map(len, trees))
    table = np.array([n + [[0, 0.0, k, k, 0.0] for k in range(len(n), size)] for n in trees])
    whole = [table[:, :, k].astype(np.int64) for k in (0, 2, 3)]
    return Forest(whole[0], table[:, :, 1], whole[1], whole[2], table[:, :, 4], rows)


def calibrated(forest: Forest, good: np.ndarray, junk: np.ndarray, good_lost: float = GOOD_LOST) -> float:
    """The threshold, of rows at hand: at most ``good_lost`` of the good rows lie above, and it stands midway to the next junk row."""
    least = float(np.quantile(forest.score(good), 1 - good_lost, method="higher"))
    above = np.sort(forest.score(junk))
    above = above[above > least]
    return (least + float(above[0])) / 2 if len(above) else least


def base_failed() -> Column:
    """The fixed rules, on the statistics' columns. Their limits."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                out = statistics(part["text"].tolist())
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out.astype({"doc_id": "Int64"})

    kinds = ", ".join(f"{s} long" for s in STATISTICS)
    return stored(docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, {kinds}"), "rule-statistics")


def tagged(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``stats`` with good: 1 or 0 for labelled rows that pass the base rules, else null."""
    says = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("good"))
    rows = stats.join(says, F.col("doc_id") == F.col("labelled"), "left")
    return stored(rows.select("doc_id", *STATISTICS, F.when(~base_failed(), F.col("good")).alias("good")), "labelled-statistics")


def labelled_rows(rows: DataFrame) -> DataFrame:
    """All labelled rows that pass the base rules; repeated ones once."""
    return rows.filter("good is not null").dropDuplicates(["doc_id", *STATISTICS])


def draws(labelled: DataFrame, counts: dict[int, int], trees: int = TREES) -> list[np.ndarray]:
    """Rates of each tree's rows, junk and good, drawn from all labelled rows without replacement.

    Every row has a number for every tree; the least ones of a tree are its
    draw. Numbers above what the draw can need are not kept.
    """
    sizes = dict(zip((0, 1), draw_sizes(counts[1], counts[0]), strict=True))
    # Eight standard deviations more than the draw are expected below the limit.
    parts = {g: min(1.0, (n + 8 * n**0.5 + 64) / counts[g]) for g, n in sizes.items()}
    limit = F.when(F.col("good") == 1, F.lit(int(parts[1] * 2**40))).otherwise(F.lit(int(parts[0] * 2**40)))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64("row", t), F.lit(1 << 40)).alias("number")))
    some = labelled.withColumn("row", F.xxhash64("doc_id", *STATISTICS)).withColumn("limit", limit)
    some = some.select("doc_id", *STATISTICS, "good", F.explode(F.filter(numbers, lambda x: x["number"] < F.col("limit"))).alias("at")).select("doc_id", *STATISTICS, "good", "at.*")
    place = F.row_number().over(Window.partitionBy("tree", "good").orderBy("number", "doc_id", *STATISTICS))  # a few hundred rows
    kept = some.withColumn("place", place).filter(F.col("place") <= F.when(F.col("good") == 1, sizes[1]).otherwise(sizes[0]))
    read = kept.select("tree", "good", "place", *STATISTICS).toPandas().sort_values(["tree", "good", "place"])
    return [rates(part) for _, part in read.groupby("tree")]


def fit(labelled: DataFrame) -> dict[str, Forest]:
    """A forest a group of rules, without thresholds; none without rows of both qualities."""
    counts = {0: 0, 1: 0} | {r["good"]: r["count"] for r in labelled.groupBy("good").count().collect()}
    if not (counts[0] and counts[1] and counts[0] + counts[1] >= 8):
        return {}
    rng, drawn = np.random.default_rng(13), draws(labelled, counts)
    return {name: grown([x[:, columns] for x in drawn], rng) for name, columns in RULES.items()}


def thresholds(scored: DataFrame, good_lost: float = GOOD_LOST) -> dict[str, float]:
    """The law of ``calibrated`` for each forest, over all labelled rows: exact ranks, found by Spark."""
    rows = stored(labelled_rows(scored).select("good", *RULES), "labelled-scores")
    good, out = rows.filter("good = 1"), {}
    n = good.count()
    top = n - int(np.ceil((1 - good_lost / len(RULES)) * (n - 1)))
    for name in RULES:
        least = good.orderBy(F.desc(name)).limit(top).agg(F.min(name)).first()[0]
        above = rows.filter((F.col("good") == 0) & (F.col(name) > least)).agg(F.min(name)).first()[0]
        out[name] = least if above is None else (least + above) / 2
    return out


def scores(rows: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """``rows`` of ``tagged`` with a column of scores for each forest, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = rates(batch[list(STATISTICS)])
            yield batch.assign(**{name: f.score(x[:, RULES[name]]) for name, f in forests.items()}).astype({"doc_id": "Int64", "good": "Int32"})

    kinds = ", ".join([*(f"{s} long" for s in STATISTICS), "good int", *(f"{name} double" for name in forests)])
    return stored(rows.select("doc_id", *STATISTICS, F.col("good").cast("int").alias("good")).mapInPandas(run, f"doc_id long, {kinds}"), "scores")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a document: doc_id, the statistics, score, base_failed and kept.

    The score is the greatest of the forests' scores over their thresholds (null without forests).
    """
    rows = tagged(measured(docs), labels)
    forests = fit(labelled_rows(rows))
    score = F.lit(None).cast("double")
    if forests:
        rows = scores(rows, forests)
        score = F.greatest(*[F.col(name) / F.lit(t) for name, t in thresholds(rows).items()])
    rows = rows.withColumn("score", score)
    unusual = F.coalesce(F.col("score") > 1, F.lit(False))
    return rows.select("doc_id", *STATISTICS, "score", base_failed().alias("base_failed"), (~base_failed() & ~unusual).alias("kept"))
