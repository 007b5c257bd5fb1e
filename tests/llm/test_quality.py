import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, documents, prose
from tidemark.llm import quality

LABELS = "doc_id long, quality int, toxic int, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def hostile():
    rng = random.Random(2)
    out = [t[1] if isinstance(t, tuple) else t for t in awkward()]
    few = ["a b c d e f g h", "a a a a a a a a", "a a a a a a a a a", "x y " * 9, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", " ".join("abcdefgh") + " q " + " ".join("abcdefgh"), "l\n\nl\n \nl\r\nl\nl", "  \x1c # <b> $|%&* é é", "a\x0bb\x0cc\td"]
    for _ in range(60):
        few.append(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))))
        few.append("\n".join(prose(rng, rng.randrange(0, 6)) for _ in range(rng.randrange(1, 9))) + "\n" + prose(random.Random(4), 30))
    return out + few


def test_statistics_equal_brute_force(monkeypatch):
    texts = hostile()
    for together in (1 << 19, 300, 1):
        monkeypatch.setattr(quality, "_TOGETHER", together)
        got = quality.statistics(texts)
        assert [tuple(r) for r in got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].to_numpy().tolist()] == [brute(t) for t in texts]


def junk(rng, kind):
    words = prose(rng, 120).split()
    return [" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in words), " | ".join(words), " ".join(w.upper() + "!!" for w in words)][kind % 3]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randrange(40, 300)) + (" see http://x.org/a?b=1 or mail a.b@c.example, 3.5 %" if i % 9 == 0 else ""), "en", "s") for i in range(500)]
    docs += [(1000 + i, junk(rng, i), "en", "s") for i in range(60)]
    labels = [(d, int(d < 1000), 0, "clash") for d, *_ in docs if d % 2 == 0]
    return documents(spark, docs), spark.createDataFrame(labels, LABELS)


def test_unusual_documents_go_and_clean_ones_stay(corpus):
    rows = quality.quality(*corpus).collect()
    held = [r for r in rows if r["doc_id"] % 2]  # without labels
    assert np.mean([r["kept"] for r in held if r["doc_id"] < 1000]) >= 0.98
    assert np.mean([r["kept"] for r in held if r["doc_id"] >= 1000]) <= 0.05
    assert [(r["doc_id"], r["kept"], r["score"]) for r in sorted(rows)] == [(r["doc_id"], r["kept"], r["score"]) for r in sorted(quality.quality(corpus[0].repartition(5), corpus[1]).collect())]


def test_good_rows_that_a_draw_would_miss_count(spark):
    """60 good rows are unlike the rest, and their ids would be outside a draw of 5,000 by hash; only a thousandth of all good rows may go."""
    rng = random.Random(31)
    high = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) > 900_000
    odd = {r["id"] for r in spark.range(20_000, 40_000).filter(high).orderBy("id").limit(60).collect()}
    kinds = ["the", "1234", "waterwaterwaterwater"]  # long words or many digits are usual, both together are not
    words = lambda i: " ".join(kinds[i % 3] if rng.random() < (i % 50) / 50 else rng.choice(["and", "places", "of", "it"]) + rng.choice(["", "ed"]) for _ in range(30))
    docs = [(i, words(i), "en", "s") for i in range(12_040)]
    docs += [(i, " ".join(["waterwater1234567890"] * 3 + [f"wwwwwwaaa{k + 1000000000}" for k in range(27)]), "en", "s") for i in sorted(odd)]
    labels = [(d, int(not 12_000 <= d < 12_040), 0, "clash") for d, *_ in docs]  # junk that looks like the rest
    rows = quality.quality(documents(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    good = [r for r in rows if not 12_000 <= r["doc_id"] < 12_040 and not r["base_failed"]]
    assert len(odd) == 60 and len(good) > 9_000 and odd <= {r["doc_id"] for r in good}
    assert sum(not r["kept"] for r in good) <= quality.GOOD_LOST * len(good)


def test_thresholds_and_draws_equal_those_of_rows_at_hand(spark):
    rng = np.random.default_rng(3)
    stats = pd.DataFrame({s: rng.integers(40, 90, 9000) for s in quality.STATISTICS}).assign(n_repeat_words=0)
    stats.insert(0, "doc_id", np.arange(9000) // 2)  # two texts an id
    stats["good"] = (rng.random(9000) < 0.9).astype("int32")
    rows = spark.createDataFrame(pd.concat([stats, stats[:500]]))  # repeated rows count once
    labelled = quality.labelled_rows(rows)
    assert labelled.count() == 9000
    forests = quality.fit(labelled)
    found = quality.thresholds(quality.scores(rows, forests), 0.02)
    for name, columns in quality.RULES.items():
        good, junk = (quality.rates(stats[stats["good"] == g])[:, columns] for g in (1, 0))
        assert found[name] == quality.calibrated(forests[name], good, junk, 0.02 / len(quality.RULES))
    counts = {g: int((stats["good"] == g).sum()) for g in (0, 1)}
    drawn = quality.draws(labelled, counts)
    assert len(drawn) == quality.TREES and {len(x) for x in drawn} == {quality.TREE_ROWS}
    assert all(len(np.unique(x, axis=0)) == len(x) for x in drawn)
    # No row is out of reach: of 50,400 good rows drawn and 800 junk ones evenly, 8,084 of 8,100 and 530 of 900 differ.
    assert 8500 < len(np.unique(np.concatenate(drawn), axis=0)) < 8800


def test_query_columns_equal_brute_force(spark, corpus):
    docs = [t if isinstance(t, tuple) else (i, t, "en", "s") for i, t in enumerate(awkward())]
    rng = random.Random(12)
    docs += [(800, prose(rng, 60_000), "en", "s"), (801, None, None, None)] + [(802, "the same row " * 3, "en", "s")] * 40
    rows = quality.quality(documents(spark, docs), corpus[1]).collect()
    assert len(rows) == len(docs)
    want = Counter((d, *(b := brute(t)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for d, t, *_ in docs)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_without_labels_the_base_rules_decide(spark):
    docs = documents(spark, [(1, prose(random.Random(1), 50), "en", "s"), (2, "few words", "en", "s")])
    none = spark.createDataFrame([], LABELS)
    assert {r["doc_id"]: r["kept"] for r in quality.quality(docs, none).collect()} == {1: True, 2: False}
    only_good = spark.createDataFrame([(1, 1, 0, "x"), (None, 0, 0, "x")], LABELS)
    assert {r["doc_id"]: r["kept"] for r in quality.quality(docs, only_good).collect()} == {1: True, 2: False}
    assert quality.quality(spark.createDataFrame([], DOCS), none).count() == 0


def test_path_lengths_and_threshold():
    rng = np.random.default_rng(1)
    good, far = rng.normal(0, 1, (2000, 3)), rng.normal(8, 0.5, (40, 3))
    forest = quality.grow(good, far)
    # A tree's leaf path is its depth and the mean path of what is left in it: scored by hand for a few rows.
    for x in (good[0], far[0]):
        total = 0.0
        for t in range(len(forest.feature)):
            node = 0
            while forest.left[t, node] != node:
                node = forest.left[t, node] if x[forest.feature[t, node]] < forest.split[t, node] else forest.right[t, node]
            total += forest.path[t, node]
        c = 2 * (np.log(forest.rows - 1) + np.euler_gamma) - 2 * (forest.rows - 1) / forest.rows
        assert np.isclose(forest.score(x[None])[0], 2 ** (-total / len(forest.feature) / c))
    assert forest.score(far).min() > np.quantile(forest.score(good), 0.99)
    limit = quality.calibrated(forest, good, far, 0.01)
    assert (forest.score(good) > limit).mean() <= 0.01 and (forest.score(far) > limit).mean() > 0.95


def test_rates_of_an_empty_frame():
    assert quality.rates(pd.DataFrame(columns=list(quality.STATISTICS))).shape == (0, 7)
