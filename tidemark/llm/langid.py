"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound from
its letters' vectors, the first shifted by two places and the second by one;
a text is the bundle (sum) of its trigrams, a language the bundle of its
documents at unit length. The predicted language is the one whose prototype
has the largest cosine with the text.

Fitting uses at most about ``PER_LANGUAGE`` distinct texts of a language,
drawn by their hash; prediction reads whole texts.

Defined cases: null text or one without a letter is ``und`` with score 0, as
is every text where nothing could be learned; equal cosines take the smaller
name; repeated rows count again; an empty table gives an empty result; only
text is looked at when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a vector; documents of a language that fitting reads at most.
DIM, PER_LANGUAGE = 1024, 3000
#: Documents bundled by one matrix product; code points counted at once.
_DOCS, _PIECE = 64, 1 << 20
_SLOTS = 1024


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """Slot of every code point: 0 what is no letter, a-z their own, other letters by remainder."""
    out = np.zeros(0x110000, np.uint16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    out[letters] = 27 + letters % 997
    out[97:123] = np.arange(1, 27)
    return out


@lru_cache(maxsize=2)
def _letters(dim: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors, shifted by two places, by one and by none."""
    v = np.where(np.random.default_rng(seed).random((_SLOTS, dim)) < 0.5, -1, 1).astype(np.int8)
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a text and how often they occur; a run of non-letters is one gap.

    Pieces of a very long text hand on their last two slots, so the trigrams are those of the whole.
    """
    text, grams, counts, last = text.lower(), [], [], np.zeros(1, np.int32)
    for at in range(0, len(text) + 1, _PIECE):
        piece = text[at : at + _PIECE]
        s = _slots()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        end = at + _PIECE > len(text)
        s = np.concatenate((last, s, [0])) if end else np.concatenate((last, s))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        code = s[:-2] * (_SLOTS * _SLOTS) + s[1:-1] * _SLOTS + s[2:]
        g, n = np.unique(code, return_counts=True)
        grams.append(g)
        counts.append(n)
        last = s[-2:]
    if len(grams) == 1:
        return grams[0], counts[0]
    g, back = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def bundles(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A row a text: its bundle at unit length, zero if it has no trigram."""
    out = np.zeros((len(texts), dim), np.float32)
    two, one, none = _letters(dim)
    for at in range(0, len(texts), _DOCS):
        got = [trigram_counts(t) for t in texts[at : at + _DOCS]]
        grams, back = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
        table = np.zeros((len(got), len(grams)), np.float32)
        table[np.repeat(np.arange(len(got)), [len(g) for g, _ in got]), back] = np.concatenate([n for _, n in got])
        bound = two[grams // (_SLOTS * _SLOTS)] * one[grams // _SLOTS % _SLOTS] * none[grams % _SLOTS]
        out[at : at + _DOCS] = table @ bound.astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from rows with text and lang."""
    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return [], np.zeros((0, dim), np.float32)
    part = F.lit(0.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(part)
    # However often a drawn text occurs, it is in the sample once.
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < part * 1_000_003).distinct()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            for lang, group in batch.groupby("lang"):
                total[lang] = total.get(lang, 0) + bundles(list(group["text"]), dim).sum(axis=0, dtype=np.float64)
        yield pd.DataFrame({"lang": list(total), "v": [x.tolist() for x in total.values()]})

    # The sample is bounded, so a fixed number of partial sums comes back.
    parts = sample.repartition(12).mapInPandas(sums, "lang string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in parts:
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    langs = sorted(total)
    proto = np.array([total[k] for k in langs]).reshape(len(langs), dim)
    return langs, (proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score, from column text alone."""
    langs, proto = model

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if langs and has_letter(t)]
        for at in range(0, len(known), 16 * _DOCS):
            some = known[at : at + 16 * _DOCS]
            cosine = bundles([texts.iloc[i] for i in some], proto.shape[1]) @ proto.T
            best = cosine.argmax(axis=1)
            for i, b in zip(some, best.tolist(), strict=True):
                names[i] = langs[b]
            scores[some] = np.clip(cosine[np.arange(len(some)), best].astype(np.float64), 0.0, 1.0)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("__label", label("text")).select(*docs.columns, "__label.lang_pred", "__label.score")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the rows not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least_score: float = 0.05) -> DataFrame:
    """Documents without a language, or with next to no likeness to any, go; columns stay as they were."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    seen = predict(docs, model)
    return seen.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select(*docs.columns)
