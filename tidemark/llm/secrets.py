"""Secret scans: fixed patterns, and two character Markov models weighed against each other.

One first-order Markov model is trained on random strings, one on ordinary
identifiers. A run of 16 or more key characters is a secret where its
log-likelihood ratio, random over ordinary, exceeds the log of the prior odds,
which are higher for runs without a digit. Of a run that a pattern has found
in part, what lies beside the finding is judged by itself. The labelled
samples: ordinary tokens are those of a bounded, hashed sample of distinct
texts outside the patterns' spans and the runs to be judged, alone and joined
into identifiers; random strings are the patterns' findings in that sample
and strings drawn from the usual key alphabets by a seed.

Defined cases: null text is the empty text without spans; texts are scanned
whole; repeated rows are scanned again; an empty table gives an empty result
(the models then know only the drawn strings and a uniform prior); further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, their least lengths and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "markov")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Runs that the models judge; the prior odds of ordinary to random with and without a digit; texts sampled for training at most.
LEAST_RUN = 16
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ODDS, ODDS_WITHOUT_DIGIT, SAMPLE_DOCS = 1e6, 1e10, 4000
_DIGIT = re.compile(r"[0-9]")
# Names and paths: short words without digits, joined.
_JOINED = re.compile(r"^[A-Za-z]{1,15}(?:[_/-][A-Za-z]{1,15})+$")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_N = len(_ALPHABET) + 1  # the last state is a string's beginning
_KEYS = ("0123456789abcdef", "0123456789ABCDEF", _ALPHABET[:62], _ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789")
_CODE = np.full(256, _N - 1, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(_N - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' findings, by start, then kind."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(strings: list[str]) -> np.ndarray:
    """Counts of character pairs, strings beginning in the last state."""
    codes = _CODE[np.frombuffer("".join("\0" + s for s in strings).encode("latin-1", "replace"), np.uint8)]
    pair = (codes[:-1] * _N + codes[1:])[codes[1:] < _N - 1]
    return np.bincount(pair, minlength=_N * _N).reshape(_N, _N).astype(float)


def random_strings(n: int = 6000, seed: int = 5) -> list[str]:
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        keys = _KEYS[i % len(_KEYS)]
        out.append("".join(keys[k] for k in rng.integers(0, len(keys), rng.integers(20, 65))))
    return out


def log_ratio(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of every character pair.

    Pairs are smoothed by single characters, so a capital or digit after
    something never seen is still as rare as capitals and digits are.
    """

    def model(pairs: np.ndarray) -> np.ndarray:
        single = pairs.sum(axis=0) + 0.5
        return (pairs + 5 * single / single.sum()) / (pairs.sum(axis=1, keepdims=True) + 5)

    return np.log(model(random)) - np.log(model(ordinary))


def identifiers(words: list[str]) -> Iterator[str]:
    """Words joined by threes in the ways of names and paths, each way in turn."""
    for i in range(0, len(words), 3):
        some = words[i : i + 3]
        way = i // 3 % 5
        yield "_-/"[way].join(some) if way < 3 else (some[0] if way == 3 else some[0].capitalize()) + "".join(w.capitalize() for w in some[1:])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """The log-ratio table, from at most about ``sample_docs`` distinct texts drawn by their hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        random, ordinary = np.zeros((_N, _N)), np.zeros((_N, _N))
        for batch in batches:
            for text in batch["text"]:
                spans, at, rest = base_spans(text), 0, []
                for a, _, b in spans:
                    rest.append(text[at:a])
                    at = max(at, b)
                # What the models are to judge has no label yet and is in neither sample.
                rest = RUN.sub(lambda m: m[0] if _JOINED.search(m[0]) else " ", " ".join([*rest, text[at:]]))
                words = re.findall(r"[A-Za-z0-9+/_=-]{3,}", rest)
                if words:
                    ordinary += transitions(words) + transitions(list(identifiers(words)))
                if spans:
                    random += transitions([text[a:b] for a, k, b in spans if k])
        yield pd.DataFrame({"random": [random.ravel().tolist()], "ordinary": [ordinary.ravel().tolist()]})

    rows = docs.filter("text is not null").select("text")
    n = rows.count()
    part = 1_000_003 * min(1.0, sample_docs / max(1, n))
    # However often a drawn text occurs, it is in the sample once.
    found = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < part).distinct().repartition(8).mapInPandas(count, "random array<double>, ordinary array<double>").collect()
    random, ordinary = transitions(random_strings()), np.zeros((_N, _N))
    for r in found:
        random += np.array(r["random"]).reshape(_N, _N)
        ordinary += np.array(r["ordinary"]).reshape(_N, _N)
    return log_ratio(random, ordinary)


def beside(runs: Iterable[tuple[int, int]], spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What of the runs lies outside the spans; both are in order, and each is looked at once."""
    at, end = 0, 0
    for start, stop in runs:
        while at < len(spans) and spans[at][0] < stop:
            a, _, b = spans[at]
            if max(start, end) < a:
                yield max(start, end), a
            end, at = max(end, b), at + 1
        if max(start, end) < stop:
            yield max(start, end), stop


def scan_text(text: str, table: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans (start, kind number, end): the base ones, and runs that the models call random."""
    spans = base_spans(text)
    found = []
    for start, stop in beside((m.span() for m in RUN.finditer(text)), spans):
        if stop - start < LEAST_RUN:
            continue
        run = text[start:stop]
        codes = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        ratio = table[_N - 1, codes[0]] + table[codes[:-1], codes[1:]].sum()
        if ratio > np.log(ODDS if _DIGIT.search(run) else ODDS_WITHOUT_DIGIT):
            found.append((start, 3, stop))
    return sorted(spans + found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan_text(t or "", table) for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"]})
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name] = [sum(s[1] == k for s in spans) for spans in found]
            out["base_sha256"] = [hashlib.sha256(written([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            out["spans"] = [written(spans) for spans in found]
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def find_secrets(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))
