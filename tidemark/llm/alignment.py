"""Cross-tokenizer alignment by coalescing intervals.

Two tokenizers cut the same bytes: A reads a space and the text, B adds that
space itself. Tokens are intervals of bytes. All of both are sorted by start
(lexsort), the running maximum of their ends is accumulated, and a group of
tokens begins where a start reaches that maximum, so groups are the shortest
byte ranges that both cut alike. Within its group every token of A is paired
with the tokens of B that it overlaps.

Neither tokenizer has a token over the border between a character that is no
white space and a space after it (A's pattern allows a space only first, B's
pieces too, which is checked when B is loaded). Texts are cut at these
borders, each distinct stretch is encoded and aligned once in a while by a
task, and a document is put together from its stretches. Very long texts are
never handed to a tokenizer whole.

Corpus-wide, a pair of ids counts the documents that hold it linked. A task
packs some documents into a block: every document with its distinct pairs and
how often it has them, the block with how many of its documents have each.
Blocks' counts are summed by pair, so a pair that all documents have is one
row a block, and the sums go back to the blocks, not to documents.

Defined cases: null and empty texts, and texts whose bytes either tokenizer
doesn't give back, have no tokens, groups or links and the empty groups text;
texts of white space have tokens; very long texts and words are whole;
repeated rows and null ids are rows of their own, and each row counts as a
document; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Characters of documents that a task works on at once, stretches that it keeps in mind, and a block's document pairs; each ends with the document that reaches it.
BATCH_CHARS, KNOWN_STRETCHES, BLOCK_PAIRS = 1 << 21, 1 << 19, 1 << 21
#: An id of B takes so many bits of a pair.
B_BITS = 15
_NOT_AFTER = re.compile(r"\s ")


def stretches(text: str) -> list[str]:
    """``text`` cut before spaces that follow something else than white space, without these spaces; a last space isn't cut off."""
    if text[:1] != " " != text[-1:] and "  " not in text and not _NOT_AFTER.search(text):
        return text.split(" ")
    out: list[str] = []
    for part in text.split(" "):
        if out and (not out[-1] or out[-1][-1].isspace()):
            out[-1] += " " + part
        else:
            out.append(part)
    if len(out) > 1 and not out[-1]:
        out[-2:] = [out[-2] + " "]
    return out


def _byte_of_letter() -> dict[str, int]:
    """The byte that a letter of a byte-level vocabulary stands for: printable bytes are themselves, others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Pair:
    """The two tokenizers and the bytes of their ids."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    def encoded(self, some: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + s for s in some], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(some, num_threads=1)


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    with open(a_path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letter, a_bytes = _byte_of_letter(), [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
    if any("▁" in p.lstrip("▁") for p in pieces) or len(pieces) > 1 << B_BITS:
        raise ValueError(f"{b_path} has pieces with a space inside, or too many")
    b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Pair(a, b, a_bytes, b_bytes)


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals of any sides: their order by start, and in that order the number of each one's group."""
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    begins = np.concatenate(([True], starts[order][1:] >= reached[:-1])) if len(order) else np.zeros(0, bool)
    return order, np.cumsum(begins) - 1


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of an A and a B interval that share a byte; each side is in order and doesn't overlap itself."""
    first = np.searchsorted(b_ends, a_starts, "right")
    n = np.maximum(np.searchsorted(b_starts, a_ends, "left") - first, 0)
    a = np.repeat(np.arange(len(a_starts)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _joined(ids: list[int], of: list[bytes]) -> bytes:
    return b"".join(map(of.__getitem__, ids))


class Stretches:
    """Distinct stretches of texts, each encoded and aligned once while it is known."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        #: n_a, n_b, n_groups, n_links, and whether a tokenizer changed the bytes.
        self.counts = np.zeros((0, 5), np.int64)
        self.at = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def learn(self, texts: list[list[str]]) -> None:
        new = list({s for t in texts for s in t if s not in self.number})
        if not new:
            return
        p = self.pair
        a, b = p.encoded(new)
        whole = [(" " + s).encode("utf-8", "surrogatepass") for s in new]
        bad = np.array([_joined(x, p.a_bytes) != w or _joined(y, p.b_bytes) != w for x, y, w in zip(a, b, whole, strict=True)])
        # A changed stretch has no tokens, but is there.
        a, b = ([[] if k else x for x, k in zip(side, bad, strict=True)] for side in (a, b))
        base = np.concatenate(([0], np.cumsum(list(map(len, whole)))))[:-1]
        sides = []
        for ids, of in ((a, p.a_bytes), (b, p.b_bytes)):
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            size = np.fromiter((len(of[i]) for x in ids for i in x), np.int64, len(flat))
            stretch = np.repeat(np.arange(len(ids)), n)
            ends = np.cumsum(size)
            lost = base - np.concatenate(([0], np.cumsum(np.bincount(stretch, size, len(ids)).astype(np.int64))))[:-1]
            ends = ends + lost[stretch]
            sides.append((flat, n, stretch, ends - size, ends))
        (ia, na, sa, a0, a1), (ib, nb, sb, b0, b1) = sides
        order, group = coalesce(np.concatenate((a0, b0)), np.concatenate((a1, b1)))
        side = np.concatenate((np.zeros(len(ia), np.int64), np.ones(len(ib), np.int64)))[order]
        ids, stretch = np.concatenate((ia, ib))[order], np.concatenate((sa, sb))[order]
        # Groups as text: A's ids, then B's, each in order.
        by = np.lexsort((np.arange(len(ids)), side, group))
        ids, side, stretch, group = ids[by], side[by], stretch[by], group[by]
        fresh = np.diff(group, prepend=-1) != 0
        first = np.diff(stretch, prepend=-1) != 0
        mark = np.where(first, "", np.where(fresh, ";", np.where(np.diff(side, prepend=0) != 0, "|", ",")))
        words = list(map("".join, zip(mark.tolist(), map(str, ids.tolist()), strict=True)))
        ends = np.cumsum(na + nb)
        of_a, of_b = overlaps(a0, a1, b0, b1)
        links = ia[of_a] << B_BITS | ib[of_b]
        n_links = np.bincount(sa[of_a], minlength=len(new))
        counts = np.stack([na, nb, np.bincount(stretch[fresh], minlength=len(new)), n_links, bad], axis=1)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.written += ["".join(words[e - k : e]) for e, k in zip(ends.tolist(), (na + nb).tolist(), strict=True)]
        self.counts = np.concatenate((self.counts, counts))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(n_links)))
        self.links = np.concatenate((self.links, links))

    def links_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links of these stretches, and which of them each is of."""
        n = self.at[some + 1] - self.at[some]
        of = np.repeat(np.arange(len(some)), n)
        return self.links[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[some], n)], of


@dataclass
class Aligned:
    """A batch of documents: counts, groups' text, and each one's distinct pairs with how often it has them, in order."""

    counts: np.ndarray
    groups: list[str]
    at: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def align_texts(texts: list[str | None], known: Stretches) -> Aligned:
    cut = [stretches(t) if t else [] for t in texts]
    if len(known.number) > KNOWN_STRETCHES:
        known.forget()
    known.learn(cut)
    lists = [np.fromiter(map(known.number.__getitem__, c), np.int64, len(c)) for c in cut]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat, doc = np.concatenate([np.zeros(0, np.int64), *lists]), np.repeat(np.arange(len(texts)), n)
    bad = np.bincount(doc, known.counts[flat, 4], len(texts)) > 0
    stay = ~bad[doc]
    flat, doc = flat[stay], doc[stay]
    counts = np.stack([np.bincount(doc, known.counts[flat, k], len(texts)).astype(np.int64) for k in range(4)], axis=1)
    written = known.written
    groups = ["" if k else ";".join([written[i] for i in x.tolist()]) for x, k in zip(lists, bad, strict=True)]
    links, of = known.links_of(flat)
    key, found = pd.factorize(doc[of] << 32 | links)
    order = np.argsort(found)
    times = np.bincount(key, minlength=len(found))[order]
    found = found[order]
    return Aligned(counts, groups, np.searchsorted(found >> 32, np.arange(len(texts) + 1)), found & 0xFFFFFFFF, times)


def _in_batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of some documents; a batch ends with the document that fills it."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch["doc_id"], batch["text"], strict=True):
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t)
            size += len(t or "")
            if size >= BATCH_CHARS or len(texts) >= 10_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_COLUMNS = ("doc_id", *_COUNTS, "groups_sha256", "block", "links", "block_pairs", "block_docs")
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, links binary, block_pairs array<int>, block_docs array<int>"


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document, written once. ``links`` packs its distinct pairs (a << 15 | b) and then their numbers; a block's last row has its pairs and how many of its documents have each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, block, held = Stretches(load(a_path, b_path)), TaskContext.get().partitionId() << 24, []
        size = 0

        def summed() -> pd.DataFrame:
            pairs, docs = np.unique(np.concatenate(held), return_counts=True)
            row = dict.fromkeys(_COLUMNS) | {"block": block, "block_pairs": pairs.astype(np.int32), "block_docs": docs.astype(np.int32)}
            return pd.DataFrame([row], dtype=object)

        for ids, texts in _in_batches(batches):
            made = align_texts(texts, known)
            out = pd.DataFrame(made.counts, columns=list(_COUNTS))
            out.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
            out["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in made.groups]
            out["block"] = block
            pairs, times = made.pairs.astype("<u4"), made.times.astype("<u4")
            out["links"] = [pairs[x:y].tobytes() + times[x:y].tobytes() for x, y in zip(made.at[:-1].tolist(), made.at[1:].tolist(), strict=True)]
            out["block_pairs"] = out["block_docs"] = None
            held.append(pairs)
            size += len(pairs)
            full = size >= BLOCK_PAIRS
            yield out
            if full:
                yield summed()
                block, held, size = block + 1, [], 0
        if held:
            yield summed()

    return stored(docs.select("doc_id", "text").mapInPandas(run, _ALIGNED), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, docs, best: in how many documents the ids are linked, and whether no pair of the same A id has more."""
    each = blocks.filter("block_pairs is not null").select(F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("p"))
    counts = each.groupBy(F.col("p.block_pairs").alias("pair")).agg(F.sum("p.block_docs").alias("docs"))
    counts = counts.withColumn("a", F.shiftrightunsigned("pair", B_BITS))
    most = counts.groupBy(F.col("a").alias("of_a")).agg(F.max("docs").alias("most"))
    return counts.join(most, F.col("a") == F.col("of_a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row a document with n_best and count_sum: its links by the corpus-wide counts of their pairs."""
    needs = blocks.filter("block_pairs is not null").select("block", F.explode("block_pairs").alias("pair"))
    given = needs.join(counts, "pair").select(F.col("block").alias("of_block"), "pair", "docs", "best")
    rows = blocks.filter("links is not null").select("doc_id", *_COUNTS, "groups_sha256", "block", "links")

    def score(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values("pair")
        code, count, best = pairs["pair"].to_numpy(np.int64), pairs["docs"].to_numpy(np.int64), pairs["best"].to_numpy(bool)
        packed = [np.frombuffer(x, "<u4").reshape(2, -1) for x in docs["links"]]
        n = np.fromiter((x.shape[1] for x in packed), np.int64, len(packed))
        both = np.concatenate(packed, axis=1).astype(np.int64)
        at = np.searchsorted(code, both[0])
        sums = np.concatenate(([0], np.cumsum(both[1] * count[at]))), np.concatenate(([0], np.cumsum(both[1] * best[at])))
        ends = np.cumsum(n)
        out = docs[["doc_id", *_COUNTS]].astype({"doc_id": "Int64"})
        out["n_best"], out["count_sum"] = sums[1][ends] - sums[1][ends - n], sums[0][ends] - sums[0][ends - n]
        out["groups_sha256"] = docs["groups_sha256"].to_numpy()
        return out

    return rows.groupBy("block").cogroup(given.groupBy("of_block")).applyInPandas(score, _SCORED)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document: token, group and link counts, links scored by corpus-wide counts, digest of the groups."""
    blocks = aligned_blocks(docs, a_path, b_path)
    return scored(blocks, stored(pair_counts(blocks), "pair-counts"))


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a group: doc_id, its number in the document from 0, and the ids of either tokenizer in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Stretches(load(a_path, b_path))
        for ids, texts in _in_batches(batches):
            for i, text in zip(ids, align_texts(texts, known).groups, strict=True):
                groups = text.split(";") if text else []
                for at in range(0, len(groups), 10_000):
                    some = [g.split("|") for g in groups[at : at + 10_000]]
                    out = pd.DataFrame({"doc_id": pd.array([i] * len(some), dtype="Int64"), "group": range(at, at + len(some))})
                    for k, name in enumerate(("a_ids", "b_ids")):
                        out[name] = [list(map(int, g[k].split(","))) for g in some]
                    yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, group long, a_ids array<int>, b_ids array<int>")
