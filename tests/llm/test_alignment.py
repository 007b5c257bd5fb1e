import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import DOCS, awkward, documents, prose
from tidemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_one(text):
    """Whole text through both libraries; groups and links by comparing every token with every other near it."""
    pair = alignment.load(A, B)
    if not text:
        return None
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    whole = (" " + text).encode()
    sides = []
    for ids, of in ((a, pair.a_bytes), (b, pair.b_bytes)):
        if b"".join(of[i] for i in ids) != whole:
            return None
        at, spans = 0, []
        for i in ids:
            spans.append((at, at + len(of[i]), i))
            at += len(of[i])
        sides.append(spans)
    ends = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
    groups, ia, ib = [], iter(sides[0]), iter(sides[1])
    links = []
    for end in ends:
        some = []
        for it in (ia, ib):
            part = []
            while not part or part[-1][1] < end:
                part.append(next(it))
            some.append(part)
        groups.append("|".join(",".join(str(i) for *_, i in part) for part in some))
        links += [(x[2], y[2]) for x in some[0] for y in some[1] if x[0] < y[1] and y[0] < x[1]]
    return len(a), len(b), groups, links


def brute(docs):
    one = [(d, brute_one(t)) for d, t in docs]
    held = Counter(p for _, r in one if r for p in set(r[3]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for d, r in one:
        if r is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, links = r
            out.append((d, na, nb, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return Counter(out)


def hostile():
    rng = random.Random(8)
    signs = ["a", "bc", "word", "It's", "don't", "12", "3.5", " ", "  ", "   ", "\n", "\n\n", "\t", " \n ", " ", "\u0085", "　", " ", "é", "ß", "東京", "語", "🙂", "👩‍👩‍👧", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\x00", "\x1c", "​", "᠎", ".", "...", "#$", "'", "ing", "́", "ﬁ", "﻿"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    return [*texts, "a▁b", "▁", " ", "  ", "\n", "x  ", "  x", "a\n  b", "a \n b", "a  \n", "x" * 5000, ("ab" * 40 + " ") * 300, "\U0001f1e9\U0001f1ea" * 9]


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_equals_brute_force(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(hostile())] + [(t[0], t[1]) if isinstance(t, tuple) else (None, t) for t in awkward()] + [(5, "repeated row")] * 3
    df = documents(spark, [(d, t, "en", "s") for d, t in docs]).repartition(3)
    assert rows(alignment.align(df, A, B)) == brute(docs)


def test_small_blocks_batches_and_caches_change_nothing(monkeypatch):
    texts = hostile() + [None, ""]
    whole = alignment.align_texts(texts, alignment.Stretches(alignment.load(A, B)))
    monkeypatch.setattr(alignment, "KNOWN_STRETCHES", 20)
    known, at = alignment.Stretches(alignment.load(A, B)), 0
    for k in range(0, len(texts), 7):
        some = alignment.align_texts(texts[k : k + 7], known)
        assert some.groups == whole.groups[k : k + 7] and (some.counts == whole.counts[k : k + 7]).all()
        n = len(some.pairs)
        assert (some.pairs == whole.pairs[at : at + n]).all() and (some.times == whole.times[at : at + n]).all()
        at += n
    assert at == len(whole.pairs)


def test_a_very_long_text(spark):
    rng = random.Random(3)
    text = "\n".join(prose(rng, 400) for _ in range(200)) + "  end"
    docs = [(1, text), (2, "a short one"), (3, text[:50_000])]
    assert len(text) > 400_000
    assert rows(alignment.align(documents(spark, [(d, t, "en", "s") for d, t in docs]), A, B)) == brute(docs)


def test_groups_as_rows(spark):
    texts = {1: "Tokenization aligns", 2: None, 3: "a▁b"}
    got = alignment.token_groups(documents(spark, [(d, t, "en", "s") for d, t in texts.items()]), A, B).orderBy("doc_id", "group").collect()
    want = brute_one(texts[1])[2]
    assert [(r["doc_id"], r["group"], "|".join(",".join(map(str, x)) for x in (r["a_ids"], r["b_ids"]))) for r in got] == [(1, i, g) for i, g in enumerate(want)]


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).count() == 0
    assert rows(alignment.align(documents(spark, [(1, None, "en", "s"), (None, "", "en", "s")]), A, B)) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])


@pytest.mark.parametrize("seed", range(5))
def test_coalescing_of_any_intervals(seed):
    """Intervals with gaps, and many within one."""
    rng = np.random.default_rng(seed)
    sides = []
    for _ in range(2):
        cuts = np.unique(rng.integers(0, 200, 60))
        keep = rng.random(len(cuts) - 1) < 0.8
        sides.append((cuts[:-1][keep], cuts[1:][keep]))
    (a0, a1), (b0, b1) = sides
    starts, ends = np.concatenate((a0, b0)), np.concatenate((a1, b1))
    order, group = alignment.coalesce(starts, ends)
    of = np.empty(len(order), int)
    of[order] = group
    for i in range(len(starts)):
        for j in range(len(starts)):
            if starts[i] < ends[j] and starts[j] < ends[i]:
                assert of[i] == of[j]
    # No group can be cut in two.
    for g in range(group[-1] + 1):
        inside = np.flatnonzero(of == g)
        for x in np.unique(starts[inside])[1:]:
            assert ((starts[inside] < x) & (ends[inside] > x)).any()
    got = set(zip(*map(np.ndarray.tolist, alignment.overlaps(a0, a1, b0, b1)), strict=True))
    assert got == {(i, j) for i in range(len(a0)) for j in range(len(b0)) if a0[i] < b1[j] and b0[j] < a1[i]}
