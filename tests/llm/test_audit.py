import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, documents, prose
from tidemark.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, source string"


def brute(docs, labels):
    """Every order applied one filter after another."""
    ids = defaultdict(list)
    for d, t, _ in docs:
        if d is not None:
            ids[t or ""].append(d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}

    def fails(d, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = set()
        if len(words) < 50:
            out.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            out.add("C")
        if re.search(r"[#$%&*|]", t):
            out.add("D")
        if d is not None and any(x < d for x in ids[t]):
            out.add("E")
        return out

    parts = defaultdict(list)
    for d, t, s in docs:
        parts[s or ""].append((d, fails(d, t)))
    rows = {}
    for part, of in parts.items():
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = of
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                earlier = [x for x in of if f in x[1] and x not in left]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                rows[part, "".join(order), k] = [len(left), len(gone), sum(f in x[1] for x in of) - len(gone), sum(x[1] == {f} for x in of), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f]
                assert len(earlier) <= len(of)
        for (p, _, _), r in rows.items():
            if p == part:
                r[6] = total[r[6]]
    return {k: tuple(v) for k, v in rows.items()}


def audited(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:3]: r[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_every_order_applied_in_turn(spark):
    rng = random.Random(5)
    docs = awkward()
    for i in range(60):
        text = prose(rng, rng.choice([10, 49, 50, 51, 90]))
        text = text.upper() if i % 7 == 0 else text + " #*|" if i % 5 == 0 else " ".join([text] * 3) if i % 4 == 0 else text
        docs.append((200 + i, text, "en", f"src{i % 3}"))
    docs += [(300 + i, docs[-1 - i][1], "en", "src1") for i in range(5)] + [(7, docs[3][1], "en", "src9")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 0, 0), (6, None, None), (None, 1, 1), (9999, 1, 1)]
    df = documents(spark, docs).repartition(3)
    lab = spark.createDataFrame([(a, b, None if c is None else int(c), "clash") for a, b, c in labels], LABELS)
    got = audited(filter_audit.audit_filters(df, lab))
    want = brute([(d, t, s) for d, t, _, s in docs], [(a, b, c) for a, b, c in labels])
    assert got == want
    assert {k[0] for k in got} >= {"", "src0", "src9"}


def test_a_very_long_text_and_many_copies(spark):
    rng = random.Random(6)
    long = prose(rng, 400_000)
    docs = [(1, long, "en", "a"), (2, long, "en", "a"), (3, long + "x", "en", None)] + [(10 + i, "same words " * 30, "en", "a") for i in range(500)]
    got = audited(filter_audit.audit_filters(documents(spark, docs), spark.createDataFrame([(2, 1, 0, "x")], LABELS)))
    assert got["a", "EABCD", 1][:2] == (2, 500) and got["a", "EABCD", 1][4] == 1
    assert got["", "BACDE", 1][:2] == (0, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_filters(spark.createDataFrame([], DOCS), none).count() == 0
    got = audited(filter_audit.audit_filters(documents(spark, [(1, "a", "en", "s")]), none))
    assert len(got) == 600 and got["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_potential_gives_shapley_values_of_any_game():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5):
        v = filter_audit.removal_game(rng.integers(0, 50, (4, 1 << n)), n)
        p = filter_audit.potentials(v, n)
        for i in range(n):
            rest = ((1 << n) - 1) & ~(1 << i)
            want = np.zeros(4, np.int64)
            for order in permutations(range(n)):
                before = sum(1 << j for j in order[: order.index(i)])
                want += v[:, before | 1 << i] - v[:, before]
            assert (p[:, -1] - p[:, rest] == want).all()


def test_other_filters_and_no_copies_filter(spark):
    df = documents(spark, [(1, "abc", "en", "s"), (2, "x", "en", "s"), (3, None, "en", "s")])
    failed = filter_audit.failures(df, {"short": F.char_length("text") < 2, "b": F.col("text").contains("b")}, copies=None)
    got = audited(filter_audit.audit(filter_audit.set_counts(failed, spark.createDataFrame([], LABELS)), "XY"))
    assert got["s", "XY", 1][:2] == (1, 2) and got["s", "XY", 2][:2] == (0, 1) and len(got) == 4
