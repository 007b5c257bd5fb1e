import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.helpers import DOCS, ENGLISH, awkward, documents, prose
from tests.llm.test_dedup import lowered
from tidemark.llm import bpe, langid, simhash


def order(x):
    return (x[0] is None, x[0] or 0, x[1] or "")


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=order)


def brute_language(rows):
    """What stays is what has a letter and some likeness to a language's bundle."""
    sums = defaultdict(lambda: 0)
    for r in rows:
        if not r["held"] and r["lang"] and langid.has_letter(r["text"]):
            sums[r["lang"]] = sums[r["lang"]] + langid.bundles([r["text"]])[0].astype(float)
    proto = [v / np.linalg.norm(v) for v in sums.values()]
    keep = [r for r in rows if langid.has_letter(r["text"]) and max(float(langid.bundles([r["text"]])[0] @ p) for p in proto) >= 0.05]
    return sorted(((r["doc_id"], r["text"]) for r in keep), key=order)


def brute_exact(rows):
    best = {}
    for d, t in rows:
        k = lowered(t)
        if k not in best or (d is not None and (best[k][0] is None or d > best[k][0])):
            best[k] = (d, t)
    return Counter((d, lowered(t)) for d, t in best.values())


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_near(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append((d is None, d))
    return Counter(min(g)[1] for g in groups.values())


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(1)
    long = prose(rng, 600)
    docs = awkward() + [(100 + i, prose(rng, 50), "en", f"s{i % 4}") for i in range(80)] + [(300 + i, long + " z" * i, "en", "s1") for i in range(4)]
    df = documents(spark, docs)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    stages, at, sf_dir = dict(corpus_pipeline.STAGES), df, str(tmp_path)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]

    def then(name):
        out = stages[name](spark, at, sf_dir)
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    want = brute_language(at.withColumn("held", langid.held_out(at["doc_id"])).collect())
    at = then("language_id")
    assert rows_of(at) == want and len(want) == len(docs) - 4
    want = brute_exact(rows_of(at))
    at = then("exact_dedup")
    assert Counter((d, lowered(t)) for d, t in rows_of(at)) == want
    want = brute_near(rows_of(at))
    at = then("near_dedup")
    assert Counter(d for d, _ in rows_of(at)) == want

    size = lambda t: len((t or "").encode().split())
    before = at.select("doc_id", "text", "source").collect()
    at = then("mixing")
    times = Counter((r["doc_id"], r["text"]) for r in at.collect())
    assert all(times[r["doc_id"], r["text"]] <= 2 for r in before)
    total = sum(size(r["text"]) for r in before)
    taken = sum(size(t) * n for (_, t), n in times.items())
    assert abs(taken - 1.5 * total) < 0.05 * total

    enc = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    last = stages["byte_bpe"](spark, at, sf_dir)
    want = Counter((d, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows_of(at))
    assert Counter(tuple(r) for r in last.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def edited(rng, words, part):
    """Words replaced, put in and left out, spread over the text or in one stretch."""
    words, n = list(words), max(1, round(part * len(words)))
    spots = rng.sample(range(len(words)), n) if rng.random() < 0.7 else range((at := rng.randrange(len(words) - n + 1)), at + n)
    for k in sorted(spots, reverse=True):
        what = rng.random()
        words[k : k + 1] = [] if what < 0.2 else ["new" + prose(rng, 1)] if what < 0.8 else [words[k], "more"]
    return words


def test_recall_of_texts_alike_by_length(spark):
    rng, docs, classes = random.Random(4), [], {}
    word = lambda: rng.choice(ENGLISH) + rng.choice(ENGLISH[::3] + [""] * 8)
    for low, high, n in ((20, 49, 120), (50, 149, 120), (150, 399, 100), (400, 1499, 60), (1500, 4000, 30)):
        pairs = []
        while len(pairs) < n:
            base = [word() for _ in range(rng.randrange(low, high))]
            other = edited(rng, base, rng.uniform(0.003, 0.025))
            if alike(shingles(" ".join(base)), shingles(" ".join(other))) and base != other:
                pairs.append((len(docs), len(docs) + 1))
                docs += [" ".join(base), " ".join(other)]
        classes[low] = pairs
    alone = [" ".join(word() for _ in range(rng.randrange(20, 400))) for _ in range(400)]
    half = [" ".join(d.split()[: len(d.split()) // 2]) for d in docs[:400:2]]  # alike in part only
    got = {r["doc_id"]: r["root"] for r in simhash.similar_groups(documents(spark, docs + alone + half)).collect()}
    recall = {low: np.mean([got[a] == got[b] for a, b in pairs]) for low, pairs in classes.items()}
    print("recall by least words", recall)
    assert min(recall.values()) >= 0.9, recall
    groups = Counter(got.values())
    assert all(groups[got[len(docs) + i]] == 1 for i in range(len(alone) + len(half)))


def test_the_grid_grows_with_the_texts():
    sizes = [simhash.grid(n) for n in (0, 10, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == sizes[1] and sizes[-1][0] > 18 and sizes[-1][1] < 250
    cells, sift, shingles = simhash.long_fingerprint("a b c d e f " * 9, *sizes[-1])
    assert len(cells) == sizes[-1][1] and cells.max() < 3 ** sizes[-1][0] and sift and len(shingles) == 6


def test_a_dense_group_is_one_component(spark):
    """A thousand edits of one text, most pairs of which are alike."""
    rng = random.Random(7)
    base = prose(rng, 200).split()
    docs = [" ".join([*base[:k], f"w{i}", *base[k + 1 :]]) for i in range(1000) for k in [rng.randrange(200)]] + [prose(rng, 200) for _ in range(50)]
    roots = [r["root"] for r in simhash.similar_groups(documents(spark, docs)).orderBy("doc_id").collect()]
    assert len(set(roots[:1000])) == 1 and len(set(roots)) == 51


def partition(keys, root_of):
    groups = defaultdict(set)
    for k in keys:
        groups[root_of(k)].add(k)
    return sorted(map(sorted, groups.values()))


def brute_groups(docs):
    sets, root = [shingles(t) for t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    return partition(range(len(docs)), find)


def around_the_limit():
    """Short and long pairs just alike and just not, a dense group of borderline edits, a passage that most texts hold, copies."""
    rng, docs, passage = random.Random(21), [], prose(random.Random(5), 40)
    word = lambda: rng.choice(ENGLISH) + rng.choice(ENGLISH)
    for n in [5, 6, 9, 10, 12, 15, 20, 25, 30, 40, 60, 90, 150, 300] * 12:
        base = [word() for _ in range(n)]
        docs += [" ".join(base), " ".join(edited(rng, base, rng.uniform(0.01, 0.05)))]
        docs.append(" ".join(base[: round(n * rng.uniform(0.76, 0.84))]))
    base = [word() for _ in range(120)]
    for _ in range(250):
        some = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 2, 3])):
            some[k] = word()
        docs.append(" ".join(some))
    docs += [prose(rng, rng.randrange(1, 30)) + " " + passage for _ in range(150)]
    return docs + docs[:20] + ["", " ", "one", "One", "one two"]


def test_no_link_is_lost(spark, monkeypatch):
    docs = around_the_limit()
    want = brute_groups(docs)
    df = documents(spark, docs).select("doc_id", "text").localCheckpoint()

    def got():
        root = {r["doc_id"]: r["root"] for r in simhash.similar_groups(df).collect()}
        return partition(range(len(docs)), root.get)

    assert got() == want
    # Leaders and the order of shingles are aids only: hardly any leader, and hardly a known shingle, and the groups are the same.
    monkeypatch.setattr(simhash, "SIFT_MOST", -1)
    monkeypatch.setattr(simhash, "ORDER_SHINGLES", 3)
    assert got() == want


def test_first_shingles_of_sets_alike_meet():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randrange(1, 60)
        x, y = set(rng.sample(range(80), n)), set()
        while not (y and alike(x, y)):
            y = set(x) ^ set(rng.sample(range(80), rng.randrange(0, n // 4 + 1)))
        short, long = sorted([x, y], key=len)
        assert set(sorted(short)[: simhash.prefixes(len(short))[1]]) & set(sorted(long)[: simhash.prefixes(len(long))[0]])
        bits = [simhash.parity_bits(np.array(sorted(s), "<u4")) for s in (x, y)]
        assert sum(int(k).bit_count() for k in (bits[0] ^ bits[1]).view(np.uint64)) <= len(x ^ y)


def across(spark, monkeypatch, docs):
    """Groups of texts where hardly any leader helps, and pairs: those that leave the exact join, distinct ones, and those whose sets are compared."""
    df = documents(spark, docs).select("doc_id", "text").localCheckpoint()
    within, pairs, compared = [], [], []
    links, alike_of, distinct = simhash.links_across, simhash._alike, type(df).distinct

    def marked(*a):
        within.append(1)
        return links(*a)

    def counted(some):
        if within and some.columns == ["a", "b"]:
            pairs.append((some.count(), distinct(some).count()))
        return distinct(some)

    def verified(some, *a):
        if within:
            compared.append(some.count())
            within.clear()
        return alike_of(some, *a)

    monkeypatch.setattr(simhash, "SIFT_MOST", -1)
    monkeypatch.setattr(simhash, "links_across", marked)
    monkeypatch.setattr(simhash, "_alike", verified)
    monkeypatch.setattr(type(df), "distinct", counted)
    root = {r["doc_id"]: r["root"] for r in simhash.similar_groups(df).collect()}
    return partition(range(len(docs)), root.get), *pairs[0], compared[0]


def test_a_pair_leaves_the_join_once(spark, monkeypatch):
    """Edits of one text, most pairs of which are nearly alike, share most cells."""
    rng, docs = random.Random(8), []
    base = [prose(rng, 1) + f"q{i}" for i in range(300)]
    for i in range(120):
        some = list(base)
        for k in rng.sample(range(300), 4):
            some[k] = f"w{i}"
        docs.append(" ".join(some))
    groups, rows, pairs, _ = across(spark, monkeypatch, docs)
    assert groups == brute_groups(docs)
    assert pairs > 500 and rows < 1.5 * pairs, (rows, pairs)


def test_pairs_grow_as_a_dense_group(spark, monkeypatch):
    """Loose edits of one text, about half of the pairs alike: few pairs a text are left to the exact join, at either size."""
    meetings, left = simhash.meetings, []

    def counted(*a):
        left.append((met := meetings(*a).localCheckpoint()).count())
        return met

    monkeypatch.setattr(simhash, "meetings", counted)
    rng, docs = random.Random(12), []
    base = [prose(rng, 1) + f"q{i}" for i in range(150)]
    for i in range(800):
        some = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 2, 2, 3])):
            some[k] = f"w{i}"
        docs.append(" ".join(some))
    for n in (200, 800):
        root = {r["doc_id"]: r["root"] for r in simhash.similar_groups(documents(spark, docs[:n])).collect()}
        assert partition(range(n), root.get) == brute_groups(docs[:n])
    assert left[0] < 4 * 200 and left[1] < 4 * 800, left


def test_long_texts_that_share_little_are_not_compared(spark, monkeypatch):
    """Longer than parity bits can tell: any two share three runs of words that no other has, and two are alike."""
    rng, n = random.Random(9), 25
    words = [[f"x{i}y{k}" for k in range(2400)] for i in range(n)]
    for i in range(n):
        for j in range(i):
            for r in range(3):
                for of in (i, j):
                    at = 10 * (3 * (i + j if of == i else 100 + i + j) + r)
                    words[of][at % 2390 : at % 2390 + 5] = [f"r{i}_{j}_{r}_{k}" for k in range(5)]
    docs = [" ".join(w) for w in words]
    docs += [" ".join(edited(rng, words[0], 0.01)), " ".join(words[1][:2100])]
    groups, _, pairs, compared = across(spark, monkeypatch, docs)
    assert groups == brute_groups(docs) and sum(len(g) == 2 for g in groups) == 2
    assert pairs > 30 and compared <= 4, (pairs, compared)


def test_tallies_differ_no_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n in [0, 1, 5, 40, 250, 255, 256, 257, 300, 511, 513, 700, 2000, 5000] * 8:
        x = rng.choice(1 << 32, n, replace=False).astype("<u4")
        y = np.concatenate([x[rng.random(n) > 0.1], rng.choice(1 << 32, n // 10, replace=False).astype("<u4")])
        if rng.random() < 0.3:  # all in one bucket
            x, y = x // 4096 * 4096, y // 4096 * 4096
        x, y = np.unique(x), np.unique(y)
        assert simhash.tallies_differ(simhash.tally(x), simhash.tally(y)) <= len(np.setxor1d(x, y))
        z = np.unique(rng.choice(1 << 32, n, replace=False).astype("<u4"))
        if n >= 250 and x.max() % 4096:
            assert simhash.tallies_differ(simhash.tally(x), simhash.tally(z)) > (len(x) + len(z)) / 9


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
