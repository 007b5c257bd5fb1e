import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, block int, fp string, key string"

ENGLISH = "the and of to in is that it was for on with as his they at be this have from or had by hot word but what some we can out other were all there when up use your how said an each she".split()


def prose(rng, n):
    return " ".join(rng.choice(ENGLISH) + rng.choice(["", "", "ing", "ed", "s"]) for _ in range(n))


def documents(spark, texts, extra=True):
    """Rows from texts or (doc_id, text, lang, source); extra columns have names that operators use inside."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text, lang, source = t if isinstance(t, tuple) else (i, t, "en", "src0")
        rows.append((doc_id, text, lang, source, len(text or ""), "s", 7, "f", "k"))
    return spark.createDataFrame(rows, DOCS)


def awkward(seed=3):
    """Nulls, empty and long texts, copies, repeated rows, null ids and sources."""
    rng = random.Random(seed)
    base = prose(rng, 400)
    out = [(i, prose(rng, rng.randrange(1, 80)), "en", f"src{i % 3}") for i in range(40)]
    out += [(40, None, None, None), (41, "", "en", ""), (42, "   \n\t ", "en", "src0"), (43, base, "en", "src1"), (44, base.upper(), "en", "src1"), (45, base + " tail", "en", "src2")]
    out += [(46, "É" * 5 + "Straße 东京 \x1c x y", "de", "src2"), (47, ("x" * 999 + " ") * 60, "en", "src0"), (None, "no id here", "en", "src0"), (None, base, "fr", None), (48, base, "en", "src1"), (48, base, "en", "src1"), (49, "same id", "en", "a"), (49, "other text", "en", "a")]
    return out
