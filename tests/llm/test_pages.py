"""The block labeller on page structures that its training pages don't have."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import prose
from tests.llm.test_text import pages
from tidemark.llm import html_text


def held_out(rng):
    """(structure, page, main text); the training pages have one structure, nav, advert, article, footer."""

    def text(low=15, high=60):
        return prose(rng, rng.randrange(low, high))

    def short(low=1, high=4):
        return prose(rng, rng.randrange(low, high))

    def links(n):
        return "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(n))

    blocks = [("h1", short(3, 8)), *(("p", text()) for _ in range(rng.randrange(3, 8)))]
    main = " ".join(t for _, t in blocks)
    spelled = ["".join(f"<{t}>{x}</{t}>" for t, x in some) for some in (blocks, blocks[:2], blocks[2:])]
    comments = "".join(f'<div class="comment"><b>{short(1, 2)}</b><p>{text(3, 20)}</p></div>' for _ in range(rng.randrange(1, 4)))
    out = {
        "comments in the article": f'<nav><ul>{links(5)}</ul></nav><article>{spelled[0]}<section class="comments"><h2>Comments</h2>{comments}</section></article><footer>&copy; {short()}</footer>',
        "named divs": f'<div class="header"><a href="/">{short()}</a></div><div class="menu"><ul>{links(6)}</ul></div><div class="content">{spelled[0]}</div><div class="sidebar"><h3>{short()}</h3><ul>{links(4)}</ul></div><div class="footer">{short()} <a href="#">{short()}</a></div>',
        "unnamed divs": f'<div><a href="/">{short()}</a> <a href="/b">{short()}</a></div><div><ul>{links(6)}</ul></div><div>{spelled[0]}</div><div><ul>{links(4)}</ul></div><div>&copy; {short()} <a href="#">{short()}</a></div>',
        "main with an aside": f'<header><h2>{short()}</h2><nav><a href="/x">{short()}</a> <a href="/y">{short()}</a></nav></header><main>{spelled[0]}<aside><h4>{short()}</h4><p>{text(5, 20)}</p></aside></main><div id="cookie-banner"><p>{text(6, 20)}</p><button>{short()}</button></div>',
        "advert within": f'<div class="topbar"><ul>{links(3)}</ul></div><article class="post">{spelled[1]}<div class="advert"><p>{text(5, 20)}</p></div>{spelled[2]}</article><div class="newsletter"><form><label>{short()}</label><input><button>{short()}</button></form></div>',
        "deep wrappers": f'<div class="page"><div class="wrap"><div class="col-8"><div class="entry-content">{spelled[0]}</div></div><div class="col-4 widget"><p>{text(4, 15)}</p><ul>{links(5)}</ul></div></div></div><div class="legal"><p>{text(5, 15)}</p></div>',
    }
    return [(name, f"<html><body>{page}</body></html>", main) for name, page in out.items()]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(pages(spark)[1])


def test_precision_and_recall_on_other_structures(model):
    rng, seen = random.Random(1), {}
    for _ in range(30):
        for name, page, main in held_out(rng):
            blocks = html_text.leaves(page)
            got = Counter(w for (_, text, _), is_main in zip(blocks, model.label([html_text.features(blocks)])[0]) if is_main for w in text.split())
            want = Counter(main.split())
            counts = seen.setdefault(name, np.zeros(3))
            counts += [sum((got & want).values()), sum(got.values()), sum(want.values())]
    precision, recall = {k: c[0] / max(1, c[1]) for k, c in seen.items()}, {k: c[0] / c[2] for k, c in seen.items()}
    assert min(precision.values()) >= 0.85 and min(recall.values()) >= 0.95, (precision, recall)
    assert np.mean(list(precision.values())) >= 0.95 and np.mean(list(recall.values())) >= 0.98


def test_a_very_long_page_is_read_whole(spark, model):
    rng = random.Random(2)
    parts = [prose(rng, 40) for _ in range(2000)]
    page = "<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article>" + "".join(f"<p>{p}</p>" for p in parts * 40) + "</article><footer>&copy; foot</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    r = html_text.extract(df, model).first()
    assert len(page) > 15_000_000 and r["n_chars"] == len(r["text"])
    assert r["text"].count(parts[1999]) == 40 and "foot" not in r["text"][-40:]


def a_long_page(rng, paragraphs):
    """A page of a menu, an article of many paragraphs, a sidebar and a footer, and its main text."""
    text = [prose(rng, rng.randrange(20, 60)) for _ in range(paragraphs)]
    menu = "".join(f'<li><a href="/{i}">{prose(rng, 2)}</a></li>' for i in range(6))
    body = "".join(f"<p>{t}</p>" for t in text)
    return f'<html><body><nav><ul>{menu}</ul></nav><article>{body}</article><aside class="sidebar"><p>{prose(rng, 12)}</p></aside><footer><p>&copy; {prose(rng, 3)}</p></footer></body></html>', " ".join(text)


@pytest.mark.parametrize("short", [0, 1])
def test_tables_of_long_pages(spark, short):
    rng = random.Random(6)
    made = [a_long_page(rng, 700) for _ in range(6)] + [a_long_page(rng, 6) for _ in range(short)]
    assert all(len(p) > 100_000 for p, _ in made[:6])
    df = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert [got[i] == text for i, (_, text) in enumerate(made)] == [True] * len(made)


def test_training_pieces_keep_what_lies_beside():
    page, _ = a_long_page(random.Random(1), 3000)
    piece = html_text.training_piece(page)
    assert len(piece) <= html_text.TRAIN_CHARS and piece.startswith("<html><body><nav>") and piece.endswith("</html>") and piece.count("<article>") == piece.count("</article>") == 1
    assert len(html_text.leaves(piece)) > 200 and html_text.training_piece("<p>x") == "<p>x"


def test_broken_and_deep_pages_take_time_in_proportion():
    pages_ = ["<a " * 400_000 + '"' + "<p>end</p>", "<div>x" * 200_000, "<div>x" * 100_000 + "</p>" * 100_000, '<p title="' * 100_000, "<article " * 120_000, "</" * 500_000, "<!--" * 300_000, "<script>" * 150_000, "<p a='" + "x>" * 500_000, "&amp" * 250_000]
    for page in pages_:
        began = time.perf_counter()
        html_text.leaves(page)
        html_text.made_pages(html_text.training_piece(page), np.random.default_rng(1), 1)
        assert time.perf_counter() - began < 20, page[:20]


def test_tags_with_quotes_and_brackets():
    def texts(page):
        return [t for _, t, _ in html_text.leaves(page)]

    assert texts('<p title="a > b">one</p><p title=it\'s>two</p>') == ["one", "two"]
    assert texts('<p title="open>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><p>x<!---->y</p>") == ["1 < 2 and 3 > 2", "xy"]
    assert texts("<SCRIPT>if (a</b) x('</p>')</SCRIPT ><p>a</p><style>p{}</styles></style>b<textarea>t</textarea>") == ["a", "b"]
    assert texts("<p>a</p></ ><p>b<br>c</p><![CDATA[z]]><p>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<script>never closed <p>b</p>") == ["a"]


def test_windows_of_long_training_pages():
    x, y = np.arange(1000.0)[:, None], np.arange(1000)
    starts = set()
    for seed in range(30):
        a, b = html_text.a_window(x, y, np.random.default_rng(seed), 100)
        assert len(a) == len(b) == 100 and (a[:, 0] == b).all()
        starts.add(int(b[0]))
    assert len(starts) > 20 and html_text.a_window(x, y, np.random.default_rng(0), 5000)[0].shape == (1000, 1)


def test_pages_without_a_marked_article_still_train(spark):
    df = spark.createDataFrame([(i, "u", f"<div><p>{'word ' * 30}</p></div>") for i in range(5)], "page_id long, url string, html string")
    assert html_text.main_text(df).count() == 5
