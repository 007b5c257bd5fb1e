"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks in page order. A block's input
is its tag path (names, classes and ids of the open elements, hashed with
signs), its hashed words and a few measures. A bidirectional LSTM in numpy
reads the whole sequence both ways and says for every block whether it is
main text, so a block is judged with all of its page in view.

The labeller is trained at call time on at most ``TRAIN_PAGES`` distinct pages,
drawn by a hash from those of any length that mark their article (article,
main): what lies in it is main text. Of a long page a stretch of the article
from anywhere in it, and what lies next to the article, are taken where the
page is read, ``TRAIN_CHARS`` characters at most. From each, pages are made
with menus, notices, adverts, sidebars, forms, headers and comments of known
label put in, and with the article element spelled in other ways.

Pages are read forward only: no sign of a broken page is looked at again for
every tag before it, and the sum of the open elements' vectors is carried
along, so a page costs as much as it is long, however deep.

Defined cases: null html is the empty page; a page without main text gives the
empty text; broken and unclosed markup is read as far as it goes; repeated
rows are extracted again; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import html as html_codes
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that training reads at most, characters of each at most, pages made of each, blocks of a training sequence at most, and the labeller's measures.
TRAIN_PAGES, TRAIN_CHARS, VARIANTS, TRAIN_BLOCKS = 120, 100_000, 6, 400
PATH_DIM, WORD_DIM, HIDDEN = 64, 16, 16
_INPUT = PATH_DIM + WORD_DIM + 3

# A tag without quotes that hold a bracket; tags that aren't so are read sign by sign.
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+)>""")
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_STOP = re.compile(r"""[>"']""")
_SKIPPED = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in "script style noscript template textarea svg".split()}
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BREAK_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    words = [tag]
    if attributes:
        for m in _NAMED.finditer(attributes):
            words += [w for w in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower()) if w and not w.isdigit()]
    return tuple(words)


@lru_cache(maxsize=20_000)
def _element_vector(element: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for word in element:
        h = zlib.crc32(b"path:" + word.encode("utf-8", "replace"))
        for k in (h, h // PATH_DIM // 2):
            v[k % PATH_DIM] += 1.0 if k // PATH_DIM % 2 else -1.0
    return v


def _tag_end(page: str, at: int, never: set[str]) -> int:
    """Where the tag that is open at ``at`` ends. A quote after = reaches to its like; ``never`` holds those that don't come again."""
    while m := _STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        if m[0] not in never and page[max(0, at - 65) : at - 1].rstrip().endswith("="):
            close = page.find(m[0], at)
            if close < 0:
                never.add(m[0])
            else:
                at = close + 1
    return len(page)


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash, name and attributes of the tags, in order; comments, declarations and elements whose contents are no text are nameless."""
    at, never = 0, set()
    while (at := page.find("<", at)) >= 0:
        if m := _TAG.match(page, at):
            end, slash, name, attributes = m.end(), m[1], m[2].lower(), m[3]
        elif m := _NAME.match(page, at):
            end, slash, name = _tag_end(page, m.end(), never), m[1], m[2].lower()
            attributes = page[m.end() : end - 1]
        elif page.startswith(("<!", "<?"), at):
            long = next((shut for sign, shut in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(sign, at)), ">")
            end = page.find(long, at + 2)
            end, slash, name, attributes = (len(page) if end < 0 else end + len(long)), "", "", ""
        elif page.startswith("</", at):
            end = page.find(">", at)
            end, slash, name, attributes = (len(page) if end < 0 else end + 1), "", "", ""
        else:
            at += 1
            continue
        if name in _SKIPPED and not slash:
            shut = _SKIPPED[name].search(page, end)
            end, name = (len(page) if not shut else _tag_end(page, shut.end(), never)), ""
        yield at, end, slash, name, attributes
        at = end


def leaves(page: str) -> list[tuple[np.ndarray, str, float]]:
    """Leaf blocks in page order: vector of the path of open block elements, text, part of the text in links."""
    out: list = []
    stack: list[tuple[str, np.ndarray]] = []
    opened: Counter[str] = Counter()
    path = np.zeros(PATH_DIM, np.float32)
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_codes.unescape("".join(parts)).split())
        if text:
            out.append((path.copy(), text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def leave() -> str:
        nonlocal path
        tag, vector = stack.pop()
        opened[tag] -= 1
        path -= vector
        return tag

    for start, end, slash, tag, attributes in tags(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if slash else 1
            continue
        flush()
        if tag in _VOID:
            continue
        if slash:
            if opened[tag]:
                while leave() != tag:
                    pass
            in_link = 0
            continue
        if tag in _BREAK_P and stack and stack[-1][0] == "p":
            leave()
        elif stack and stack[-1][0] in _SELF_CLOSING.get(tag, ()):
            leave()
        if not attributes.rstrip().endswith("/"):
            vector = _element_vector(_tokens(tag, attributes))
            stack.append((tag, vector))
            opened[tag] += 1
            path += vector
    add(page[at:])
    flush()
    return out


def features(blocks: list) -> np.ndarray:
    """A row of input a block."""
    x = np.zeros((len(blocks), _INPUT), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        x[i, :PATH_DIM] = path
        words = text.encode("utf-8", "replace").split()
        h = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(h % WORD_DIM, np.where(h // WORD_DIM % 2, 1.0, -1.0), WORD_DIM) / math.sqrt(len(words) + 1)
        x[i, -3:] = math.log1p(len(words)) / 5, linked, len(words) > 12
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


class Labeller:
    """Two LSTMs, one a direction, and a logistic output over both states."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        fan = _INPUT + HIDDEN
        self.w = {f"w{d}": (rng.standard_normal((fan, 4 * HIDDEN)) / math.sqrt(fan)).astype(np.float32) for d in "fb"}
        for d in "fb":
            self.w[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.w["out"] = (rng.standard_normal(2 * HIDDEN) / math.sqrt(2 * HIDDEN)).astype(np.float32)
        self.w["bias"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction; x is (time, batch, input), already in reading order."""
        w, b, n = self.w[f"w{d}"], self.w[f"b{d}"], HIDDEN
        h = np.zeros((x.shape[1], n), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], n), np.float32)
        given = x @ w[:_INPUT] + b
        for t in range(x.shape[0]):
            z = given[t] + h @ w[_INPUT:]
            i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            new = f * c + i * g
            tc = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((h, c, i, f, o, g, tc, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        a = self._run(x, mask, "f", keep and keep[0])
        b = self._run(x[::-1], mask[::-1], "b", keep and keep[1])[::-1]
        self.states = np.concatenate([a, b], axis=2) if keep else None
        return a @ self.w["out"][:HIDDEN] + b @ self.w["out"][HIDDEN:] + self.w["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: tuple[list, list] = ([], [])
        z = self.logits(x, mask, keep)
        dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / mask.sum()
        grad = {"out": np.einsum("tb,tbh->h", dz, self.states), "bias": dz.sum(keepdims=True)[0]}
        dh = dz[:, :, None] * self.w["out"]
        for d, seen, part, xs in (("f", keep[0], dh[:, :, :HIDDEN], x), ("b", keep[1], dh[::-1, :, HIDDEN:], x[::-1])):
            w = self.w[f"w{d}"]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            nh = np.zeros_like(part[0])
            nc = np.zeros_like(nh)
            for t in range(len(seen) - 1, -1, -1):
                h, c, i, f, o, g, tc, m = seen[t]
                full = nh + part[t]
                live = np.where(m, full, 0)
                dc = np.where(m, nc, 0) + live * o * (1 - tc * tc)
                gates = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), live * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                gw[:_INPUT] += xs[t].T @ gates
                gw[_INPUT:] += h.T @ gates
                gb += gates.sum(axis=0)
                nh = np.where(m, gates @ w[_INPUT:].T, full)
                nc = np.where(m, dc * f, nc)
            grad[f"w{d}"], grad[f"b{d}"] = gw, gb
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, rate: float = 0.02, batch: int = 32, seed: int = 4) -> Labeller:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, steps = 0, epochs * math.ceil(len(pages) / batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = [pages[i] for i in order[at : at + batch]]
                x, mask = padded([p[0] for p in some])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, label) in enumerate(some):
                    y[: len(label), k] = label
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For every page, which of its blocks are main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 512 and (end - at + 1) * len(pages[order[end]]) <= 40_000:
                end += 1
            some = order[at:end]
            x, mask = padded([pages[i] for i in some])
            z = self.logits(x, mask) > 0
            for k, i in enumerate(some):
                out[i] = z[: len(pages[i]), k]
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), _INPUT), np.float32)
    mask = np.zeros((longest, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# What boilerplate of the made training pages is built from: elements with names they go by, and contents.
_OTHER = (
    ("nav", "menu navigation navbar main-nav site-nav breadcrumbs pagination"),
    ("header", "site-header header masthead topbar page-header banner"),
    ("footer", "site-footer footer page-footer colophon copyright"),
    ("aside", "sidebar widget related related-posts trending recommended"),
    ("form", "search search-form login newsletter-form contact-form subscribe-form"),
    ("div section", "cookie cookie-notice cookie-banner notice consent gdpr alert newsletter subscribe promo modal popup"),
    ("div section p", "ad ads advert advertisement ad-banner sponsor sponsored promo adslot notice"),
    ("div section ul", "comments reader-comments comment-list responses discussion user-comments replies"),
    ("div section ul", "sidebar widget menu nav related related-posts share social tags breadcrumb author-bio"),
)
_CONTENT = (
    "{t}", "<p>{t}</p>", "<p>{t}</p><p>{u}</p>", "<h3>{s}</h3><p>{t}</p>", "<ul>{l}</ul>", "<h3>{s}</h3><ul>{l}</ul>", "<h2>{s}</h2><div class=\"comment\"><p>{t}</p></div><div class=\"comment\"><p>{u}</p></div>",
    "<article class=\"comment\"><p>{t}</p></article>", "<li><p>{t}</p></li><li>{u}</li>", "<a href=\"#\">{s}</a> <a href=\"#\">{s}</a>", "<p>{t}</p><label>{s}</label><input type=\"text\"><button>{s}</button>", "<div>{t} <button>{s}</button></div>",
)
_ARTICLE = ("article", "article", "article", "main", 'div class="article"', 'div class="article-body"', 'div class="post-content"', 'div class="entry-content"', 'div id="content"', 'section class="article-content"', 'article class="post"')
_OPEN, _SHUT = re.compile(r"<(article|main)\b[^<>]*>", re.IGNORECASE), re.compile(r"</(article|main)\s*>", re.IGNORECASE)
_MARK = "data-other"


def made_pages(page: str, rng: np.random.Generator, variants: int = VARIANTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled inputs from a page that marks its article: itself, and variants with boilerplate put in."""
    start = _OPEN.search(page)
    stop = next(iter(_SHUT.finditer(page, start.end())), None) if start else None
    if not stop:
        return []
    head, body, tail = page[: start.start()], page[start.end() : stop.start()], page[stop.end() :]
    words = re.sub(r"<[^>]*>", " ", body).split() or ["text"]

    def some(low: int, high: int) -> str:
        at = int(rng.integers(0, len(words)))
        return html_codes.escape(" ".join(words[at : at + int(rng.integers(low, high))]) or "text")

    def other() -> str:
        tags, names = (x.split() for x in _OTHER[int(rng.integers(len(_OTHER)))])
        tag = tags[int(rng.integers(len(tags)))]
        # An element that says nothing by itself always has a name.
        named = f' {("class", "id")[int(rng.random() < 0.2)]}="{names[int(rng.integers(len(names)))]}"' if rng.random() < 0.7 or tag in ("div", "section", "ul", "p") else ""
        shape = _CONTENT[int(rng.integers(len(_CONTENT)))] if tag != "p" else "{t}"
        links = "".join(f'<li><a href="#">{some(1, 4)}</a></li>' for _ in range(int(rng.integers(1, 6))))
        return f"<{tag}{named}>" + shape.format(l=links, t=some(2, 40), u=some(2, 40), s=some(1, 4)) + f"</{tag}>"

    out = []
    for v in range(variants + 1):
        wrap, before, inside, after = "article", "", ["", ""], ""
        if v:
            wrap = _ARTICLE[int(rng.integers(len(_ARTICLE)))]
            before = "".join(other() for _ in range(int(rng.integers(0, 3))))
            after = "".join(other() for _ in range(int(rng.integers(0, 3))))
            inside = [other() if rng.random() < 0.5 else "" for _ in range(2)]
        parts = re.split(r"(?<=</p>)", body)
        if v and rng.random() < 0.6:
            # Articles shorter and longer than the one there is, of its own paragraphs and of its words.
            drawn = rng.integers(-len(parts), len(parts), rng.integers(0, min(30, 4 * len(parts))))
            parts = [parts[0], *(parts[i] if i >= 0 else f"<p>{some(3, 100)}</p>" for i in drawn)]
        cut = int(rng.integers(0, len(parts) + 1)) if v else 0
        pieces = [(head + before, 0), (f"<{wrap}>", 0), ("".join(parts[:cut]), 1), (inside[0], 0), ("".join(parts[cut:]), 1), (inside[1], 0), (f"</{wrap.split()[0]}>", 0), (after + tail, 0)]
        # The label travels with the text as a marker word that is taken off again.
        text = "".join(re.sub(r">([^<>]*[^<>\s][^<>]*)(?=<|$)", lambda m: f">\x00{m[1]}", x) if main and x.startswith("<") else (re.sub(r"(^|>)([^<>]*[^<>\s][^<>]*)(?=<|$)", lambda m: f"{m[1]}\x00{m[2]}", x) if main else x) for x, main in pieces)
        blocks = leaves(text)
        label = np.array(["\x00" in t for _, t, _ in blocks], np.float32)
        if len(blocks):
            out.append((features([(p, t.replace("\x00", ""), k) for p, t, k in blocks]), label))
    return out


def training_piece(page: str, most: int = TRAIN_CHARS) -> str:
    """A page of at most ``most`` characters from one that marks its article: what lies next to the article, and a stretch from anywhere in it."""
    start = _OPEN.search(page)
    stop = _SHUT.search(page, start.end()) if start else None
    if len(page) <= most or not stop:
        return page[:most]
    beside = most // 6
    head, tag, body, tail = page[: start.start()], start[0][:200], page[start.end() : stop.start()], page[stop.end() :]
    room = most - 2 * beside - 2 * len(tag) - 20
    head = head if len(head) <= beside else head[head.find("<", len(head) - beside) :]
    if len(body) > room:
        at = int(np.random.default_rng(zlib.crc32(page.encode("utf-8", "replace"))).integers(0, len(body) - room + 1))
        at = max(0, body.find("<p", at, at + room)) if at else 0
        body = body[at : at + room]
        body = body[: body.rfind("<")] if "<" in body[1:] else body
    return f"{head}{tag}{body}</{start[1]}>{tail[:beside]}"


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> Labeller:
    """A labeller from at most ``most`` distinct pages that mark their article, drawn by a hash of the html.

    Hashes are drawn first; a drawn page is then read once, however often it
    occurs, and only its training piece reaches the driver.
    """
    marked = pages.select("html").filter(F.col("html").rlike(r"(?i)<(article|main)\b")).select("html", F.xxhash64("html").alias("key"))
    n = marked.count()
    part = 1_000_003 * min(1.0, 8 * most / max(1, n))
    drawn = marked.filter(F.pmod("key", F.lit(1_000_003)) < part).select("key").distinct().orderBy("key").limit(most).collect()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "piece": list(map(training_piece, batch["html"]))})

    each = marked.filter(F.col("key").isin([r["key"] for r in drawn])).groupBy("key").agg(F.first("html").alias("html"))
    rng, made = np.random.default_rng(8), []
    found = each.mapInPandas(pieces, "key long, piece string").collect() if drawn else []
    texts = [r["piece"] for r in sorted(found)] or ["<body><article><p>some text of an article</p><p>and more of it, at length</p></article></body>"]
    for _ in range(4):
        for text in texts:
            if len(made) < most * (VARIANTS + 1):
                made += [a_window(x, y, rng) for x, y in made_pages(text, rng)]
    return Labeller().fit(made)


def a_window(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, blocks: int = TRAIN_BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """A stretch of a long page's blocks, from anywhere in it."""
    at = int(rng.integers(0, max(1, len(x) - blocks + 1)))
    return x[at : at + blocks], y[at : at + blocks]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                blocks = [leaves(h or "") for h in part["html"]]
                main = model.label([features(b) for b in blocks])
                texts = [" ".join(t for (_, t, _), m in zip(b, y, strict=True) if m) for b, y in zip(blocks, main, strict=True)]
                out = pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": list(map(len, texts))})
                yield out.astype({"page_id": "Int64"})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages))
