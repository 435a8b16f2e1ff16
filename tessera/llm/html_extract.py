"""HTML main text by gradient-boosted trees over DOM nodes.

Every block element gets features: density of its subtree (text, links, tags,
punctuation), hashed tokens of its class, id and role, its tag and its
ancestors' tags, its depth, and its size and place among its siblings.
Gradient-boosted trees give the probability that all its text belongs to the
article.  Decoding is hierarchical: on each path from the root the states are
outside, then inside, then pruned, in that order, and the most probable
consistent choice for the whole tree is found by dynamic programming; so
nothing outside lies between two inside nodes of one path and nothing pruned
has an article part below.  Text of inside nodes is kept.

The trees are trained here on generated pages of many layouts, whose article
text is known; the generator is seeded, so the model is a fixed function of its
parameters.

Text: references decoded, white space inside a block turned into one space,
blocks trimmed, empty ones left out, the rest joined by newline in page order.
A `br` is white space.  Inline elements such as `math`, `noscript` and `object`
give their text; scripts, styles, form controls, frames, drawings and templates
do not.

Cases: null or empty html gives empty text; pages without markup give their
text if the trees take its root for an article, else none; broken markup is
read leniently; very long pages are read whole; repeated rows get equal
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import small_batches

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg select button".split())
# Of these only script, style, title and textarea hold no markup: without an end tag they end with the page.
OPAQUE = frozenset("script style textarea title".split())
BLOCKS = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form table thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address fieldset details summary dialog center"
).split()
P_CLOSERS = frozenset(BLOCKS) - frozenset("html body".split()) | {"hr"}
SELF_CLOSERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl html body".split())
INSIDE_OF = ("nav", "header", "footer", "aside", "form", "article", "main", "figure", "table", "ul")

_CODE = {t: i for i, t in enumerate(BLOCKS)}
TOKENS = 96
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?]")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
MARK = "\x01"
N_FEATURES = 18 + len(INSIDE_OF) + len(BLOCKS) + TOKENS


class Page:
    """Block elements in document order (parents first) and the text pieces between tags.

    tag, parent, attrs: of each element; pieces: (element, block number, in a
    link, text).  Element 0 is the page itself.
    """

    __slots__ = ("tag", "parent", "attrs", "pieces", "inner")

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.inner = ["html"], [-1], [""], [0]
        self.pieces: list[tuple[int, int, bool, str]] = []
        stack: list[tuple[str, int]] = [("html", 0)]
        block, links, at, n = 0, 0, 0, len(source)
        pieces = self.pieces
        in_head = False

        def close(names: tuple[str, ...], barrier) -> None:
            """Closes the innermost open element of these names, if no barrier is above it."""
            nonlocal links
            depth = len(stack) - 1
            while depth > 0 and stack[depth][0] not in names:
                if stack[depth][0] in barrier:
                    return
                depth -= 1
            if depth > 0:
                links -= sum(t == "a" for t, _ in stack[depth:])
                del stack[depth:]

        while m := _TAG.search(source, at):
            start = m.start()
            if start > at and not in_head:
                pieces.append((stack[-1][1], block, links > 0, source[at:start]))
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if name == "head":
                    in_head = False
                elif any(t == name for t, _ in stack[1:]):
                    while len(stack) > 1:
                        t, _ = stack.pop()
                        block += t in _CODE
                        links -= t == "a"
                        if t == name:
                            break
                continue
            self.inner[stack[-1][1]] += 1
            if name in RAW and not (name not in OPAQUE and m.group(3).endswith("/")):
                end = _END[name].search(source, at)
                if end:
                    at = end.end()
                elif name in OPAQUE:
                    at = n
                # Any other that is never closed is left out as a tag alone.
                continue
            if name == "head":
                in_head = True
                continue
            if name in VOID:
                if name == "br":
                    pieces.append((stack[-1][1], block, False, " "))
                elif name == "hr":
                    block += 1
                continue
            if name == "body":
                in_head = False
            if name in P_CLOSERS:
                close(("p",), _CODE)
            if name in SELF_CLOSERS:
                close(SELF_CLOSERS[name], SCOPES)
            if name in _CODE:
                block += 1
                if name != "html":
                    self.tag.append(name)
                    self.parent.append(stack[-1][1])
                    self.attrs.append(m.group(3))
                    self.inner.append(0)
                    stack.append((name, len(self.tag) - 1))
            elif not m.group(3).endswith("/"):
                links += name == "a"
                stack.append((name, stack[-1][1]))
        if at < n and not in_head:
            pieces.append((stack[-1][1], block, links > 0, source[at:]))


def tokens(attrs: str) -> list[str]:
    return [w for m in _ATTR.finditer(attrs) for w in _WORD.findall((m.group(2) or m.group(3) or m.group(4) or "").lower())]


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(features by element, share of each element's text that carries the training mark)."""
    n = len(page.tag)
    text, link, punct, count, own, marked = ([0] * n for _ in range(6))
    for e, _, linked, s in page.pieces:
        size = len(s.strip())
        if not size:
            continue
        text[e] += size
        own[e] += size
        link[e] += size * linked
        punct[e] += len(_PUNCT.findall(s))
        marked[e] += size * (MARK in s)
    tags, paragraphs, blocks = list(page.inner), [t == "p" for t in page.tag], [1] * n
    depth = [0] * n
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        depth[i] = depth[page.parent[i]] + 1
        kids[page.parent[i]].append(i)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        text[p] += text[i]
        link[p] += link[i]
        punct[p] += punct[i]
        marked[p] += marked[i]
        tags[p] += tags[i]
        paragraphs[p] += paragraphs[i]
        blocks[p] += blocks[i]
    place_of, largest = [0] * n, [0] * n
    for own_kids in kids:
        for at, k in enumerate(own_kids):
            place_of[k] = at
    for p, own_kids in enumerate(kids):
        largest[p] = max((text[k] for k in own_kids), default=0)
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    whole = max(1, text[0])
    under = [0] * n
    for i in range(n):
        p = page.parent[i]
        if p >= 0:
            sib = kids[p]
            at = place_of[i]
            before = text[sib[at - 1]] if at else 0
            after = text[sib[at + 1]] if at + 1 < len(sib) else 0
            under[i] = under[p] | (1 << INSIDE_OF.index(page.tag[p]) if page.tag[p] in INSIDE_OF else 0)
            share = text[i] / max(1, text[p])
            place, many = (at + 1) / len(sib), len(sib)
            up = link[p] / max(1, text[p])
            biggest = largest[p] == text[i]
        else:
            before = after = 0
            share, place, many, up, biggest = 1.0, 1.0, 1, 0.0, True
        t = text[i]
        x[i, :18] = (
            np.log1p(t), link[i] / max(1, t), np.log1p(tags[i]), t / (1 + tags[i]), punct[i] / max(1, t) * 100, depth[i], np.log1p(before), np.log1p(after),
            share, place, many, t / whole, paragraphs[i], np.log1p(own[i]), up, biggest, own[i] / max(1, t), t / blocks[i],
        )
        for k in range(len(INSIDE_OF)):
            x[i, 18 + k] = under[i] >> k & 1
        x[i, 18 + len(INSIDE_OF) + _CODE[page.tag[i]]] = 1
        if page.attrs[i]:
            for w in tokens(page.attrs[i]):
                x[i, N_FEATURES - TOKENS + zlib.crc32(w.encode()) % TOKENS] = 1
    share = np.array(marked, dtype=np.float64) / np.maximum(1, np.array(text))
    return x, share


@dataclass
class Trees:
    """Complete binary trees: feature, threshold and leaf value by tree and place."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of logistic loss with histogram splits."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    used = [j for j in range(x.shape[1]) if len(np.unique(x[:, j])) > 1]
    coded = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in used], axis=1)
    width = coded.max() + 1
    flat = coded + np.arange(len(used)) * width
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((rounds, inner), dtype=np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            go = np.zeros(len(mine), dtype=bool)
            if len(mine) > 8:
                size = len(used) * width
                gs = np.bincount(flat[mine].ravel(), np.repeat(g[mine], len(used)), size).reshape(len(used), width).cumsum(axis=1)
                hs = np.bincount(flat[mine].ravel(), np.repeat(h[mine], len(used)), size).reshape(len(used), width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = -np.inf
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-3 and b < len(edges[used[j]]):
                    feature[r, node], threshold[r, node] = used[j], edges[used[j]][b]
                    go = x[mine, used[j]] > threshold[r, node]
            at[mine] = 2 * node + 1 + go
        place = at - inner
        leaf[r] = rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + ridge)
        score += leaf[r][place]
    return Trees(feature, threshold, leaf, base)


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Inside or not, by element: the best choice with states outside, inside, pruned in that order on every path."""
    n = len(page.tag)
    yes = (-np.logaddexp(0, -odds)).tolist()
    no = (-np.logaddexp(0, odds)).tolist()
    outer, inner, pruned = list(no), list(yes), list(no)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        outer[p] += max(outer[i], inner[i])
        inner[p] += max(inner[i], pruned[i])
        pruned[p] += pruned[i]
    state = [0] * n
    state[0] = 1 if inner[0] > outer[0] else 0
    for i in range(1, n):
        up = state[page.parent[i]]
        state[i] = 2 if up == 2 else (1 if inner[i] >= pruned[i] else 2) if up == 1 else (1 if inner[i] > outer[i] else 0)
    return np.array(state) == 1


def text_of(page: Page, inside: np.ndarray) -> str:
    parts: list[list[str]] = []
    last = None
    for e, block, _, s in page.pieces:
        if inside[e]:
            if block != last:
                parts.append([])
                last = block
            parts[-1].append(s)
    return "\n".join(t for t in (" ".join(_html.unescape("".join(p)).split()) for p in parts) if t)


def generated_page(rng: random.Random) -> str:
    """A page of a random layout; article text carries the training mark."""
    vocabulary = ["".join(rng.choice(["ka", "lo", "re", "shi", "tan", "vel", "or", "mi", "que", "ß", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(80)]

    def words(a: int, b: int) -> str:
        out = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(a, b)))
        return out.capitalize() + rng.choice([".", "", "."])

    def attr(*names: str) -> str:
        return rng.choice(["", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} {rng.choice(["box", "wrap", "row", "x1"])}"'])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def menu() -> str:
        body = f"<ul>{links(rng.randint(2, 12))}</ul>" if rng.random() < 0.7 else "".join(f'<a href="/{i}">{words(1, 2)}</a> ' for i in range(rng.randint(2, 9)))
        return rng.choice([f"<nav>{body}</nav>", f"<nav{attr('menu', 'nav', 'navbar')}>{body}</nav>", f'<div class="{rng.choice(["menu", "navigation", "nav", "breadcrumb"])}">{body}</div>'])

    def header() -> str:
        return rng.choice(["", f"<header{attr('site-header', 'header', 'masthead', 'top')}><{rng.choice(['div', 'p', 'h2'])}>{words(1, 8)}</div></header>", f'<div class="{rng.choice(["header", "masthead", "banner"])}"><p>{words(2, 10)}</p></div>'])

    def advert() -> str:
        return f'<{(t := rng.choice(["div", "aside", "section", "p"]))} class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo", "banner-ad"])}">{rng.choice([words(3, 30), f"<p>{words(5, 40)}</p>", words(3, 20) + chr(10) + words(1, 5)])}</{t}>'

    def notice() -> str:
        return f'<div {rng.choice(["class", "id"])}="{rng.choice(["cookie", "cookie-notice", "notice", "gdpr consent", "alert", "newsletter", "subscribe", "paywall"])}">{rng.choice([words(5, 40), f"<p>{words(5, 40)}</p>"])}<button>OK</button></div>'

    def sidebar() -> str:
        inner = rng.choice([f"<h3>{words(1, 4)}</h3><ul>{links(rng.randint(2, 8))}</ul>", f"<p>{words(5, 50)}</p>", f"<div>{words(4, 30)}</div><ul>{links(3)}</ul>"])
        return rng.choice([f"<aside{attr('sidebar', 'related', 'widget')}>{inner}</aside>", f'<div class="{rng.choice(["sidebar", "related", "widget", "side", "trending"])}">{inner}</div>'])

    def comments() -> str:
        one = lambda: f'<{(t := rng.choice(["li", "div", "article"]))} class="{rng.choice(["comment", "reply", "comment-body"])}"><p>{words(1, 3)}</p><p>{words(5, 60)}</p></{t}>'
        return f'<{(t := rng.choice(["section", "div", "ol"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "responses"])}">{"".join(one() for _ in range(rng.randint(1, 6)))}</{t}>'

    def form() -> str:
        return f'<form{attr("search", "login", "subscribe-form")}><label>{words(1, 4)}</label><input><p>{words(1, 12)}</p></form>'

    def footer() -> str:
        inner = rng.choice([f"&copy; example &middot; {words(1, 14)}", f"<p>{words(2, 25)}</p>", f"<ul>{links(4)}</ul><p>{words(2, 9)}</p>", f"{words(3, 12)}\n{words(1, 3)}"])
        return rng.choice([f"<footer>{inner}</footer>", f"<footer{attr('footer', 'site-footer')}>{inner}</footer>", f'<div class="{rng.choice(["footer", "copyright", "bottom"])}">{inner}</div>'])

    brief = rng.random() < 0.15

    def main_block() -> str:
        s = MARK + words(*((1, 7) if brief else rng.choice([(1, 3), (2, 15), (5, 30), (10, 110), (10, 110), (10, 110)])))
        if rng.random() < 0.15:
            s += f' {MARK}<a href="#">{MARK}{words(1, 5)}</a> {MARK}{words(2, 30)}'
        if rng.random() < 0.15:
            s = f"<{(t := rng.choice(['b', 'em', 'strong']))}>{s}" + rng.choice(["<br>", f"</{t}>"])
        kind = rng.random()
        if kind < 0.78:
            return f"<p{attr('text', 'lead') if rng.random() < 0.1 else ''}>{s}" + rng.choice(["</p>", "</p>", "</p>", ""])
        if kind < 0.85:
            return f"<h{rng.choice('23')}>{MARK}{words(1, 8)}</h2>"
        if kind < 0.91:
            return f"<ul>{''.join(f'<li>{MARK}{words(2, 20)}</li>' for _ in range(rng.randint(1, 6)))}</ul>"
        if kind < 0.95:
            return f"<blockquote><p>{s}</p></blockquote>"
        if kind < 0.97:
            return f"<table><tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{words(1, 6)}</td></tr></table>"
        return f"<div>{s}</div>"

    count = 1 if brief else rng.choice([1, 1, 1, 2, 3, 5, 8, 12, 20])
    blocks = [main_block() for _ in range(count)]
    for extra in (advert, notice, sidebar, form):
        if rng.random() < 0.12:
            blocks.insert(rng.randint(0, len(blocks)), extra())
    title = f"<h1>{MARK}{words(2, 12)}</h1>" if rng.random() < 0.85 else ""
    if rng.random() < 0.1:
        title = f"<header>{title}</header>"
    inside = title + "".join(blocks)
    kind = rng.random()
    if kind < 0.5:
        body = f"<article{attr('post', 'entry', 'article') if rng.random() < 0.5 else ''}>{inside}</article>"
    elif kind < 0.65:
        body = f"<main>{rng.choice([inside, f'<article>{inside}</article>', f'<div>{inside}</div>'])}</main>"
    else:
        body = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "entry-content", "article-body", "main", "story", "text"])}">{inside}</div>'
    before = [f() for f in (header, menu, advert, notice, form, sidebar) if rng.random() < 0.45]
    after = [f() for f in (advert, sidebar, comments, notice, menu, form) if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    page = "".join(before) + body + "".join(after) + (footer() if rng.random() < 0.8 else "")
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["wrapper", "container", "page"])}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title></head><body>{page}" + rng.choice(["</body></html>", ""])


@lru_cache(maxsize=2)
def train(pages: int = 1000, seed: int = 29) -> Trees:
    """The trees, a fixed function of the two numbers; trained once in a process."""
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        x, share = features(Page(generated_page(rng)))
        has = x[:, 0] > 0
        xs.append(x[has])
        ys.append(share[has] >= 0.95)
    return boost(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def extract_texts(pages: list[str], trees: Trees) -> list[str]:
    parsed = [Page(p) for p in pages]
    if not parsed:
        return []
    xs = [features(p)[0] for p in parsed]
    odds = trees.log_odds(np.concatenate(xs))
    cut = np.cumsum([0, *map(len, xs)])
    out = []
    for p, x, a, b in zip(parsed, xs, cut[:-1], cut[1:]):
        # Elements without text say nothing.
        o = np.where(x[:, 0] > 0, odds[a:b], 0.0)
        out.append(text_of(p, decode(p, o)))
    return out


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row a page.  pages: page_id, url, html."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(trees or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = extract_texts([h or "" for h in part.column("html").to_pylist()], held.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
