"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

The trees give every element and text the probability that article text is under it. A choice
of nodes contradicts itself if a node is kept below a dropped one; among all choices that don't,
decoding takes the likeliest, with one pass up and one down the tree. The trees are trained on
pages made by rule from varied layouts, in which every text is known to be article or not."""
from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, dom

#: Made pages the trees are trained on, and their seed.
PAGES, SEED = 360, 7
#: Pages whose nodes are scored together.
_TOGETHER = 64
_MAIN = "\ue000"


class _Layouts:
    """Random pages; article text starts with a mark that only training sees."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = ["".join(self.r.choice("bcdfghklmnprstvwz") + self.r.choice("aeiouäéñ") for _ in range(k)) for k in (1, 1, 2, 2, 2, 3) for _ in range(60)]

    def words(self, n, style=0):
        w = [self.r.choice(self.parts) for _ in range(max(1, n))]
        if style == 1:
            w = [x + self.r.choice(["###", "***", "$$$", "%%%", "&amp;&amp;&amp;"]) for x in w]
        elif style == 2:
            w = [x.upper() + "!!" for x in w]
        elif style == 3:
            w = [x + " |" for x in w]
        else:
            w = [x + ("." if self.r.random() < 0.1 else "," if self.r.random() < 0.08 else "") for x in w]
        return " ".join(w).capitalize() if style != 2 else " ".join(w)

    def links(self, n, mark=""):
        return "".join(f'<li><a href="/{i}">{mark}{self.words(self.r.randint(1, 3))}</a></li>' for i in range(n))

    def box(self, kinds, tag_choices, body):
        """A part of the page around `body`: by its own element, by class, by id, or both."""
        tag, named = self.r.choice(tag_choices), self.r.choice(kinds)
        how = self.r.random()
        attr = f' class="{named}"' if how < 0.5 else f' id="{named}"' if how < 0.7 else f' class="{named}-{self.r.choice(["box", "inner", "wrap", "1"])}"'
        return f"<{tag}{attr if tag in ('div', 'section', 'ul') or how < 0.3 else ''}>{body}</{tag}>"

    def flow(self, n, mark="", style=0):
        """Words, at times with inline elements and breaks between and inside them."""
        r = self.r
        if r.random() < 0.65:
            return mark + self.words(n, style)
        out = []
        for _ in range(r.randint(2, 6)):
            tag = r.choice(["b", "i", "em", "strong", "span", "a href='/z'", "code", "br", "br", "sup"])
            part = mark + self.words(r.choice([1, 1, 2, 4, max(1, n // 2)]), style)
            out.append(part if r.random() < 0.5 else f"<br>{part}" if tag == "br" else f"<{tag}>{part}</{tag.split()[0]}>")
        return r.choice(["", " "]).join(out)

    def p(self, n, mark="", style=0):
        return f"<p>{self.flow(n, mark, style)}</p>"

    def rest(self, kind):
        r = self.r
        if kind == "nav":
            return self.box(["nav", "menu", "navbar", "breadcrumb", "pagination"], ["nav", "nav", "div"], f"<ul>{self.links(r.randint(2, 9))}</ul>")
        if kind == "header":
            return self.box(["header", "masthead", "topbar"], ["header", "div"], r.choice([f"<a href='/'>{self.words(2)}</a>", f"<h1>{self.words(2)}</h1>", ""]) + r.choice([self.p(6), f"<span>{self.words(3)}</span>", self.rest("form"), self.rest("nav")]))
        if kind == "footer":
            return self.box(["footer", "copyright", "legal", "bottom"], ["footer", "footer", "div"], r.choice(["&copy; " + self.words(r.randint(2, 40)), self.p(r.randint(3, 30)), f"<ul>{self.links(4)}</ul>&copy; {self.words(3)}", f"&copy; {self.words(2)} &middot; {self.words(r.randint(3, 20))}"]))
        if kind == "aside":
            return self.box(["sidebar", "related", "widget", "popular", "recommended", "share", "social", "tags"], ["aside", "aside", "div"], r.choice([f"<h3>{self.words(2)}</h3><ul>{self.links(r.randint(2, 6))}</ul>", self.p(r.randint(5, 60)), f"<h4>{self.words(2)}</h4>" + self.p(r.randint(5, 40)), self.words(8)]))
        if kind == "ad":
            return self.box(["ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement"], ["div", "aside", "section", "p", "div"], r.choice([self.words(r.randint(3, 40)), self.p(r.randint(3, 30)), f"<a href='/x'>{self.words(5)}</a>"]))
        if kind == "notice":
            return self.box(["cookie", "consent", "cookie-notice", "notice", "newsletter", "popup", "alert", "gdpr"], ["div", "section", "aside"], self.p(r.randint(4, 40)) + r.choice([f"<button>{self.words(1)}</button>", "", f"<a href='/ok'>{self.words(1)}</a>"]))
        if kind == "form":
            return self.box(["search", "subscribe", "login", "signup", "form"], ["form", "form", "div"], f"<label>{self.words(2)}</label><input name='q'><button>{self.words(1)}</button>" + r.choice(["", self.p(r.randint(3, 15))]))
        one = lambda: self.box(["comment", "reply"], ["div", "li", "article", "section"], r.choice([f"<b>{self.words(1)}</b>", f"<span class='author'>{self.words(2)}</span>"]) + self.p(r.randint(3, 60)))
        return self.box(["comments", "comment-list", "disqus", "discussion", "responses comments"], ["section", "div"], r.choice([f"<h2>{self.words(1)}</h2>", f"<h3>{self.words(2)}</h3>", ""]) + "".join(one() for _ in range(r.randint(1, 5))))

    def block(self, style):
        r, k = self.r, self.r.random()
        n = r.choice([1, 2, 4, 10, 25, 60, 120])
        if k < 0.62:
            return self.p(n, _MAIN, style) if r.random() < 0.8 else f"<p><b>{_MAIN}{self.words(n, style)}<br>"
        if k < 0.70:
            return f"<h{r.randint(2, 4)}>{_MAIN}{self.words(r.randint(1, 8), style)}</h2>".replace("</h2>", "")
        if k < 0.77:
            return f"<p>{_MAIN}{self.words(n, style)} <a href='/y'>{_MAIN}{self.words(2)}</a> {_MAIN}{self.words(n, style)}</p>"
        if k < 0.83:
            return "<ul>" + "".join(f"<li>{self.flow(r.randint(1, 20), _MAIN, style)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.87:
            return f"<blockquote>{self.flow(n, _MAIN, style)}</blockquote>"
        if k < 0.91:
            return "<table>" + "".join(f"<tr><td>{_MAIN}{self.words(2, style)}</td><td>{_MAIN}{self.words(2)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        if k < 0.95:
            return f"<pre>{_MAIN}{self.words(n, style)}</pre>"
        return f"<figure><img src='/a.png'><figcaption>{_MAIN}{self.words(6)}</figcaption></figure>" if k < 0.98 else f"<div>{self.flow(n, _MAIN, style)}</div>"

    def page(self):
        r = self.r
        style = r.choice([0, 0, 0, 1, 2, 3])
        body = [self.block(style) for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 8, 12, 16, 20, r.randint(30, 120)]))]
        for kind in ("ad", "aside", "notice", "form"):
            if r.random() < 0.12 and body:
                body.insert(r.randint(1, len(body)), self.rest(kind))
        title = f"<h1>{_MAIN}{self.words(r.randint(1, 10), style)}</h1>"
        if r.random() < 0.25:
            title = f"<header>{title}</header>"
        text = (title if r.random() < 0.85 or not body else "") + "".join(body)
        if r.random() < 0.08:
            text += self.rest("comments")
        how = r.random()
        if how < 0.55:
            text = f"<article>{text}</article>"
        elif how < 0.75:
            text = f"<main>{text}</main>"
        elif how < 0.85:
            text = f"<main><article>{text}</article></main>"
        else:
            text = f'<div {r.choice(["class", "id"])}="{r.choice(["content", "post", "article-body", "entry-content", "story", "main-text", "x1"])}">{text}</div>'
        first = [self.rest(k) for k in ("header", "nav", "notice", "ad", "form", "nav") if r.random() < 0.4]
        last = [self.rest(k) for k in ("aside", "comments", "ad", "notice", "footer", "footer", "form") if r.random() < 0.4]
        shown = "".join(first) + text + "".join(last)
        if r.random() < 0.2:
            shown = f'<div class="{r.choice(["page", "wrapper", "container", "site"])}">{shown}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title></head><body>{shown}</body></html>"


def _labelled(source: str):
    """A made page without its marks, and per node whether article text is under it."""
    page = dom.read(source)
    main = np.array([_MAIN in t for t in page.text], float)
    page.text = [t.replace(_MAIN, "") for t in page.text]
    end = np.array(page.end)
    c = np.concatenate([[0], main.cumsum()])
    return dom.features(page), (c[end] - c[:len(end)] > 0).astype(float)


@functools.lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = SEED) -> boosting.Trees:
    made = _Layouts(seed)
    rows = [_labelled(made.page()) for _ in range(pages)]
    x, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return boosting.fit(x, y, trees=60, depth=5, rate=0.25, bins=32, least=6.0)


def decoded(page: dom.Page, margin: np.ndarray) -> np.ndarray:
    """The likeliest choice in which every kept node's parent is kept."""
    n = len(margin)
    if not n:
        return np.zeros(0, bool)
    kept, dropped = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    end = np.array(page.end)
    c = np.concatenate([[0], dropped.cumsum()])
    drop = (c[end] - c[:n]).tolist()
    keep = kept.tolist()
    for i in range(n - 1, 0, -1):  # children come after their parents
        if page.parent[i] >= 0:
            keep[page.parent[i]] += max(keep[i], drop[i])
    out = np.zeros(n, bool)
    for i in range(n):
        p = page.parent[i]
        out[i] = keep[i] > drop[i] and (p < 0 or out[p])
    return out


def main_texts(sources: list[str], trees: boosting.Trees) -> list[str]:
    """Main texts of whole pages: white space becomes one space, blocks are joined by one."""
    pages = [dom.read(s) for s in sources]
    rows = [dom.features(p) for p in pages if p.tags]
    margin = trees.margin(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for p in pages:
        n = len(p.tags)
        keep = decoded(p, margin[at:at + n])
        at += n
        out.append(" ".join("".join(t for i, t in p.pieces if i < 0 or keep[i]).split()))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: boosting.Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row. A null page is an empty one and has no text; repeated
    rows are read each; an empty table gives no rows."""
    trees = trees or trained()

    def run(batches):
        for b in batches:
            texts = []
            for i in range(0, b.num_rows, _TOGETHER):
                texts += main_texts([s.as_py() or "" for s in b.column(2).slice(i, _TOGETHER)], trees)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
