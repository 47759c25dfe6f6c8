"""A tolerant reader of HTML: elements and texts in document order, with features per node."""
from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'])(?:class|id|role|itemprop|aria-label|name|data-[a-z]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements of the HTML standard by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg math select object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img button input".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
         "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_SCOPE = frozenset("table td th caption button html body".split())

#: Groups of tags and of words in attributes; a node has a flag for each.
TAGS = [frozenset(x.split()) for x in (
    "article", "main", "p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd menu", "table tbody thead tfoot tr td th", "nav", "header", "footer", "aside",
    "form input button label fieldset legend", "div section", "a", "html body", "head", "figure figcaption blockquote pre", "#text")]
WORDS = [frozenset(x.split()) for x in (
    "article content post entry story body text main prose",
    "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toolbar skip links toc",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner commercial",
    "header head masthead topbar logo brand footer foot bottom copyright legal imprint colophon",
    "sidebar side aside related recommended recommendations more popular trending widget tags tagcloud share sharing social author teaser rail",
    "cookie cookies consent gdpr privacy notice notification alert popup modal overlay newsletter subscribe subscription signup login paywall form search toast",
    "comment comments disqus reply replies respond discussion reviews thread feedback user")]
NUMBERS = ["depth", "text", "text_share", "link_share", "per_tag", "words", "stops_per_word", "start", "children", "place", "siblings", "paragraphs", "caps", "own_share"]
N_FLAGS = len(TAGS) + len(WORDS)


@dataclass
class Page:
    """Nodes in document order. Texts are nodes without children; `pieces` holds what the page
    shows, as (node, text), with node -1 for a space that any block boundary or break leaves."""
    tags: list = field(default_factory=list)
    parent: list = field(default_factory=list)
    end: list = field(default_factory=list)
    flags: list = field(default_factory=list)
    above: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    text: list = field(default_factory=list)
    pieces: list = field(default_factory=list)


_TAG_FLAGS = {t: sum(1 << i for i, g in enumerate(TAGS) if t in g) for g in TAGS for t in g}
_WORD_FLAGS = {w: 1 << (len(TAGS) + i) for i, g in enumerate(WORDS) for w in g}


def _attribute_flags(attrs: str) -> int:
    flags = 0
    if "=" in attrs:
        for value in _ATTR.findall(attrs):
            for w in _TOKEN.findall(value):
                flags |= _WORD_FLAGS.get(w.lower(), 0)
    return flags


def read(source: str) -> Page:
    """Parse a whole page. Unclosed and stray tags are closed or left out as browsers do it."""
    page = Page()
    tags, parent, end, flags, above, depth, text, pieces = (
        page.tags, page.parent, page.end, page.flags, page.above, page.depth, page.text, page.pieces)
    stack: list[int] = []

    def add(tag, own):
        i = len(tags)
        up = stack[-1] if stack else -1
        tags.append(tag)
        parent.append(up)
        end.append(0)
        flags.append(own)
        above.append(above[up] | flags[up] if up >= 0 else 0)
        depth.append(len(stack))
        text.append("")
        return i

    def close(to):
        while len(stack) > to:
            end[stack.pop()] = len(tags)

    def say(raw):
        if not raw:
            return
        shown = html.unescape(raw) if "&" in raw else raw
        if shown.isspace():
            pieces.append((-1, " "))
            return
        i = add("#text", _TAG_FLAGS["#text"])
        end[i] = i + 1
        text[i] = shown
        pieces.append((i, shown))

    def close_open(names, limits):
        for k in range(len(stack) - 1, -1, -1):
            t = tags[stack[k]]
            if t in names:
                close(k)
                return True
            if t in limits:
                return False
        return False

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if source.startswith("<![CDATA[", m.start()):
                say(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        block = name not in INLINE
        if m["end"]:
            if close_open({name}, ()) and block or name == "br":
                pieces.append((-1, " "))
            continue
        if block:
            pieces.append((-1, " "))
        if name in ("html", "body", "head") and any(tags[s] == name for s in stack):
            continue
        if name == "body":
            close_open({"head"}, ())
        if name in _CLOSES_P:
            close_open({"p"}, _SCOPE)
        if name in _SAME:
            while close_open(*_SAME[name]) and name in ("tr", "tbody", "tfoot"):
                pass
        i = add(name, _TAG_FLAGS.get(name, 0) | _attribute_flags(m["attrs"]))
        end[i] = i + 1
        if name in VOID or m["attrs"].endswith("/") and name in RAW:
            continue
        if name in RAW:
            done = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
            at = source.find(">", done.end()) + 1 if done else size
            at = at or size
            continue
        stack.append(i)
    close(0)
    return page


def features(page: Page) -> np.ndarray:
    """One row per node: own and inherited flags, then text density and place."""
    n = len(page.tags)
    own, above = np.array(page.flags, np.int64), np.array(page.above, np.int64)
    end, parent, depth = np.array(page.end), np.array(page.parent), np.array(page.depth)
    size = np.array([len(t) for t in page.text], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in page.text], float)
    stops = np.array([t.count(".") + t.count(",") for t in page.text], float)
    caps = np.array([sum(map(str.isupper, t[:200])) / min(len(t), 200) if t else 0 for t in page.text], float)
    link = size * ((above >> 12) & 1)
    tags = np.array([t != "#text" for t in page.tags], float)
    paragraphs = np.array([t == "p" for t in page.tags], float)

    def under(v):
        c = np.concatenate([[0], v.cumsum()])
        return c[end] - c[:n]
    total, all_words = under(size), under(words)
    children = np.bincount(parent[parent >= 0], minlength=n)[:n] if n else np.empty(0)
    place, seen = np.zeros(n), {}
    for i, p in enumerate(page.parent):
        place[i] = seen.get(p, 0)
        seen[p] = place[i] + 1
    up = np.maximum(parent, 0)
    whole = max(1.0, size.sum())
    numbers = np.stack([
        depth, np.log1p(total), total / whole, under(link) / np.maximum(1, total), np.log1p(total / np.maximum(1, under(tags))), np.log1p(all_words),
        under(stops) / np.maximum(1, all_words), (np.concatenate([[0], size.cumsum()])[:n]) / whole, children, place, children[up] if n else children,
        under(paragraphs), caps, total / np.maximum(1, total[up]) if n else total], axis=1)
    bits = np.arange(N_FLAGS)
    return np.concatenate([(own[:, None] >> bits) & 1, (above[:, None] >> bits) & 1, numbers], axis=1).astype(np.float32)
