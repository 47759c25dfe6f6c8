"""Addresses and identity keys."""
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .. import fixed_values as fv
from .text import any_of, blank, fold, fold_py, let, strip_marks

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:\s]+)(?::\d*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_parts(url) -> Column:
    """struct(scheme, host, path, query) of an absolute address, NULL for anything else. One
    match splits the address into its parts."""
    parts = F.split(F.regexp_replace(F.trim(blank(url)), _PARTS, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    return let(parts, lambda p: F.when(F.size(p) == 4, F.struct(
        F.lower(p[0]).alias("scheme"), F.lower(p[1]).alias("host"),
        F.when(p[2] == "", F.lit("/")).otherwise(p[2]).alias("path"), p[3].alias("query"))))


def canonical_url(url, drop_query: bool = False) -> Column:
    """no fragment, on request no query; other text is returned trimmed."""
    return F.trim(F.regexp_replace(blank(url), r"[?#].*$" if drop_query else "#.*$", ""))


#: Plain addresses, which need no parsing: an absolute one stands for itself, a path follows the origin.
_TAIL = r"(?:/[A-Za-z0-9_~%-][A-Za-z0-9_~.%-]*)*+/?(?:\?[A-Za-z0-9_=&%.+-]+)?"
_ORIGIN = re.compile(r"https?://[a-z0-9.-]+(?=/|\Z)", re.I | re.A)
_ABSOLUTE, _PATH = re.compile(rf"https?://[A-Za-z0-9.-]+{_TAIL}", re.A), re.compile(rf"(?=/){_TAIL}", re.A)


def resolve(base: str | None, href: str | None) -> str:
    """A relative address resolved, '' when it is not an http address."""
    if not href:
        return ""
    origin = _ORIGIN.match(base) if base else None
    if origin and origin[0].startswith("http"):
        if _PATH.fullmatch(href):
            return origin[0] + href
        if _ABSOLUTE.fullmatch(href):
            return href
    try:
        out = urljoin(base or "", href)
    except ValueError:
        return ""
    return out if out.startswith(("http://", "https://")) else ""


@pandas_udf(StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """relative address resolution, '' when it is not an http address."""
    return pd.Series([resolve(b, h) for b, h in zip(base, href)])


def host_of(url) -> Column:
    return F.lower(F.regexp_extract(blank(url), _PARTS, 2))


def same_site(url_a, url_b, mode: str = "bare") -> Column:
    """"bare": https and the same host but for www.; "family": one host is the
    other or a sub-domain of it."""
    a, b = host_of(url_a), host_of(url_b)
    if mode == "bare":
        def bare(h):
            return F.regexp_replace(h, r"^www\.", "")
        return F.lower(blank(url_a)).startswith("https://") & (a != "") & (bare(a) == bare(b))
    dot = F.lit(".")
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(dot, b)) | F.endswith(b, F.concat(dot, a)))


def clean_query(query) -> Column:
    """The query without tracking parameters; what remains keeps its order."""
    pieces = F.filter(F.split(F.regexp_replace(blank(query), r"^\?", ""), "&"), lambda p: p != "")

    def kept(parts):
        keep = F.filter(parts, lambda p: ~F.lower(F.regexp_extract(p, "^[^=]*", 0))
                        .rlike(fv.TRACKING_PARAMETER_PATTERN))
        written = F.transform(keep, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
        out = F.when(F.size(keep) == F.size(parts), F.regexp_replace(blank(query), r"^\?", "")) \
            .otherwise(F.array_join(written, "&"))
        return F.when(out == "", F.lit("")).otherwise(F.concat(F.lit("?"), out))
    return F.when(blank(query).isin("", "?"), F.lit("")).otherwise(let(pieces, kept))


def offer_key(source_id, url, brand, name, color) -> Column:
    """one product at one source, whatever tracking parameters the link carries."""
    fallback = F.lower(F.concat_ws("|", blank(source_id), blank(brand), blank(name), blank(color)))
    parts = url_parts(F.regexp_replace(blank(url), "(?i)&amp;", "&"))

    def key(p):
        path = F.regexp_replace(p["path"], "/+$", "")
        return F.concat(blank(source_id), F.lit("|"), p["host"],
                        F.when(path == "", F.lit("/")).otherwise(path), clean_query(p["query"]))
    return let(parts, lambda p: F.when(p.isNull(), fallback).otherwise(key(p)))


def _letters_and_digits(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def model_title(brand, name, color) -> Column:
    """struct(brand, title): what is left of a name without colour, men's word and brand."""
    title = F.trim(F.get(F.split(blank(name), r"\|", 2), F.lit(0)))
    shade = F.trim(blank(color))
    head = F.rtrim(F.substring(title, F.lit(1), F.greatest(F.length(title) - F.length(shade), F.lit(0))))
    coloured = (shade != "") & F.endswith(F.lower(title), F.lower(shade)) & head.rlike("[-–,]$")
    bare = F.when(coloured, F.regexp_replace(head, r"\s*[-–,]$", "")).otherwise(title)
    words = _letters_and_digits(F.regexp_replace(bare, r"(?i)^\s*(?:herren|men'?s?)\s+", ""))

    def strip(p):
        own = F.concat(p["brand"], F.lit(" "))
        return F.struct(p["brand"].alias("brand"), F.when(
            (p["brand"] != "") & F.startswith(p["title"], own),
            F.substring(p["title"], F.length(own) + 1, F.length(p["title"]))).otherwise(p["title"]).alias("title"))
    return let(F.struct(_letters_and_digits(blank(brand)).alias("brand"), words.alias("title")), strip)


def model_key(brand, name, color, key: Column) -> Column:
    """one model whatever colour, size or shop; without a usable name its own offer key."""
    return let(model_title(brand, name, color), lambda m: F.when(
        m["title"].contains(" ") & ~m["title"].rlike(fv.GENERIC_TITLE_PATTERN),
        F.concat_ws("|", F.lit("model"), m["brand"], m["title"]))
        .otherwise(F.concat(F.lit("url|"), key)))


def hide_key(model: Column) -> Column:
    """the model key without generic words, so it is the same at every shop."""
    def shorten(parts):
        words = F.filter(F.split(parts[2], " "),
                         lambda w: (w != "") & ~w.rlike("(?U)" + fv.HIDE_GENERIC_WORD_PATTERN))
        return F.when(F.size(words) > 0, F.concat_ws("|", parts[0], parts[1], F.array_join(words, " ")))
    return F.coalesce(F.when(model.startswith("model|"), let(F.split(model, r"\|", 3), shorten)), model)


def url_score(url, brands) -> Column:
    """how likely an address is a product page worth reading."""
    raw = F.lower(blank(url))
    decoded = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(
        F.regexp_extract(blank(url), _PARTS, 3), r"\+", "%2B")), raw))
    path = F.when(blank(url).rlike(_PARTS), strip_marks(decoded, "NFKD")).otherwise(raw)
    terms = ["".join(x for x in fold_py(b) if x.isascii() and x.isalnum()) for b in brands]

    def score(p):
        compact = F.regexp_replace(F.translate(p, "ø", "o"), "[^a-z0-9]", "")
        rules = {"brand": compact.rlike(any_of([t for t in terms if t])),
                 "word": p.rlike(any_of(fv.URL_TROUSER_WORDS)),
                 "unwanted": p.rlike(any_of(fv.URL_UNWANTED_WORDS)),
                 "category": p.rlike(any_of(fv.URL_CATEGORY_PARTS))}
        return sum((hit.cast("int") * fv.URL_POINTS[k] for k, hit in rules.items()), F.lit(0))
    return let(path, score)


def sitemap_relevant(url, brands) -> Column:
    """An address that names a brand or a category word."""
    terms = set()
    for b in brands:
        for form in (b.lower(), fold_py(b)):
            terms.add("".join(x for x in form if x.isascii() and x.isalnum()))
            terms.add(form)
    quoted = ["".join(x if x.isalnum() or x in " " else "\\" + x for x in t) for t in sorted(terms) if t]
    return F.lower(blank(url)).rlike(any_of(quoted + fv.SITEMAP_CATEGORY_WORDS))
