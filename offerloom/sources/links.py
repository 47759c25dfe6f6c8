"""Addresses from sitemaps and links."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions import urls as ur
from ..operators.ranking import first_per_key

c = F.col


def sitemap_urls(xml_docs: DataFrame, sources: DataFrame, brands) -> DataFrame:
    """Addresses of sitemap documents (source_id, seq, xml) of the same shop that name a
    brand or a category word. `idx` keeps the order for the ranking (L2)."""
    from ..operators.joins import lookup_join
    locs = F.regexp_extract_all("xml", F.lit("<loc>(.*?)</loc>"), F.lit(1))
    d = xml_docs.select("source_id", "seq", F.posexplode(locs).alias("pos", "u")).select(
        "source_id", F.struct("seq", "pos").alias("idx"), F.replace("u", F.lit("&amp;"), F.lit("&")).alias("url"))
    d = lookup_join(d, sources.select("source_id", "base_url"), "source_id", "url", "inner")
    return d.where(ur.same_site(c("url"), c("base_url")) & ur.sitemap_relevant(c("url"), brands)).drop("base_url")


def product_links(links: DataFrame) -> DataFrame:
    """Links to product pages of the same host that name trousers, first per path.
    Input: page_id, page_url, pos, href, text."""
    d = tx.computed(links, {"u": ur.url_parts(c("href"))})
    words = F.lower(F.concat_ws(" ", F.coalesce(F.try_url_decode(F.regexp_replace(c("u.path"), r"\+", "%2B")), c("u.path")),
                                tx.squeeze(c("text"))))
    d = d.where((c("u.host") == ur.host_of(c("page_url"))) & (c("href") != c("page_url"))
                & F.lower("u.path").rlike(fv.PRODUCT_PATH_PATTERN) & words.rlike(tx.any_of(fv.PRODUCT_LINK_WORDS))
                & ~words.rlike(tx.any_of(fv.PRODUCT_LINK_EXCLUDED)))
    return first_per_key(d.withColumn("path", c("u.path")).drop("u"), ["page_id", "path"], "pos")


def _parameters(query):
    pieces = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        F.regexp_extract(p, "^[^=]*", 0).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))


def next_listing_pages(links: DataFrame, last: int | None = None) -> DataFrame:
    """The explicitly linked next page of the same listing: the page number in the path
    or in exactly one page-like parameter grows by one (up to `last` where it is given) and the label
    says so. Input: page_id, page_url, pos, href, label and, where known, paging: only paging
    links count. One row per page that has one."""
    if "paging" in links.columns:
        links = links.where("paging")
    in_range = lambda n: F.lit(True) if last is None else n <= last
    d = tx.computed(links, {"n": ur.url_parts(c("href")), "p": ur.url_parts(c("page_url"))})
    d = d.where((c("n.scheme") == "https") & (c("n.host") == c("p.host")))

    def trimmed(x):
        return F.regexp_replace(x, "/+$", "")
    d = tx.computed(d, {
        "np": trimmed(c("n.path")), "pp": trimmed(c("p.path")),
        "prior": F.coalesce(F.regexp_extract(trimmed(c("p.path")), r"/(\d+)$", 1).try_cast("int"), F.lit(1)),
        "nq": _parameters(c("n.query")), "pq": _parameters(c("p.query"))})
    below = F.startswith(c("n.path"), F.regexp_replace(c("p.path"), r"/\d+/?$", "/"))
    base = F.regexp_replace(c("pp"), r"/\d+$", "")
    says_next = F.lower("label").rlike(tx.edges(fv.NEXT_LABEL_PATTERN))

    def named(n):
        return says_next | (F.trim("label") == n.cast("string"))
    by_path = (c("np") == F.concat(base, F.lit("/"), (c("prior") + 1).cast("string"))) & in_range(c("prior") + 1) & (
        c("n.query") == c("p.query")) & named(c("prior") + 1)

    def value(params, k):
        return F.get(F.transform(F.filter(params, lambda x: x["k"] == k), lambda x: x["v"]), F.lit(0))
    keys = F.array_distinct(F.concat(F.transform("nq", lambda x: x["k"]), F.transform("pq", lambda x: x["k"])))
    changed = F.filter(keys, lambda k: ~value(c("nq"), k).eqNullSafe(value(c("pq"), k)))
    d = tx.computed(d.where(below), {"by_path": by_path, "changed": changed})
    key = F.get("changed", F.lit(0))
    d = tx.computed(d, {"number": value(c("nq"), key).try_cast("int"),
                        "before": F.coalesce(value(c("pq"), key).try_cast("int"), F.lit(1))})
    by_query = ((c("np") == c("pp")) & (F.size("changed") == 1) & F.lower(key).isin(*fv.PAGE_PARAMETERS)
                & (c("number") == c("before") + 1) & in_range(c("number")) & named(c("number")))
    hit = d.where(c("by_path") | F.coalesce(by_query, F.lit(False)))
    return hit.groupBy("page_id", "page_url").agg(
        F.min_by(F.regexp_replace("href", "#.*$", ""), "pos").alias("next_url"))
