"""The evidence ladder. Per source the first kind of data that carries evidence wins."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import joins as jo
from ..operators.ranking import last_per_key
from ..settings import DEFAULT, Profile

c = F.col


def _proven():
    return (tx.blank(c("rrp_source")) != "") | F.coalesce(
        (tx.blank(c("discount_source")) != "") & (c("observed_discount_pct") >= fv.MIN_DISCOUNT_PCT), F.lit(False))


def dedupe_listings(offers: DataFrame) -> DataFrame:
    """Of listing rows equal in address, sizes, price and reference the last one stays."""
    keyed = offers.withColumns({"_u": F.lower("url"), "_s": F.array_join("sizes", "/"),
                                "_p": F.coalesce("price", F.lit(-1.0)), "_r": F.coalesce("rrp", F.lit(-1.0))})
    return last_per_key(keyed, ["source_id", "_u", "_s", "_p", "_r"], "seq").drop("_u", "_s", "_p", "_r")


def collect_offers(states: DataFrame, posts=None, shop_api=None, commerce_api=None, bulk_feed=None, listings=None,
                   listing_details=None, json_feed=None, jsonld=None, cards=None, rendered=None,
                   source_brands=None, details=None, profile: Profile = DEFAULT):
    """Every rung is a raw-offer DataFrame; a rung is used only for sources that no earlier
    rung finished. `states` (source_id, name, discovered_urls, blocked, is_post_source) drives
    the statuses. Returns (offers with `rung`, coverage states)."""
    rungs = []

    def take(rows, rung, done):
        if rows is None:
            return None
        rows = rows.withColumn("rung", F.lit(rung))
        return rows if done is None else jo.anti_by_key(rows, done, ["source_id"])

    def finish(done, rows):
        ids = rows.select("source_id").distinct()
        return ids if done is None else done.union(ids).distinct()

    done = None
    if posts is not None:
        own = states.where("is_post_source").select("source_id")
        rungs.append(jo.semi_by_key(posts.withColumn("rung", F.lit("posts")), own, ["source_id"]))
        done = own
    for name, rows in (("shop-api", shop_api), ("commerce-api", commerce_api)):
        rows = take(rows, name, done)
        if rows is not None:
            rungs.append(rows)
            done = finish(done, rows)
    open_rows = take(bulk_feed, "bulk-feed", done)
    listed = take(listings, "listing", done)
    if listed is not None:
        listed = dedupe_listings(jo.union_all(*[x for x in (open_rows, listed) if x is not None]))
        if listing_details is not None:
            listed = jo.validate_discount_on_detail(listed, listing_details)
        listed = listed.withColumn("rung", F.coalesce("rung", F.lit("listing")))
        rungs.append(listed)
        done = finish(done, listed.where(_proven()))
    elif open_rows is not None:
        rungs.append(open_rows)
    fed = take(json_feed, "feed", done)
    if fed is not None:
        rungs.append(fed)
        done = finish(done, fed)
    structured = take(jsonld, "json-ld", done)
    shown = take(cards, "card", done)
    if shown is not None and structured is not None:
        shown = jo.anti_by_key(shown, structured, ["source_id", "page_id"])
    generic = [x for x in (structured, shown) if x is not None]
    if generic:
        pages = jo.union_all(*generic)
        if rendered is not None:
            pages = jo.merge_rendered_evidence(pages, take(rendered, "rendered", done))
        rungs.append(pages)
    offers = jo.union_all(*rungs)
    if source_brands is not None:
        offers = jo.enrich_source_brand(offers, source_brands)

    seen = offers.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("parsed_offers"), F.bool_or(_proven()).alias("proven"),
        F.bool_or(c("rung").isin("shop-api", "commerce-api", "feed", "posts")
                  | (c("rung") == "listing") & _proven()).alias("structured"),
        F.bool_or(tx.is_eligible(c("name"), c("description"))).alias("relevant"))
    s = states.join(seen, "source_id", "left").withColumns({
        "parsed_offers": F.coalesce("parsed_offers", F.lit(0)),
        **{x: F.coalesce(x, F.lit(False)) for x in ("proven", "structured", "relevant")}})
    status = (F.when(c("structured"), F.lit("success"))
              .when(c("blocked") & ~c("relevant"), F.lit("blocked"))
              .when(c("blocked"), F.lit("partial"))
              .when(c("proven"), F.when(c("discovered_urls") > 1, F.lit("success")).otherwise(F.lit("partial")))
              .when(c("parsed_offers") > 0, F.lit("partial")).otherwise(F.lit("failed")))
    coverage = s.withColumn("status", status).drop("proven", "structured", "relevant")
    if details is not None:
        readable = coverage.where(~c("status").isin("blocked", "failed") & ~c("is_post_source")).select("source_id")
        offers = jo.union_all(jo.merge_detail(jo.semi_by_key(offers, readable, ["source_id"]), details),
                              jo.anti_by_key(offers, readable, ["source_id"]))
    return offers, coverage
