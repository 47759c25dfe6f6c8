"""Saved responses of shop-system APIs.

Input: one row per product with source_id, seq, the product struct `p` (schemas.py) and the
source's settings: origin, currency, store_brand, size_map, url_suffix (all nullable)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import money as mo
from ..functions import sizes as sz
from ..functions import text as tx
from ..operators.ranking import first_per_key
from .common import offer_columns, with_source

c = F.col
_NO_TEXTS = "array<string>"


def _named(name, names):
    return F.lower(F.trim(tx.blank(name))).isin(*names)


def _finish(d: DataFrame, sources: DataFrame) -> DataFrame:
    return offer_columns(with_source(first_per_key(d, ["source_id", "url"], "seq"), sources))


def shopify_to_offers(products: DataFrame, sources: DataFrame) -> DataFrame:
    """The cheapest selectable variant is the offer, its own compare-at price the
    reference; sizes are the distinct values of size options over selectable variants."""
    p = c("p")
    d = products.withColumn("live", F.filter(p["variants"], lambda v: F.coalesce(v["available"], F.lit(True))))
    priced = F.filter(F.transform("live", lambda v, i: F.struct(
        mo.parse_money(v["price"], "plain").alias("price"), i.alias("i"),
        mo.parse_money(v["compare_at_price"], "plain").alias("rrp"))), lambda x: x["price"].isNotNull())
    options = [("option1", 0), ("option2", 1), ("option3", 2)]
    is_size = F.transform(F.coalesce(p["options"], F.array()), lambda o: _named(o["name"], fv.SIZE_OPTION_NAMES))
    d = tx.computed(d, {"best": F.array_min(priced), "is_size": is_size})
    values = F.flatten(F.transform("live", lambda v: F.filter(F.array(*[
        F.when(F.get(c("is_size"), F.lit(i)), tx.or_null(v[o])) for o, i in options]), lambda x: x.isNotNull())))
    d = tx.computed(d.where((tx.blank(p["title"]) != "") & (tx.blank(p["handle"]) != "") & c("best").isNotNull()),
                    {"sizes": F.array_distinct(values)})
    rrp = F.when(c("best.rrp") > c("best.price"), c("best.rrp"))
    d = d.select(
        "source_id", "seq", F.concat("origin", F.lit("/products/"), p["handle"]).alias("url"),
        F.get(p["images"], F.lit(0))["src"].alias("image_url"),
        F.coalesce(tx.or_null(p["vendor"]), c("store_brand")).alias("brand"), p["title"].alias("name"), "currency",
        c("best.price").alias("price"), rrp.alias("rrp"),
        F.when(rrp.isNotNull(), F.lit("shopify:compare_at_price")).alias("rrp_source"),
        F.when(c("size_map").isNotNull(), sz.size_label_map(c("sizes"), c("size_map"))).otherwise(c("sizes")).alias("sizes"),
        F.when(F.size("sizes") > 0, F.lit("available")).alias("size_availability"), F.lit("in_stock").alias("availability"),
        tx.clean_text(F.concat_ws(" ", p["product_type"], p["body_html"])).alias("description"))
    return _finish(d, sources)


def woocommerce_to_offers(products: DataFrame, sources: DataFrame) -> DataFrame:
    """Minor-unit prices in EUR of products in stock; listed sizes are no stock claim."""
    p = c("p")
    unit = F.pow(F.lit(10.0), F.coalesce(p["prices"]["currency_minor_unit"], F.lit(2)))
    terms = F.flatten(F.transform(F.filter(p["attributes"], lambda a: _named(a["name"], fv.SIZE_ATTRIBUTE_NAMES)),
                                  lambda a: F.transform(F.coalesce(a["terms"], F.array()), lambda t: F.trim(tx.blank(t["name"])))))
    d = products.where(
        (tx.blank(p["name"]) != "") & (tx.blank(p["permalink"]) != "") & F.coalesce(p["is_in_stock"], F.lit(True))
        & (F.upper(tx.blank(p["prices"]["currency_code"])) == "EUR"))
    d = tx.computed(d, {"price": mo.number(p["prices"]["price"]) / unit, "regular": mo.number(p["prices"]["regular_price"]) / unit})
    rrp = F.when(c("regular") > c("price"), c("regular"))
    d = d.where(c("price") > 0).select(
        "source_id", "seq", p["permalink"].alias("url"), F.get(p["images"], F.lit(0))["src"].alias("image_url"),
        F.coalesce(tx.or_null(F.get(p["brands"], F.lit(0))["name"]), c("store_brand")).alias("brand"),
        tx.clean_text(p["name"]).alias("name"), F.lit("EUR").alias("currency"), "price", rrp.alias("rrp"),
        F.when(rrp.isNotNull(), F.lit("woocommerce:regular_price")).alias("rrp_source"),
        F.coalesce(F.filter(terms, lambda t: t != ""), F.array().cast(_NO_TEXTS)).alias("sizes"),
        F.lit("in_stock").alias("availability"), tx.clean_text(p["short_description"]).alias("description"))
    return _finish(d, sources)


def magento_brand_labels(responses: DataFrame) -> DataFrame:
    """(source_id, brand_id, label) from the search aggregations of responses
    (source_id, seq, aggregations); the last label of an id counts."""
    a = responses.select("source_id", "seq", F.posexplode("aggregations").alias("ap", "a"))
    a = a.where(_named(c("a.attribute_code"), fv.BRAND_ATTRIBUTE_CODES))
    o = a.select("source_id", "seq", "ap", F.posexplode("a.options").alias("op", "o")).where(
        c("o.value").isNotNull() & (tx.blank(c("o.label")) != ""))
    return o.groupBy("source_id", c("o.value").alias("brand_id")).agg(
        F.max_by(F.trim("o.label"), F.struct("seq", "ap", "op")).alias("label"))


def magento_to_offers(items: DataFrame, sources: DataFrame, brands: DataFrame) -> DataFrame:
    """Final against regular price in EUR; sizes of in-stock variants of the size option."""
    from ..operators.joins import lookup_join
    p = c("p")
    low = p["price_range"]["minimum_price"]
    d = items.where((tx.blank(p["name"]) != "") & (tx.blank(p["url_key"]) != "") & (low["final_price"]["value"] != 0)
                    & (F.coalesce(p["stock_status"], F.lit("")) != "OUT_OF_STOCK")
                    & (F.upper(tx.blank(low["final_price"]["currency"])) == "EUR"))
    option = F.get(F.filter(p["configurable_options"], lambda o: _named(o["label"], fv.SIZE_ATTRIBUTE_NAMES)
                            | F.lower(tx.blank(o["attribute_code"])).rlike(fv.SIZE_ATTRIBUTE_CODE_PATTERN)), F.lit(0))
    d = tx.computed(d, {"size_code": option["attribute_code"], "brand_id": p["manufacturer"]})
    live = F.filter(p["variants"], lambda v: F.coalesce(v["product"]["stock_status"], F.lit("")) != "OUT_OF_STOCK")
    labels = F.flatten(F.transform(live, lambda v: F.transform(
        F.filter(F.coalesce(v["attributes"], F.array()), lambda a: a["code"] == c("size_code")),
        lambda a: F.trim(tx.blank(a["label"])))))
    sizes = F.coalesce(F.array_distinct(F.filter(labels, lambda x: x != "")), F.array().cast(_NO_TEXTS))
    d = d.withColumn("url", F.concat("origin", F.lit("/"), p["url_key"], F.coalesce(p["url_suffix"], c("url_suffix"), F.lit(".html"))))
    d = lookup_join(d, brands.select("source_id", "brand_id", "label"), ["source_id", "brand_id"], "url")
    price, regular = low["final_price"]["value"], low["regular_price"]
    rrp = F.when((regular["value"] > price) & (F.upper(tx.blank(regular["currency"])) == "EUR"), regular["value"])
    d = d.select(
        "source_id", "seq", "url", p["small_image"]["url"].alias("image_url"), F.coalesce("label", "store_brand").alias("brand"),
        tx.clean_text(p["name"]).alias("name"), F.lit("EUR").alias("currency"), price.alias("price"), rrp.alias("rrp"),
        F.when(rrp.isNotNull(), F.lit("magento:regular_price")).alias("rrp_source"), sizes.alias("sizes"),
        F.lit("in_stock").alias("availability"))
    d = d.withColumn("size_availability", F.when(F.size("sizes") > 0, F.lit("available")))
    return _finish(d, sources)
