"""Source adapters over feeds, API responses and pages derived from the given tables."""
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import money as mo
from ..functions import sizes as sz
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import ranking as rk
from ..operators.normalize import listing_gates
from ..operators.sinks import work_folder
from ..schemas import FEED_ROW, MAGENTO_AGGREGATIONS, MAGENTO_ITEM, SHOPIFY_PRODUCT, WOO_PRODUCT  # noqa: F401
from ..settings import DEFAULT
from ..sources import claims, feeds, links, pages, reference, shop_apis
from . import oracle_parts as op
from .registry import query
from .views import SEQ, shared, table

c = F.col
BR = list(DEFAULT.brands)


def euros(x):
    return f"CAST(floor(({x}) / 100) AS BIGINT)"


def de(x):
    """Cents as "1.299,90"."""
    e = euros(x)
    return (f"(CASE WHEN {e} >= 1000 THEN CAST(CAST(floor({e} / 1000) AS BIGINT) AS STRING) || '.' || "
            f"lpad(CAST({e} % 1000 AS STRING), 3, '0') ELSE CAST({e} AS STRING) END || ',' || lpad(CAST(({x}) % 100 AS STRING), 2, '0'))")


def en(x):
    """Cents as "1299.90"."""
    return f"(CAST({euros(x)} AS STRING) || '.' || lpad(CAST(({x}) % 100 AS STRING), 2, '0'))"


_IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
BASE_SQL = f"""SELECT {_IDS}, 'shop-' || CAST(l_suppkey AS STRING) AS source_id,
  CAST(floor(l_extendedprice / l_quantity * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS pc,
  CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS rc, CAST(l_quantity AS INT) AS q, p_size, l_returnflag, l_linestatus,
  CASE CAST(substr(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'Mammut' WHEN 1 THEN 'Rab' WHEN 2 THEN 'Odlo' ELSE 'Salewa' END AS brand,
  p_name || CASE WHEN p_type = 'STANDARD' THEN ' Damen Hose' WHEN p_type = 'PROMO' THEN ' Jacke' ELSE ' Trekking Hose' END AS name, p_type,
  'https://www.shop' || CAST(l_suppkey AS STRING) || '.example/p/' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS url
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
BASE = f"WITH base AS ({op.plain(BASE_SQL)})"
SOURCES_SQL = """SELECT 'shop-' || CAST(s_suppkey AS STRING) AS source_id, s_name AS name, CASE WHEN s_nationkey % 5 = 0 THEN 'FR' ELSE 'DE' END AS country,
  'https://shop' || CAST(s_suppkey AS STRING) || '.example' AS base_url FROM {supplier}"""


def base(spark, d, **more):
    b = shared(spark, d, BASE_SQL).withColumn("seq", F.struct(*SEQ))
    return b.selectExpr("*", *[f"{sql} AS {name}" for name, sql in more.items()])


def sources(spark, d):
    return shared(spark, d, SOURCES_SQL)


# ---- money and text functions ----------------------------------------------------------
@query("parse_money_styles", f"""{BASE} SELECT {_IDS}, pc / 100.0::DOUBLE AS first_number, pc / 100.0::DOUBLE AS strip_dots, pc / 100.0::DOUBLE AS de_first,
  pc / 100.0::DOUBLE AS plain, pc / 100.0::DOUBLE AS strip_symbols, pc / 100.0::DOUBLE AS first_amount, pc / 100.0::DOUBLE AS decimal FROM base""")
def parse_money_styles(spark, d):
    b = base(spark, d, german=de("pc"), english=en("pc"))
    g, e = c("german"), c("english")
    twice = F.concat(g, F.lit(" € "), g, F.lit(" €"))
    return b.select(*SEQ, mo.parse_money(twice).alias("first_number"), mo.parse_money(g, "strip_dots").alias("strip_dots"),
                    mo.parse_money(twice, "de_first").alias("de_first"), mo.parse_money(e, "plain").alias("plain"),
                    mo.parse_money(F.concat(F.lit("ab "), g, F.lit(" €")), "strip_symbols").alias("strip_symbols"),
                    mo.parse_money(twice, "first_amount").alias("first_amount"), mo.parse_money(e, "decimal").alias("decimal"))


@query("text_amounts", f"""{BASE} SELECT {_IDS}, 2 AS after, rc / 100.0::DOUBLE AS after_first, pc / 100.0::DOUBLE AS before_first, rc / 100.0::DOUBLE AS labelled,
  rc / 100.0::DOUBLE AS compared, 'post:price-comparison' AS compared_source, pc / 100.0::DOUBLE AS quoted, 'EUR' AS quoted_currency, true AS claim_ok, 'GBP' AS code FROM base""")
def text_amounts(spark, d):
    b = base(spark, d, card=f"'UVP ' || {de('rc')} || ' € jetzt ' || {de('pc')} || ' €'", lead=f"'€' || {en('pc')} || ' now'",
             post=f"'PVG: ' || {de('rc')} || ' € statt ' || {de('pc')} || ' €'", price="pc / CAST(100 AS DOUBLE)")
    b = tx.computed(b, {"amounts": mo.euro_amounts(c("card")), "reference": mo.post_reference(c("post")),
                        "quoted": mo.money_with_currency(F.concat(F.lit("Preis "), c("lead")))})
    return b.select(*SEQ, F.size("amounts").alias("after"), c("amounts")[0].alias("after_first"),
                    mo.euro_amounts(c("lead"))[0].alias("before_first"), mo.labelled_reference(c("card")).alias("labelled"),
                    c("reference.value").alias("compared"), c("reference.source").alias("compared_source"),
                    c("quoted.value").alias("quoted"), c("quoted.currency").alias("quoted_currency"),
                    mo.money_claim_matches(c("price"), F.lit("eur"), c("lead")).alias("claim_ok"),
                    mo.currency_code(F.when(c("q") > 0, F.lit("£"))).alias("code"))


@query("badges", f"""{BASE} SELECT {_IDS}, CAST(CASE WHEN 30 + q BETWEEN 40 AND 80 THEN 30 + q WHEN q BETWEEN 40 AND 80 THEN q END AS DOUBLE) AS pct, l_linenumber = 2 AS up_to FROM base""")
def badges(spark, d):
    b = base(spark, d, label="CASE WHEN l_linenumber = 2 THEN 'bis zu ' ELSE 'Sale ' END || '-' || CAST(30 + q AS STRING) || ' %'",
             second="CAST(q AS STRING) || '%'")
    return b.select(*SEQ, mo.badge_discount(F.array("label", "second"))["pct"].cast("double").alias("pct"), mo.is_up_to(c("label")).alias("up_to"))


@query("size_ranges", f"""{BASE} SELECT {_IDS}, array_to_string(list_transform(generate_series(40 + p_size % 10, 40 + p_size % 10 + 2 * (q % 8), 2), lambda x: CAST(x AS VARCHAR)), ',') AS numbers,
  CASE WHEN l_linenumber % 2 = 0 THEN 'S,M,L,XL,XXL,3XL,4XL' ELSE 'XS,S,M' END AS letters FROM base""")
def size_ranges(spark, d):
    b = base(spark, d, t="'Größen ' || CAST(40 + p_size % 10 AS STRING) || ' - ' || CAST(40 + p_size % 10 + 2 * (q % 8) AS STRING)",
             u="CASE WHEN l_linenumber % 2 = 0 THEN 'Gr. S-4XL' ELSE 'XS bis M' END")
    return b.select(*SEQ, F.array_join(sz.expand_size_ranges(c("t")), ",").alias("numbers"),
                    F.array_join(sz.expand_size_ranges(c("u")), ",").alias("letters"))


@query("size_label_map", f"{BASE} SELECT {_IDS}, CASE p_size WHEN 2 THEN 'M (2)' WHEN 3 THEN 'L (3)' ELSE CAST(p_size AS VARCHAR) END AS label FROM base")
def size_label_map(spark, d):
    mapping = F.create_map(F.lit("2"), F.lit("M"), F.lit("3"), F.lit("L"))
    return base(spark, d).select(*SEQ, sz.size_label_map(F.array(c("p_size").cast("string")), mapping)[0].alias("label"))


@query("fold_documents", r"""SELECT doc_id, md5(replace(replace(strip_accents(lower(replace(text, '’', ''''))), 'ø', 'o'), 'æ', 'ae')) AS folded FROM documents""")
def fold_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(tx.fold(c("text"))).alias("folded"))


@query("clean_pages", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x{00a0}\x{202f}]+', ' ', 'g'))) AS cleaned FROM pages""")
def clean_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", "html")
    return p.select("page_id", F.md5(tx.clean_text(c("html"))).alias("cleaned"))


@query("url_functions", r"""SELECT page_id, regexp_replace(url, '#.*$', '') AS no_fragment, regexp_replace(url, '[?#].*$', '') AS no_query,
  lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, starts_with(url, 'https://') AS secure_same,
  rtrim(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/') || '/x?y=1' AS resolved FROM pages""")
def url_functions(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    www = F.regexp_replace("url", "^https?://", "https://www.")
    return p.select("page_id", ur.canonical_url(c("url")).alias("no_fragment"), ur.canonical_url(c("url"), True).alias("no_query"),
                    ur.host_of(c("url")).alias("host"), ur.same_site(c("url"), F.regexp_replace(www, r"www\.www\.", "www.")).alias("secure_same"),
                    ur.absolute_url(c("url"), F.when(c("page_id") >= 0, F.lit("/x?y=1"))).alias("resolved"))


_PAGE_URLS = """SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) ||
  CASE page_id % 6 WHEN 0 THEN '/mammut/hosen/' WHEN 1 THEN '/damen/hose-' || CAST(page_id AS STRING) WHEN 2 THEN '/fj%C3%A4llr%C3%A4ven-keb-trousers' WHEN 3 THEN '/outlet/'
    WHEN 4 THEN '/norr%C3%B8na/pants' ELSE '/category/x' || CAST(page_id AS STRING) END AS target, page_id FROM {pages}"""


@query("rank_urls", f"""WITH u AS ({op.plain(_PAGE_URLS)}), once AS (SELECT 'all' AS source_id, target AS url, min(page_id) AS idx FROM u GROUP BY 2),
  s AS (SELECT *, CASE WHEN regexp_matches(url, 'mammut|fj%C3|norr%C3') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(url, 'hose|trousers|pants') THEN 5 ELSE 0 END
    - CASE WHEN contains(url, '/damen/') THEN 16 ELSE 0 END - CASE WHEN regexp_matches(url, '/category/|/outlet/$|/hosen/$') THEN 3 ELSE 0 END AS score FROM once)
  SELECT * FROM s""")
def rank_urls(spark, d):
    u = shared(spark, d, _PAGE_URLS).select(F.lit("all").alias("source_id"), c("target").alias("url"), c("page_id").alias("idx"))
    return rk.rank_urls(u, BR)


# ---- S2-S5 -----------------------------------------------------------------------------------
_ROW_JSON = (f"""'{{"' || CASE WHEN l_linenumber % 2 = 0 THEN 'link' ELSE 'url' END || '":"' || url || '","' || CASE WHEN l_linenumber % 2 = 0 THEN 'title' ELSE 'name' END ||
 '":"' || name || '","brand":"' || brand || '","sizes":["L","M"],"price":"' || {en('pc')} || '","' || CASE l_linenumber % 3 WHEN 0 THEN 'rrp' WHEN 1 THEN 'msrp' ELSE 'listPrice' END || '":' || {en('rc')} || '}}'""")


@query("read_json_feed", f"""{BASE}
  SELECT source_id, url, name, brand, 'EUR' AS currency, pc / 100.0::DOUBLE AS price, rc / 100.0::DOUBLE AS rrp,
  CASE l_linenumber % 3 WHEN 0 THEN 'feed:rrp' WHEN 1 THEN 'feed:msrp' END AS rrp_source, 'L,M' AS sizes FROM base""")
def read_json_feed(spark, d):
    b = base(spark, d, row=_ROW_JSON)
    body = (F.when(c("l_linenumber") % 3 == 0, F.concat(F.lit('{"products":['), "row", F.lit("]}")))
            .when(c("l_linenumber") % 3 == 1, F.concat(F.lit("["), "row", F.lit("]")))
            .otherwise(F.concat(F.lit('{"items":['), "row", F.lit("]}"))))
    out = feeds.read_json_feed(b.select("source_id", "seq", body.alias("body")), sources(spark, d))
    return out.select("source_id", "url", "name", "brand", "currency", "price", "rrp", "rrp_source", F.array_join("sizes", ",").alias("sizes"))


@query("read_tsv_feed", f"""{BASE} SELECT lower(CAST(l_partkey AS VARCHAR) || '|' || brand || '|' || name) AS model, brand, name,
   array_to_string(list_sort(list(DISTINCT CAST(p_size + q % 3 AS VARCHAR))), ',') AS sizes, bool_or(l_returnflag = 'A') AS in_stock
  FROM base WHERE brand <> 'Salewa' AND p_type NOT IN ('STANDARD', 'PROMO') GROUP BY 1, 2, 3""")
def read_tsv_feed(spark, d):
    b = base(spark, d, vk=de("pc"))
    rows = b.select(
        c("brand").alias("Hersteller"), c("name").alias("Bezeichnung"), F.lit("Text").alias("Beschreibung"),
        F.lit("Herren > Hosen").alias("Kategorie"), F.when(c("p_type") == "STANDARD", F.lit("Damen")).otherwise(F.lit("Herren")).alias("Geschlecht"),
        F.lit("x").alias("Stichworte"), c("vk").alias("VK"), c("url").alias("Partnerlink"), (c("p_size") + c("q") % 3).cast("string").alias("Groesse"),
        F.lit("0").alias("Versandkosten"), F.when(c("l_returnflag") == "A", F.lit("Sofort lieferbar")).otherwise(F.lit("bald")).alias("Lieferstatus"),
        c("l_partkey").cast("string").alias("Modellnr"), F.lit("i").alias("Bild-url"), F.lit("EUR").alias("Währung"))
    rows = rows.withColumn("Kategorie", F.when(c("Geschlecht") == "Damen", F.lit("Damen > Hosen")).otherwise(
        F.when(c("Bezeichnung").endswith("Jacke"), F.lit("Herren > Jacken")).otherwise(c("Kategorie"))))
    path = work_folder(spark, "tsv")
    rows.write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    lines = feeds.read_tsv_lines(spark, path)
    out = feeds.group_tsv(feeds.tsv_rows(lines, "shop-1"))
    return out.select(c("_key").alias("model"), "brand", "name", F.array_join(F.array_sort("sizes"), ",").alias("sizes"), "in_stock")


_POSTS = "posted AS (SELECT *, (SELECT max(o_orderdate) FROM orders) AS newest, o_orderdate AS posted_at FROM base JOIN orders ON l_orderkey = o_orderkey)"


@query("posts_to_offers", f"""{BASE}, {_POSTS} SELECT url, name, pc / 100.0::DOUBLE AS price, CASE WHEN rc > pc THEN rc / 100.0::DOUBLE END AS rrp,
   CASE WHEN rc > pc THEN CASE WHEN l_linenumber % 2 = 0 THEN 'post:price-comparison' ELSE 'post:labelled-reference-price' END END AS rrp_source,
   's' || source_id || ' (via posts)' AS merchant, 'S,M,L' AS sizes
  FROM posted WHERE l_orderkey >= 0 AND posted_at >= newest - INTERVAL 400 DAY AND l_linenumber <> 7""")
def posts_to_offers(spark, d):
    b = base(spark, d, p=de("pc"), r=de("rc")).join(
        table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_orderdate").cast("timestamp").alias("at")), "l_orderkey")
    label = F.when(c("l_linenumber") % 2 == 0, F.lit("PVG: ")).otherwise(F.lit("UVP "))
    items = b.select(
        F.concat(F.lit("102° - "), "name", F.when(c("l_linenumber") == 7, F.lit(" (abgelaufen)")).otherwise(F.lit(""))).alias("title"),
        F.concat_ws("-", "url", c("l_orderkey").cast("string")).alias("link"),
        F.concat(F.lit("<p>Gr. S-L</p>"), label, "r", F.lit(" €")).alias("description"),
        F.concat(F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pubDate"),
        F.struct(F.concat(F.lit("s"), "source_id").alias("_name"), F.concat("p", F.lit("€")).alias("_price")).alias("merchant"))
    path = work_folder(spark, "rss")
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    now = table(spark, d, "orders").agg(F.max("o_orderdate").cast("timestamp")).first()[0]
    posts = feeds.read_rss_posts(spark, path, "https://www.shop")
    src = sources(spark, d).orderBy("source_id").limit(1).withColumn("source_id", F.lit("posts"))
    out = feeds.posts_to_offers(posts, src, "posts", F.lit(now), max_age_days=400)
    return out.select(F.regexp_replace("url", r"-\d+$", "").alias("url"), "name", "price", "rrp", "rrp_source", "merchant",
                      F.array_join("sizes", ",").alias("sizes"))


# ---- S6-S9 ---------------------------------------------------------------------------------------
_SHOPIFY = (f"""'{{"title":"' || name || '","handle":"h' || CAST(l_partkey AS STRING) || '-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '","vendor":"' || CASE WHEN brand = 'Rab' THEN '' ELSE brand END ||
 '","product_type":"Hose","body_html":"<p>Leicht</p>","options":[{{"name":"Farbe","position":1}},{{"name":"Größe","position":2}}],"variants":[' ||
 '{{"price":"' || {en('pc + 500')} || '","compare_at_price":"' || {en('rc + 500')} || '","available":true,"option1":"Blue","option2":"3"}},' ||
 '{{"price":"' || {en('pc')} || '","compare_at_price":"' || {en('rc')} || '","available":' || CASE WHEN l_returnflag = 'R' THEN 'false' ELSE 'true' END || ',"option1":"Blue","option2":"2"}}]}}'""")


@query("shopify_to_offers", f"""{BASE} SELECT source_id, 'https://s.example/products/h' || l_partkey || '-' || l_orderkey || '-' || l_linenumber AS url, CASE WHEN brand = 'Rab' THEN 'Own' ELSE brand END AS brand,
  (CASE WHEN l_returnflag = 'R' THEN pc + 500 ELSE pc END) / 100.0::DOUBLE AS price, CASE WHEN rc > pc THEN (CASE WHEN l_returnflag = 'R' THEN rc + 500 ELSE rc END) / 100.0::DOUBLE END AS rrp,
  CASE WHEN l_returnflag = 'R' THEN 'L (3)' ELSE 'L (3),M (2)' END AS sizes, 'Hose Leicht' AS description
  FROM base QUALIFY row_number() OVER (PARTITION BY source_id, l_partkey, l_orderkey, l_linenumber ORDER BY {_IDS}) = 1""")
def shopify_to_offers(spark, d):
    b = base(spark, d, js=_SHOPIFY).select(
        "source_id", "seq", F.from_json("js", SHOPIFY_PRODUCT).alias("p"), F.lit("https://s.example").alias("origin"), F.lit("EUR").alias("currency"),
        F.lit("Own").alias("store_brand"), F.create_map(F.lit("2"), F.lit("M"), F.lit("3"), F.lit("L")).alias("size_map"))
    return shop_apis.shopify_to_offers(b, sources(spark, d)).select(
        "source_id", "url", "brand", "price", "rrp", F.array_join("sizes", ",").alias("sizes"), "description")


_WOO = ("""'{"name":"' || name || '","permalink":"' || url || '","is_in_stock":' || CASE WHEN l_returnflag = 'R' THEN 'false' ELSE 'true' END || ',"prices":{"price":"' || CAST(pc AS STRING) ||
 '","regular_price":"' || CAST(rc AS STRING) || '","currency_code":"' || CASE WHEN l_suppkey % 5 = 0 THEN 'CHF' ELSE 'EUR' END || '","currency_minor_unit":2},"attributes":[{"name":"Größe","terms":[{"name":"L"},{"name":"' ||
 CAST(p_size AS STRING) || '"}]}],"brands":[{"name":"' || brand || '"}],"short_description":"<b>gut</b>"}'""")


@query("woocommerce_to_offers", f"""{BASE} SELECT source_id, url, brand, pc / 100.0::DOUBLE AS price, CASE WHEN rc > pc THEN rc / 100.0::DOUBLE END AS rrp, 'L,' || p_size AS sizes, 'gut' AS description
  FROM (SELECT * FROM base WHERE l_returnflag <> 'R' AND l_suppkey % 5 <> 0) QUALIFY row_number() OVER (PARTITION BY source_id, url ORDER BY {_IDS}) = 1""")
def woocommerce_to_offers(spark, d):
    b = base(spark, d, js=_WOO).select("source_id", "seq", F.from_json("js", WOO_PRODUCT).alias("p"), F.lit(None).cast("string").alias("store_brand"))
    return shop_apis.woocommerce_to_offers(b, sources(spark, d)).select(
        "source_id", "url", "brand", "price", "rrp", F.array_join("sizes", ",").alias("sizes"), "description")


_MAGENTO = (f"""'{{"name":"' || name || '","url_key":"k' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '","stock_status":"' || CASE WHEN l_returnflag = 'R' THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END ||
 '","manufacturer":' || CAST(p_size AS STRING) || ',"price_range":{{"minimum_price":{{"regular_price":{{"value":' || {en('rc')} || ',"currency":"EUR"}},"final_price":{{"value":' || {en('pc')} || ',"currency":"EUR"}}}}}},' ||
 '"configurable_options":[{{"attribute_code":"mp_size","label":"Maat"}}],"variants":[{{"attributes":[{{"code":"color","label":"Blue"}},{{"code":"mp_size","label":"L"}}],"product":{{"stock_status":"IN_STOCK"}}}},' ||
 '{{"attributes":[{{"code":"mp_size","label":"M"}}],"product":{{"stock_status":"' || CASE WHEN l_linestatus = 'O' THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END || '"}}}}]}}'""")
_AGG = """'[{"attribute_code":"color","options":[{"label":"x","value":"1"}]},{"attribute_code":"manufacturer","options":[{"label":"' || brand || ' ","value":"' || CAST(p_size AS STRING) || '"}]}]'"""
_LABELS = "labels0 AS (SELECT source_id, p_size, arg_max(brand, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS label FROM base GROUP BY 1, 2)"


def _brand_labels(spark, d):
    b = base(spark, d, agg=_AGG)
    return shop_apis.magento_brand_labels(b.select("source_id", "seq", F.from_json("agg", MAGENTO_AGGREGATIONS).alias("aggregations")))


@query("magento_brand_labels", f"{BASE}, {_LABELS} SELECT source_id, CAST(p_size AS VARCHAR) AS brand_id, label FROM labels0")
def magento_brand_labels(spark, d):
    return _brand_labels(spark, d)


@query("magento_to_offers", f"""{BASE}, {_LABELS} SELECT b.source_id, 'https://m.example/k' || l_partkey || '-' || l_linenumber || '.html' AS url, label AS brand, pc / 100.0::DOUBLE AS price,
  CASE WHEN rc > pc THEN rc / 100.0::DOUBLE END AS rrp, CASE WHEN l_linestatus = 'O' THEN 'L' ELSE 'L,M' END AS sizes
  FROM (SELECT * FROM base WHERE l_returnflag <> 'R') b LEFT JOIN labels0 ON labels0.source_id = b.source_id AND labels0.p_size = b.p_size
  QUALIFY row_number() OVER (PARTITION BY b.source_id, l_partkey, l_linenumber ORDER BY {_IDS}) = 1""")
def magento_to_offers(spark, d):
    b = base(spark, d, js=_MAGENTO).select(
        "source_id", "seq", F.from_json("js", MAGENTO_ITEM).alias("p"), F.lit("https://m.example").alias("origin"),
        F.lit(None).cast("string").alias("url_suffix"), F.lit(None).cast("string").alias("store_brand"))
    return shop_apis.magento_to_offers(b, sources(spark, d), _brand_labels(spark, d)).select(
        "source_id", "url", "brand", "price", "rrp", F.array_join("sizes", ",").alias("sizes"))


# ---- S10-S15, S19: pages --------------------------------------------------------------------------
_LD_PAGE = (f"""'<html><body>' || CASE WHEN l_linenumber = 2 THEN '<span class="Badge-sale">-50 %</span>' ELSE '' END || '<script type="application/ld+json">{{"@graph":[{{"@type":"Product","name":"' || name || '","brand":{{"@type":"Brand","name":"' || brand ||
 '"}},"image":["/i.jpg"]' || CASE WHEN l_linenumber = 3 THEN ',"rrp":"{{"' || '""' ELSE '' END || ',"offers":[{{"@type":"Offer","price":"' || {en('pc')} || '","priceCurrency":"EUR","size":{{"name":"L (52)"}},"availability":"https://schema.org/' ||
 CASE WHEN l_returnflag = 'R' THEN 'OutOfStock' ELSE 'InStock' END || '"' || CASE WHEN l_linestatus = 'O' THEN ',"priceSpecification":[{{"priceType":"https://schema.org/StrikethroughPrice","price":' || {en('rc')} || '}}]' ELSE '' END ||
 '}},{{"@type":"Offer","price":' || {en('pc + 100')} || ',"listPrice":' || {en('rc')} || ',"size":"M","availability":"InStock"}}]}}]}}</script></body></html>'""")


def _pages(spark, d, html):
    return base(spark, d, html=html).select(c("seq").alias("page_id"), "source_id", "url", "html")


@query("jsonld_offers", f"""{BASE}, two AS (SELECT *, pc AS vp, 'L (52)' AS size, l_returnflag <> 'R' AS live, CASE WHEN l_linestatus = 'O' AND rc > pc THEN rc END AS ref, 'offer.priceSpecification.strikethrough' AS src FROM base
   UNION ALL SELECT *, pc + 100, 'M', true, CASE WHEN rc > pc + 100 THEN rc END, 'offer.listPrice' FROM base)
  SELECT {_IDS}, url, name, brand, vp / 100.0::DOUBLE AS price, size, ref / 100.0::DOUBLE AS rrp, CASE WHEN ref IS NOT NULL THEN src END AS rrp_source,
   CASE WHEN live THEN 'available' ELSE 'unknown' END AS size_availability, CASE WHEN live THEN 'InStock' ELSE 'OutOfStock' END AS availability,
   CASE WHEN l_linenumber = 2 AND ref IS NULL THEN 50.0::DOUBLE END AS observed_discount_pct FROM two WHERE l_linenumber <> 3""")
def jsonld_offers(spark, d):
    # Pages of line 3 carry broken JSON and give no row.
    out = pages.jsonld_offers(_pages(spark, d, _LD_PAGE), sources(spark, d))
    return out.select("page_id.*", "url", "name", "brand", "price", c("sizes")[0].alias("size"), "rrp", "rrp_source", "size_availability",
                      "availability", "observed_discount_pct")


_CARD_PAGE = (f"""'<main><article class="product-card"><a href="/p/' || CAST(l_partkey AS STRING) || '?x=1"><img src="/i.jpg"><h3>' || name || '</h3></a><span class="brand">' || brand || '</span>' ||
 CASE l_linenumber % 3 WHEN 0 THEN '<span class="product-price">' || {de('pc')} || ' €' || {de('pc')} || ' €</span><del>' || {de('rc')} || ' €</del>'
   WHEN 1 THEN '<div>UVP ' || {de('rc')} || ' €</div><div>' || {de('pc')} || ' €</div>' ELSE '<b>' || {de('pc')} || ' €</b>' END ||
 '<i class="discount-tag">-' || CAST(30 + q AS STRING) || ' %</i>' || CASE WHEN l_returnflag = 'R' THEN '<p>Ausverkauft</p>' ELSE '' END ||
 '</article><article><a href="#">x</a></article></main>'""")


@query("html_card_offers", f"""{BASE} SELECT {_IDS}, regexp_extract(url, '^(https://[^/]+)', 1) || '/p/' || l_partkey || '?x=1' AS url, name, brand, pc / 100.0::DOUBLE AS price,
  CASE WHEN l_linenumber % 3 < 2 AND rc > pc THEN rc / 100.0::DOUBLE END AS rrp,
  CASE WHEN rc > pc THEN CASE l_linenumber % 3 WHEN 0 THEN 'html:marked-reference-price' WHEN 1 THEN 'html:labelled-reference-price' END END AS rrp_source,
  CASE WHEN NOT (l_linenumber % 3 < 2 AND rc > pc) AND 30 + q BETWEEN 40 AND 80 THEN (30 + q)::DOUBLE END AS observed_discount_pct,
  CASE WHEN l_returnflag = 'R' THEN 'out_of_stock' ELSE 'unknown' END AS availability FROM base""")
def html_card_offers(spark, d):
    out = pages.html_card_offers(_pages(spark, d, _CARD_PAGE), sources(spark, d))
    return out.select("page_id.*", "url", "name", "brand", "price", "rrp", "rrp_source", "observed_discount_pct", "availability")


_LIST_PAGE = (f"""'<nav><a href="/n">Mammut Hose 99,00 €</a></nav><ul><li class="tile"><a href="/p/' || CAST(l_partkey AS STRING) || '?v=1#a">' || brand || ' ' || name || '</a> <b>' || {de('pc')} || ' €</b> <s>' || {de('rc')} || ' €</s>' ||
 '<span class="badge">' || CASE WHEN l_linenumber = 2 THEN 'bis ' ELSE '' END || '-' || CAST(30 + q AS STRING) || ' %</span></li></ul>'""")


@query("listing_link_offers", f"""{BASE}, hit AS (SELECT *, least(CASE WHEN pc > 500 AND pc < 500000 THEN pc END, rc) AS low FROM base WHERE brand <> 'Salewa' AND p_type NOT IN ('STANDARD', 'PROMO'))
  SELECT {_IDS}, regexp_extract(url, '^(https://[^/]+)', 1) || '/p/' || l_partkey AS url, brand || ' ' || name AS name, brand, low / 100.0::DOUBLE AS price,
  CASE WHEN 30 + q BETWEEN 40 AND 80 THEN (30 + q)::DOUBLE END AS observed_discount_pct,
  CASE WHEN 30 + q BETWEEN 40 AND 80 THEN CASE WHEN l_linenumber = 2 THEN 'merchant:displayed-discount-upto' ELSE 'merchant:displayed-discount' END END AS discount_source FROM hit""")
def listing_link_offers(spark, d):
    out = pages.listing_link_offers(_pages(spark, d, _LIST_PAGE), sources(spark, d))
    return out.where(c("url").contains("/p/")).select("page_id.*", "url", "name", "brand", "price", "observed_discount_pct", "discount_source")


@query("listing_gates", f"""{BASE}, hit AS (SELECT *, least(CASE WHEN pc > 500 AND pc < 500000 THEN pc END, rc) AS low FROM base WHERE brand <> 'Salewa' AND p_type NOT IN ('STANDARD', 'PROMO'))
  SELECT {_IDS}, brand, low / 100.0::DOUBLE AS price FROM hit""")
def gates(spark, d):
    b = base(spark, d, text=f"brand || ' ' || name || ' ' || {de('pc')} || ' € ' || {de('rc')} || ' €'")
    return listing_gates(b.drop("brand")).select(*SEQ, "brand", "price")


_STATE_PAGE = (f"""'<script>window.s={{elementsList: [{{"data":{{"productId":"' || CAST(1000000 + l_partkey AS STRING) || '","name":"' || name || ' \\\\"X\\\\" ]","brand":{{"name":"' || brand || '"}},"price":{{"current":"' || {de('pc')} || ' €","old":"' ||
 {de('rc')} || ' €"}}}}}}]}}</script><script type="application/ld+json">{{"itemListElement":[{{"url":"https://z.example/p/' || CAST(1000000 + l_partkey AS STRING) || '/"}}]}}</script>'""").replace("\\\\\\\\", "\\\\")


@query("embedded_state_offers", f"""{BASE} SELECT {_IDS}, 'https://z.example/p/' || (1000000 + l_partkey) || '/' AS url, brand, pc / 100.0::DOUBLE AS price,
  CASE WHEN rc > pc THEN rc / 100.0::DOUBLE END AS rrp, CASE WHEN rc > pc THEN 'merchant:listing-old-price' END AS rrp_source FROM base WHERE brand <> 'Salewa' AND p_type NOT IN ('STANDARD', 'PROMO')""")
def embedded_state_offers(spark, d):
    html = _STATE_PAGE.replace("\\\\", "")
    out = pages.embedded_state_offers(_pages(spark, d, html.replace('"X"', "X")), sources(spark, d))
    return out.select("page_id.*", "url", "brand", "price", "rrp", "rrp_source")


_RENDERED = f"""{BASE}, card AS (SELECT *, 'https://r.example/' || l_partkey AS href, 'order-' || l_orderkey AS page_url FROM base),
 one AS (SELECT * FROM card QUALIFY row_number() OVER (PARTITION BY page_url, href ORDER BY {_IDS}) = 1)"""


@query("rendered_card_offers", f"""{_RENDERED} SELECT page_url, href AS url, pc / 100.0::DOUBLE AS price, CASE WHEN l_linenumber % 3 < 2 AND rc > pc THEN rc / 100.0::DOUBLE END AS rrp,
  CASE WHEN rc > pc THEN CASE l_linenumber % 3 WHEN 0 THEN 'html:struck-through-price' WHEN 1 THEN 'html:labelled-reference-price' END END AS rrp_source,
  CASE WHEN NOT (l_linenumber % 3 < 2 AND rc > pc) AND 30 + q BETWEEN 40 AND 80 THEN (30 + q)::DOUBLE END AS observed_discount_pct FROM one""")
def rendered_card_offers(spark, d):
    b = base(spark, d, href="'https://r.example/' || CAST(l_partkey AS STRING)", page_url="'order-' || CAST(l_orderkey AS STRING)",
             text=f"""name || CASE l_linenumber % 3 WHEN 0 THEN ' ' || {de('pc')} || ' € ' || {de('rc')} || ' €' WHEN 1 THEN ' UVP ' || {de('rc')} || ' € ' || {de('pc')} || ' €'
               ELSE ' ' || {de('pc')} || ' €' END || ' -' || CAST(30 + q AS STRING) || ' %'""",
             struck_text=f"CASE WHEN l_linenumber % 3 = 0 THEN {de('rc')} || ' €' END", price_text="CAST(NULL AS STRING)", image="CAST(NULL AS STRING)")
    return pages.rendered_card_offers(b, sources(spark, d)).select("page_url", "url", "price", "rrp", "rrp_source", "observed_discount_pct")


@query("selectable_sizes", f"""{BASE}, l AS (SELECT 'p' || l_partkey AS page_url, CASE WHEN l_linenumber % 2 = 0 THEN 'W' || p_size ELSE CASE l_linenumber WHEN 1 THEN 'L' WHEN 3 THEN 'EU 50' ELSE 'One Size' END END AS label,
   row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM base WHERE l_returnflag <> 'R'),
  o AS (SELECT page_url, label, min(seq) AS seq FROM l WHERE NOT (label = 'One Size' OR length(label) = 2) GROUP BY 1, 2)
  SELECT page_url, array_to_string(list(label ORDER BY seq), ',') AS sizes FROM o GROUP BY 1""")
def selectable_sizes(spark, d):
    b = base(spark, d, page_url="'p' || CAST(l_partkey AS STRING)", label="""CASE WHEN l_linenumber % 2 = 0 THEN ' W' || CAST(p_size AS STRING)
       ELSE CASE l_linenumber WHEN 1 THEN 'L' WHEN 3 THEN 'EU  50' ELSE 'One Size' END END""", disabled="l_returnflag = 'R'")
    return pages.selectable_sizes(b).select("page_url", F.array_join("sizes", ",").alias("sizes"))


@query("candidate_snippets", f"""{BASE} SELECT {_IDS}, regexp_extract(url, '^(https://[^/]+)', 1) || '/p/' || l_partkey || '?v=1#a' AS url,
  brand || ' ' || name || ' ' || {op.plain(de('pc'))} || ' € ' || {op.plain(de('rc'))} || ' €' || CASE WHEN l_linenumber = 2 THEN 'bis ' ELSE '' END || '-' || (30 + q) || ' %' AS text FROM base""")
def candidate_snippets(spark, d):
    out = pages.candidate_snippets(_pages(spark, d, _LIST_PAGE))
    return out.select("page_id.*", "url", "text")


@query("page_link_counts", """SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href')) AS n_links FROM pages WHERE contains(html, '<a ')""")
def page_link_counts(spark, d):
    p = table(spark, d, "pages").withColumn("source_id", F.lit("x"))
    return pages.page_links(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


# ---- S16-S22 -----------------------------------------------------------------------------------------
@query("sitemap_urls", f"""{BASE} SELECT source_id, regexp_replace(url, 'www[.]', '') || '?a=1&b=2' AS url FROM base WHERE l_linenumber % 3 <> 1
   AND regexp_matches(lower(url || CASE WHEN l_linenumber % 3 = 0 THEN '/hose' ELSE '' END), 'hose|rab|men')""".replace("|| '?a=1&b=2' AS url", "|| CASE WHEN l_linenumber % 3 = 0 THEN '/hose' ELSE '' END || '?a=1&b=2' AS url"))
def sitemap_urls(spark, d):
    b = base(spark, d, xml="""'<urlset><url><loc>' || CASE WHEN l_linenumber % 3 = 1 THEN replace(url, 'https:', 'http:') ELSE replace(url, 'www.', '') END ||
      CASE WHEN l_linenumber % 3 = 0 THEN '/hose' ELSE '' END || '?a=1&amp;b=2</loc></url></urlset>'""")
    return links.sitemap_urls(b, sources(spark, d), BR).select("source_id", "url")


@query("product_links", f"""{BASE} SELECT l_orderkey, url || '.html' AS href FROM base WHERE p_type NOT IN ('STANDARD', 'PROMO')
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, url ORDER BY {_IDS}) = 1""")
def product_links(spark, d):
    b = base(spark, d, page_url="regexp_extract(url, '^(https://[^/]+)', 1) || '/sale/'", href="url || '.html'").select(
        F.struct("l_orderkey", "l_suppkey").alias("page_id"), "page_url", c("seq").alias("pos"), "href", c("name").alias("text"))
    return links.product_links(b).select("page_id.l_orderkey", "href")


@query("next_listing_pages", """WITH p AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS root FROM pages)
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN root || '/hosen/2/' WHEN 1 THEN root || '/hosen/?page=3&s=1' WHEN 2 THEN root || '/hosen/?p=2' END AS next_url FROM p WHERE page_id % 4 <> 3""")
def next_listing_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://"), ur.host_of(c("url"))).alias("root"))
    k = c("page_id") % 4
    page = F.concat("root", F.when(k == 1, F.lit("/hosen/?page=2&s=1")).otherwise(F.lit("/hosen/")))
    hrefs = F.array(F.struct(F.concat("root", F.lit("/other/2/")).alias("href"), F.lit("next").alias("label")),
                    F.struct(F.concat("root", F.when(k == 0, F.lit("/hosen/2/")).when(k == 1, F.lit("/hosen/?page=3&s=1#x"))
                                      .when(k == 2, F.lit("/hosen/?p=2")).otherwise(F.lit("/hosen/?p=3"))).alias("href"),
                             F.when(k == 2, F.lit("2")).otherwise(F.lit("next ›")).alias("label")),
                    F.struct(F.concat("root", F.lit("/hosen/?sort=2")).alias("href"), F.lit("weiter").alias("label")))
    rows = p.select("page_id", page.alias("page_url"), F.posexplode(hrefs).alias("pos", "l")).select("page_id", "page_url", "pos", "l.href", "l.label")
    return links.next_listing_pages(rows).select("page_id", "next_url")


def _extractions(spark, d):
    return base(spark, d, page_url="regexp_extract(url, '^(https://[^/]+)', 1) || '/o/' || CAST(l_orderkey AS STRING)",
                text=f"brand || ' ' || name || ' jetzt ' || {de('pc')} || ' € statt ' || {de('rc')} || ' €'", p=de("pc"), r=de("rc"))


@query("validate_extractions", f"""{BASE} SELECT {_IDS}, url, name, brand, pc / 100.0::DOUBLE AS price, CASE WHEN rc > pc AND l_linenumber <> 4 THEN rc / 100.0::DOUBLE END AS rrp
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, url ORDER BY {_IDS}) AS rn, count(*) OVER (PARTITION BY l_orderkey, url) AS n FROM base)
  WHERE n = 1 AND l_linenumber NOT IN (2, 3, 5)""")
def validate_extractions(spark, d):
    """Line 2 claims another amount, line 3 an address of another host, line 5 quotes the price
    without a label although the card names two amounts, line 4 a reference without label."""
    b = _extractions(spark, d)
    once = b.groupBy("page_url", "url").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return _validated(spark, d, b.join(once, ["page_url", "url"], "left_semi"))


def _validated(spark, d, b):
    b = b.withColumn("url", F.when(c("l_linenumber") == 3, F.regexp_replace("url", "shop", "other")).otherwise(c("url")))
    line = c("l_linenumber")
    cand = b.select("source_id", "page_url", "url", "text", c("seq").alias("pos"))
    claim = b.select(
        "page_url", "url", "seq", "name", F.concat_ws(" ", "brand", "name").alias("name_evidence"), "brand",
        F.when(line == 2, c("pc") / 100 + 1).otherwise(c("pc") / 100).alias("price"), F.lit("eur").alias("price_currency"),
        F.when(line == 5, F.concat("p", F.lit(" €"))).otherwise(F.concat(F.lit("jetzt "), "p", F.lit(" €"))).alias("price_evidence"),
        (c("rc") / 100).alias("rrp"), F.lit("EUR").alias("rrp_currency"),
        F.when(line == 4, F.concat("r", F.lit(" €"))).otherwise(F.concat(F.lit("statt "), "r", F.lit(" €"))).alias("rrp_evidence"))
    return claims.validate_extractions(cand, claim, sources(spark, d)).select("seq.*", "url", "name", "brand", "price", "rrp")


_WHOLE = f"OVER (PARTITION BY l_orderkey, url ORDER BY {_IDS} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query("validate_repeated_extractions", f"""{BASE} SELECT {_IDS}, url, name, brand, pc / 100.0::DOUBLE AS price,
  CASE WHEN rc > pc AND l_linenumber <> 4 AND rc = last_rc THEN rc / 100.0::DOUBLE END AS rrp
  FROM (SELECT *, last_value(name) {_WHOLE} AS last_name, last_value(brand) {_WHOLE} AS last_brand, last_value(rc) {_WHOLE} AS last_rc
    FROM base WHERE l_linenumber <> 3)
  WHERE l_linenumber NOT IN (2, 5) AND name = last_name AND brand = last_brand""")
def validate_repeated_extractions(spark, d):
    """The same over all rows: the last candidate of an address counts, and every claim of the
    address is held against it."""
    return _validated(spark, d, _extractions(spark, d))


@query("shipping_policies", """SELECT 'shop-' || CAST(s_suppkey AS VARCHAR) AS source_id, (3 + s_suppkey % 4) + 0.95::DOUBLE AS fee, CAST(40 + s_suppkey % 50 AS DOUBLE) AS free_from,
  s_suppkey % 2 = 0 AS free_returns FROM supplier WHERE s_suppkey % 5 <> 0""")
def shipping_policies(spark, d):
    k = c("s_suppkey")
    html = F.concat(F.lit("<body><script>1</script><table><tr><td>Deutschland</td><td>"), (3 + k % 4).cast("string"), F.lit(",95 €</td><td>"),
                    F.when(k % 5 == 0, F.lit("keine Angabe")).otherwise(F.concat(F.lit("Versandkostenfrei ab "), (40 + k % 50).cast("string"), F.lit(" €"))),
                    F.lit("</td></tr></table>"), F.when(k % 2 == 0, F.lit("Deutschland kostenfrei zurücksenden")).otherwise(F.lit("")), F.lit("</body>"))
    p = table(spark, d, "supplier").select(F.concat(F.lit("shop-"), k.cast("string")).alias("source_id"), html.alias("html"))
    return reference.shipping_policies(p)


@query("read_sources", """SELECT 'shop-' || CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name, CASE WHEN s_nationkey % 5 = 0 THEN 'FR' ELSE 'DE' END AS country,
  'https://shop' || CAST(s_suppkey AS VARCHAR) || '.example' AS base_url, 1 AS priority FROM supplier""")
def read_sources(spark, d):
    path = work_folder(spark, "sources")
    sources(spark, d).select("source_id", "name", "country", "base_url", F.lit(1).alias("priority")).write.csv(path, sep="|")
    return reference.read_sources(spark, path)


@query("read_fx_rates", "SELECT currency, count(*) AS n, max(rate) AS best FROM (" + op.plain("""SELECT CASE o_orderkey % 2 WHEN 0 THEN 'CHF' ELSE 'GBP' END AS currency,
  CAST(o_orderdate AS DATE) AS rate_date, min(CASE o_orderkey % 2 WHEN 0 THEN 1.0 ELSE 1.1 END + CAST(o_custkey % 7 AS DOUBLE) / 64) AS rate FROM {orders} GROUP BY 1, 2""") + ") GROUP BY 1")
def read_fx_rates(spark, d):
    from .views import fx_rates
    path = work_folder(spark, "rates")
    fx_rates(spark, d).select("rate_date", "currency", "rate").write.csv(path, header=True)
    return reference.read_fx_rates(spark, path).groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("best"))
