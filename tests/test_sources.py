import datetime as dt

from pyspark.sql import functions as F

from helpers import sources, values
from offerloom import schemas
from offerloom.sources import claims, feeds, links, page_parts, pages, reference, shop_apis

c = F.col
JSONLD = """<html><body><span class="Sale-Badge">-50 %</span><script type="application/ld+json">{"@type":"ProductGroup","brand":{"name":"Rab"},"hasVariant":[
 {"@type":"Product","name":"Torque Pants","color":"Black","offers":{"@type":"Offer","price":"80.00","url":"/p/1","size":"L","availability":"https://schema.org/InStock",
  "priceSpecification":[{"priceType":"https://schema.org/StrikethroughPrice","price":"120"}]}}]}</script>
 <script type="application/ld+json">{broken</script></body></html>"""
SINGLE = """<body><i class="discount">45%</i><script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"Alpha Hose","brand":"Odlo","rrp":50,
 "offers":{"@type":"AggregateOffer","offers":[{"price":60,"size":{"name":"46 (EU)"}},{"price":60,"size":{"name":"46 (EU)"}},{"lowPrice":"1.060,50","sku":"z"}]}}]}</script></body>"""
CARDS = """<div><article><a href="/a?x=1">Weg</a><h3>Alpha Hose</h3><span class="product-price">79,95 €</span><span data-price="79.95"></span><del>159,90 €</del></article>
 <article><a href="/b">Beta Hose</a><p>Wanderhose</p><p>UVP 150,00 €</p><p>99,95 €</p></article><article><a href="/c">Gamma</a> 60,00 € statt früher 90,00 €<em class="Rabatt-x">-44%</em> ausverkauft</article>
 <article><a href="/a?x=1">doppelt 1,00 €</a></article><article><a href="/d">Ohne Preis hier</a></article></div>"""


def page(spark, html, source="s1"):
    return spark.createDataFrame([(1, source, "https://s1.example/list/", html)], "page_id long, source_id string, url string, html string")


def test_jsonld(spark):
    r = pages.jsonld_offers(page(spark, JSONLD), sources(spark)).collect()
    assert [(x["url"], x["brand"], x["price"], x["rrp"], x["rrp_source"], x["sizes"], x["size_availability"], x["observed_discount_pct"]) for x in r] == [
        ("https://s1.example/p/1", "Rab", 80.0, 120.0, "offer.priceSpecification.strikethrough", ["L"], "available", None)]
    r = pages.jsonld_offers(page(spark, SINGLE), sources(spark)).orderBy("seq").collect()
    assert [(x["price"], x["rrp"], x["observed_discount_pct"], x["sizes"]) for x in r] == [(60.0, None, 45.0, ["46 (EU)"]), (1060.5, None, 45.0, [])]


def test_cards(spark):
    r = pages.html_card_offers(page(spark, CARDS), sources(spark)).orderBy("seq").collect()
    assert [(x["url"][-5:], x["name"], x["price"], x["rrp"], x["rrp_source"], x["observed_discount_pct"], x["availability"]) for x in r] == [
        ("a?x=1", "Alpha Hose", 79.95, 159.9, "html:marked-reference-price", None, "unknown"),
        ("ple/b", "Beta Hose", 99.95, 150.0, "html:labelled-reference-price", None, "unknown"),
        ("ple/c", "Gamma", 60.0, None, None, 44.0, "out_of_stock")]


def test_own_card_rules():
    rows = list(page_parts.card_rows('<li class="productData"><a href="/x">x</a><b class="productsTitle">T</b><i class="old">9 €</i></li>', "biwak"))
    assert rows[0][6] == "9 €" and rows[0][8] == "T"
    assert list(page_parts.card_rows('<li class="productData"><a href="/x">x</a></li>')) == []


def test_unclosed_markup_and_state():
    assert [r[1] for r in page_parts.link_rows('<ul><li><a href="/1">a<li><a href=/2>b</ul><a name=x>c</a>')] == ["/1", "/2"]
    assert page_parts.state_array('x elementsList: [{"a":"]\\"["}] y') == '[{"a":"]\\"["}]'
    assert page_parts.state_array("nothing") is None


def test_listing_links(spark):
    html = ('<li class="tile"><a href="/p/1?v=2">Mammut Runbold Hose</a><b>79,00 €</b><s>158,00 €</s><i class="badge">bis -50 %</i></li><li><a href="/p/2">Damen Hose Mammut</a>10,00 €</li>'
            '<li><a href="/p/1">Mammut Runbold Hose</a> 79,00 € 158,00 €</li>')
    r = pages.listing_link_offers(page(spark, html), sources(spark)).collect()
    assert [(x["url"], x["price"], x["rrp"], x["observed_discount_pct"], x["discount_source"]) for x in r] == [
        ("https://s1.example/p/1", 79.0, None, 50.0, "merchant:displayed-discount-upto")]


def parsed(spark, rows, schema):
    df = spark.createDataFrame([(i, "s1", r) for i, r in enumerate(rows)], "seq long, source_id string, js string")
    return df.select("seq", "source_id", F.from_json("js", schema).alias("p"), F.lit("https://s1.example").alias("origin"), F.lit("EUR").alias("currency"),
                     F.lit("Own").alias("store_brand"), F.create_map(F.lit("3"), F.lit("L")).alias("size_map"), F.lit(None).cast("string").alias("url_suffix"))


def test_shopify(spark):
    p = ('{"title":"T","handle":"h","options":[{"name":"Size"},{"name":"Color"}],"images":[{"src":"i"}],"variants":[{"price":"90","compare_at_price":"200","option1":"2","option2":"Red"},'
         '{"price":"80","compare_at_price":"100","available":true,"option1":"3"},{"price":"10","available":false,"option1":"9"}]}')
    r = shop_apis.shopify_to_offers(parsed(spark, [p, p, '{"title":"U","handle":"u","variants":[]}'], schemas.SHOPIFY_PRODUCT), sources(spark)).collect()
    assert [(x["url"], x["brand"], x["price"], x["rrp"], x["sizes"], x["size_availability"], x["image_url"]) for x in r] == [
        ("https://s1.example/products/h", "Own", 80.0, 100.0, ["2", "L (3)"], "available", "i")]


def test_woo_and_magento(spark):
    woo = ['{"name":"<b>T</b>","permalink":"https://s1.example/t","prices":{"price":"7995","regular_price":"15990","currency_code":"eur","currency_minor_unit":2},"attributes":[{"name":"Talla","terms":[{"name":"L"}]}]}',
           '{"name":"X","permalink":"https://s1.example/x","prices":{"price":"1","currency_code":"USD"}}']
    r = shop_apis.woocommerce_to_offers(parsed(spark, woo, schemas.WOO_PRODUCT), sources(spark)).collect()
    assert [(x["name"], x["price"], x["rrp"], x["sizes"], x["size_availability"]) for x in r] == [("T", 79.95, 159.9, ["L"], None)]
    agg = spark.createDataFrame([(0, "s1", '[{"attribute_code":"brand","options":[{"label":" Rab ","value":"7"}]}]')], "seq long, source_id string, a string").select(
        "seq", "source_id", F.from_json("a", schemas.MAGENTO_AGGREGATIONS).alias("aggregations"))
    item = ('{"name":"T","url_key":"k","manufacturer":7,"price_range":{"minimum_price":{"final_price":{"value":50,"currency":"EUR"},"regular_price":{"value":90,"currency":"EUR"}}},'
            '"configurable_options":[{"attribute_code":"mp_size","label":"Maat"}],"variants":[{"attributes":[{"code":"mp_size","label":"L"}],"product":{"stock_status":"IN_STOCK"}},'
            '{"attributes":[{"code":"mp_size","label":"M"}],"product":{"stock_status":"OUT_OF_STOCK"}}]}')
    r = shop_apis.magento_to_offers(parsed(spark, [item], schemas.MAGENTO_ITEM), sources(spark), shop_apis.magento_brand_labels(agg)).collect()
    assert [(x["url"], x["brand"], x["price"], x["rrp"], x["sizes"]) for x in r] == [("https://s1.example/k.html", "Rab", 50.0, 90.0, ["L"])]


def test_json_feed_roots_and_cap(spark):
    row = '{"%s":"https://s1.example/%d","title":"T","price":"59.9","listPrice":99}'
    bodies = ["[" + row % ("url", 1) + "]", '{"products":[' + row % ("link", 2) + "]}", '{"items":[' + row % ("url", 3) + ',{"url":"x"}]}', "{broken"]
    df = spark.createDataFrame([("s1", i, b) for i, b in enumerate(bodies)], "source_id string, seq long, body string")
    r = feeds.read_json_feed(df, sources(spark)).orderBy("seq").collect()
    assert [(x["url"][-1], x["price"], x["rrp"], x["rrp_source"]) for x in r] == [("1", 59.9, 99.0, None), ("2", 59.9, 99.0, None), ("3", 59.9, 99.0, None)]
    # a limit, where one is asked for, counts inside each document
    two = spark.createDataFrame([("s1", i, "[" + ",".join(row % ("url", 10 * i + k) for k in range(3)) + "]") for i in range(2)], df.schema)
    assert feeds.read_json_feed(two, sources(spark), limit=2).count() == 4 and feeds.read_json_feed(two, sources(spark)).count() == 6


def test_posts(spark, tmp_path):
    item = ('<item><title><![CDATA[%s]]></title><link>https://posts.example/%d</link><merchant name="M" price="%s"/><description><![CDATA[<p>Gr. S-L</p> %s]]></description>'
            '<pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>')
    (tmp_path / "f.xml").write_text("<rss><channel>" + item % ("12° - Alpha Hose", 1, "49,90 €", "PVG: 99,00 €") + item % ("Beta (abgelaufen)", 2, "5 €", "")
                                    + item % ("Gamma Hose", 3, "", "30,00 € war 90") + "</channel></rss>", encoding="utf-8")
    posts = feeds.read_rss_posts(spark, str(tmp_path / "f.xml"), "https://posts.example/")
    r = feeds.posts_to_offers(posts, sources(spark), "s1", "2024-01-05").orderBy("url").collect()
    assert [(x["name"], x["price"], x["rrp"], x["rrp_source"], x["merchant"], x["sizes"]) for x in r] == [
        ("Alpha Hose", 49.9, 99.0, "post:price-comparison", "M (via posts)", ["S", "M", "L"])]
    assert feeds.posts_to_offers(posts, sources(spark), "s1", "2024-02-05").count() == 0


def test_tsv(spark, tmp_path):
    cols = [f.name for f in schemas.TSV_FEED.fields]
    row = dict(zip(cols, ["Mammut", "Runbold Hose", "x", "Herren > Hosen", "Herren", "", "1.079,95", "https://s1.example/1#a", "L", "", "bald", "m1", "", "EUR"]))
    rows = [row, {**row, "Groesse": "M", "Lieferstatus": "Sofort lieferbar"}, {**row, "Groesse": "L"}, {**row, "Hersteller": "Stoic"}, {**row, "Bezeichnung": "Runbold Shorts"}]
    (tmp_path / "f.tsv").write_text("\n".join("\t".join(f'"{x}"' for x in r) for r in [cols, *[list(r.values()) for r in rows]]), encoding="utf-8")
    r = feeds.read_tsv_feed(spark, str(tmp_path / "f.tsv"), "s1", sources(spark)).collect()
    assert [(x["url"], x["price"], x["sizes"], x["availability"], x["shipping"]) for x in r] == [("https://s1.example/1", 1079.95, ["L", "M"], "in_stock", 0.0)]


def test_next_page(spark):
    rows = [(1, "https://a.example/l/", "https://a.example/l/2/", "next", 0), (2, "https://a.example/l/?p=1", "https://a.example/l/?p=2", "2", 0),
            (3, "https://a.example/l/", "https://b.example/l/2/", "next", 0), (4, "https://a.example/l/", "https://a.example/m/2/", "next", 0),
            (5, "https://a.example/l/5/", "https://a.example/l/6/", "next", 0), (6, "https://a.example/l/?p=2&c=1", "https://a.example/l/?p=3&c=2", "next", 0)]
    df = spark.createDataFrame(rows, "page_id long, page_url string, href string, label string, pos int")
    assert sorted(values(links.next_listing_pages(df, last=5), "page_id", "next_url")) == [(1, "https://a.example/l/2/"), (2, "https://a.example/l/?p=2")]


def test_claims(spark):
    text = "Alpha Hose jetzt 59,90 € statt 99,90 €"
    cand = spark.createDataFrame([("s1", "https://s1.example/l", f"https://s1.example/{i}", text) for i in range(4)], "source_id string, page_url string, url string, text string")
    base = dict(page_url="https://s1.example/l", url="", seq=0, name="Alpha Hose", name_evidence="Alpha Hose", brand="Rab", price=59.9, price_currency="EUR", price_evidence="jetzt 59,90 €",
                rrp=99.9, rrp_currency="EUR", rrp_evidence="statt 99,90 €")
    rows = [{**base, "url": "https://s1.example/0"}, {**base, "url": "https://s1.example/1", "price": 58.0}, {**base, "url": "https://s1.example/2", "price_evidence": "59,90 €"},
            {**base, "url": "https://evil.example/3"}]
    ext = spark.createDataFrame([tuple(r.values()) for r in rows], "page_url string, url string, seq long, name string, name_evidence string, brand string, price double, price_currency string, "
                                "price_evidence string, rrp double, rrp_currency string, rrp_evidence string")
    assert values(claims.validate_extractions(cand, ext, sources(spark)), "url", "brand", "price", "rrp") == [("https://s1.example/0", None, 59.9, 99.9)]


def test_policy_and_rates(spark, tmp_path):
    html = "<table><tr><td>Deutschland</td><td>4,95 €</td><td>Versandkostenfrei ab 50 €</td></tr></table>"
    df = spark.createDataFrame([("s1", html), ("s2", html.replace("50", "5")), ("s3", "<p>Versand je nach Land</p>")], "source_id string, html string")
    assert values(reference.shipping_policies(df), "source_id", "fee", "free_from", "free_returns") == [("s1", 4.95, 50.0, False)]
    (tmp_path / "r.csv").write_text("rate_date,currency,rate\n2024-01-01,CHF,1.05\n")
    assert values(reference.read_fx_rates(spark, str(tmp_path / "r.csv")), "rate_date", "rate") == [(dt.date(2024, 1, 1), 1.05)]
    (tmp_path / "s.csv").write_text("s1|Shop|DE|https://s1.example|1\n")
    assert values(reference.read_sources(spark, str(tmp_path / "s.csv")), "source_id", "priority") == [("s1", 1)]


def test_sql_functions(spark):
    from offerloom.functions import register_functions
    register_functions(spark)
    assert spark.sql("SELECT absolute_url('https://a.example/x/', concat('../', y)) FROM VALUES ('b') AS t(y)").first()[0] == "https://a.example/b"
    assert spark.sql("SELECT size(page_cards(h, 's')) FROM VALUES ('<article><a href=x>y</a></article>') AS t(h)").first()[0] == 1


def test_link_rows_grow_with_the_page():
    from offerloom.sources.page_parts import link_rows
    sizes = []
    for n in (400, 800, 1600):
        page = "<div class='products'>" + "".join(f"<a href='/p/{i}'>Hose {i} 99,95 €</a>" for i in range(n)) + "</div>"
        sizes.append(sum(len(str(r)) for r in link_rows(page)))
    assert sizes[2] < 4.4 * sizes[0]


def test_deep_json_costs_one_page_only():
    import json  # noqa: F401

    from offerloom.sources.page_parts import state_array, variant_rows
    deep = "[" * 100_000 + "]" * 100_000
    assert list(variant_rows([deep])) == [] and state_array("window.state = " + deep, "window.state") is None


def test_the_link_around_the_name_wins():
    from offerloom.sources.page_parts import card_rows
    page = ("<article><a href='/wishlist'>x</a><a href='/p/1'><div data-e2e-test='product-card-info-name-section'>Name</div></a>"
            "<span class='price'>9,95 €</span></article>")
    assert [r[1] for r in card_rows(page)] == ["/p/1"]
