"""J6 inside an address: nothing is missed, and a full address does not form all pairs."""
import random

from pyspark.sql import functions as F

from helpers import raw
from offerloom.functions import text as tx
from offerloom.operators import details as de
from offerloom.operators import joins as jo

c = F.col


def test_similar_sets_equal_all_pairs(spark):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "hose", "herren", "pants", "runbold", "zion", "éclair"]
    names = sorted({" ".join(r.sample(words, r.randrange(0, 7))) for _ in range(120)})
    a = spark.createDataFrame([("s", r.choice("uv"), n) for n in names], "source_id string, url string, name string")
    b = spark.createDataFrame([("s", r.choice("uv"), n) for n in names], "source_id string, url string, name string")
    sets = [x.select("source_id", "url", de.word_set(c("name")).alias("words")).distinct() for x in (a, b)]
    got = {tuple(x) for x in de.similar_sets(*sets).collect()}
    pairs = sets[0].alias("a").join(sets[1].alias("b"), ["source_id", "url"]).where(tx.similar_name(c("a.words"), c("b.words")))
    assert got == {tuple(x) for x in pairs.select("source_id", "url", "a.words", "b.words").collect()} and len(got) > 300


def test_buckets_meet_every_price_of_the_band(spark):
    r = random.Random(2)
    prices = [round(10 ** r.uniform(-1, 3.5), 2) for _ in range(400)] + [24.99, 25.0, 25.5, 0.0, 24.5]
    df = spark.createDataFrame([(p, round(max(p + r.choice([-1, 1, 0, .5]) * max(p * 0.02, 0.5), 0.0), 2)) for p in prices for _ in range(3)], "a double, v double")
    from offerloom.functions.money import same_price
    missed = df.where(same_price(c("v"), c("a")) & ~F.array_contains(de._near_buckets(c("a")), de.price_bucket(c("v"))))
    assert missed.count() == 0
    assert df.select(F.max(F.size(de._near_buckets(c("a"))))).first()[0] <= 5


def _variants(spark, rows):
    return spark.createDataFrame(rows, "seq long, source_id string, page_url string, name string, price double, sizes array<string>, size_availability string, "
                                       "availability string, rrp double, rrp_source string")


def test_details_of_a_page(spark):
    offers = raw(spark, dict(name="Alpha Pants Men", price=100.0, sizes=[], rrp=None, rrp_source=None), dict(name="Beta Hose", price=50.0, sizes=[], rrp=None, rrp_source=None),
                 dict(name=None, price=None, sizes=[]), extra={"words": "string"})
    u = "https://s1.example/p/1"
    variants = _variants(spark, [
        (1, "s1", u, "Pants alpha", 101.0, ["M", "L", ""], "available", "in_stock", 150.0, "jsonld"), (2, "s1", u, "Alpha pants", 99.0, ["L"], "available", "OutOfStock", 90.0, "x"),
        (3, "s1", u, "Alpha pants men", 130.0, ["XL"], "available", "soldout", 300.0, "y"), (4, "s1", u, "Gamma hose herren lang", 50.0, None, "unknown", "SoldOut", None, None),
        (5, "s1", "https://s1.example/p/2", "Alpha pants", 100.0, ["S"], "available", "x", 500.0, "z")])
    got = {r.name: r for r in jo.merge_detail(offers, variants).collect()}
    a, b = got["Alpha Pants Men"], got["Beta Hose"]
    assert (a.availability, a.sizes, a.rrp, a.rrp_source) == ("in_stock", ["L", "M"], 150.0, "detail:jsonld")
    assert (b.availability, b.sizes, b.rrp) == ("in_stock", [], None)  # one word of two is not enough
    assert got[None].availability == "in_stock" and "words" in offers.columns and "words" in jo.merge_detail(offers, variants).columns
    nameless = _variants(spark, [(1, "s1", u, None, 50.2, ["M"], "available", "outofstock", 80.0, "j")])
    got = {r.name: r for r in jo.merge_detail(offers, nameless).collect()}
    assert all(r.availability == "out_of_stock" and r.sizes == [] for r in got.values())
    cards = _variants(spark, [(1, "s1", u, "Beta Hose", 50.0, None, None, None, 40.0, "card"), (2, "s1", u, None, 50.0, None, None, None, 90.0, "none")])
    got = {r.name: r for r in jo.merge_detail(offers, variants.limit(0), cards).collect()}
    assert (got["Beta Hose"].rrp, got["Beta Hose"].rrp_source) == (40.0, "detail:card") and got["Alpha Pants Men"].rrp is None


def test_a_full_address_forms_no_square(spark):
    n = 10_000
    asked = spark.range(n).select(F.lit("s").alias("source_id"), F.lit("u").alias("url"), F.concat(F.lit("hose model"), c("id").cast("string")).alias("words"), (c("id") % 300 + 20).cast("double").alias("_price"))
    offered = spark.range(n).select(
        F.lit("s").alias("source_id"), F.lit("u").alias("url"), F.concat(F.lit("Hose Model"), c("id").cast("string")).alias("v_name"), (c("id") % 300 + 20).cast("double").alias("v_price"),
        c("id").alias("v_seq"), F.array(F.lit("L")).alias("sizes"), F.lit("available").alias("size_availability"), F.lit("x").alias("availability"), F.lit(900.0).alias("v_rrp"), F.lit("s").alias("v_src"))
    sets = [asked.select("source_id", "url", "words"), offered.select("source_id", "url", de.word_set(c("v_name")).alias("words"))]
    assert de.similar_sets(*sets).count() == n
    found = de.found_details(asked, offered, need_name=False)
    assert found.count() == n and found.where("sizes[0].size = 'L' AND ref.rrp = 900").count() == n
    same = de.found_details(asked.withColumn("words", F.lit("hose model")), offered.withColumn("v_name", F.lit("Model Hose")), need_name=False)
    assert same.count() == n and same.distinct().count() == 300  # one set, 300 prices
