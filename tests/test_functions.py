import pytest
from pyspark.sql import functions as F

from offerloom.functions import money as mo
from offerloom.functions import scoring as sc
from offerloom.functions import sizes as sz
from offerloom.functions import text as tx
from offerloom.functions import urls as ur
from offerloom.settings import DEFAULT

c = F.col


def table(spark, rows, schema, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[v.alias(k) for k, v in cols.items()]).collect()]


SIZES = {
    "target": ["L", "large", "L reg", "L/kurz", "Taille: L", "L (52)", "L / EU 50", "W33 L30", "W34/L32", "w 34 l 32", "33/32", "34x30", "34-31",
               "34r", "33 SHORT", '34/32"', "Gr. L", "W34R"],
    "near": ["M/L", "L-XL", "W33", "US 34", "34", "EU 50", "D 52", "50", "52 (EU)", "k 25", "26 Kurz", "44 FR", "IT 52", "50 - Short"],
    "incompatible": ["xs", "M", "XXXL", "4XL", "S long", "L lang", "L tall", "W30 L32", "33/34", "W38/L34", "34 tall", "36S", "UK 30", "GER 56", "90", "118",
                     "Lang 98", "94 lang", "27 k", "FR 46", "48 IT", "44", "50 - Lang", "D 110", "24", "38"],
    "unknown": ["", "one size", "7", "25", "26", "43", "100.5", "XL - LONG (EU) x", "M - Long"],
}


def test_size_labels(spark):
    rows = [(label, expected) for expected, labels in SIZES.items() for label in labels]
    df = spark.createDataFrame(rows, "label string, expected string")
    wrong = df.withColumn("got", sz.normalize_size(c("label"))).where("got <> expected").collect()
    assert wrong == []


def test_french_sizes(spark):
    got = table(spark, [("44",), ("46",), ("50",), ("33",), ("60",)], "s string", x=sz.normalize_size(c("s"), "fr"))
    assert [g[0] for g in got] == ["near", "near", "incompatible", "near", "unknown"]


@pytest.mark.parametrize("sizes,expected", [
    (["S", "L"], "confirmed"), (["48", "50"], "probable"), (["M", "XL"], "no"), (["S", "one size"], "unconfirmed"),
    ([], "unconfirmed"), (None, "unconfirmed"), (["  "], "unconfirmed")])
def test_size_evidence(spark, sizes, expected):
    df = spark.createDataFrame([(sizes,)], "s array<string>")
    assert df.select(sz.size_evidence(c("s"))).first()[0] == expected


def test_size_ranges(spark):
    got = table(spark, [("Gr. M-2XL, 48 – 52",), ("XL bis M",), ("nichts",), (None,)], "t string", x=sz.expand_size_ranges(c("t")))
    assert [g[0] for g in got] == [["M", "L", "XL", "XXL", "48", "50", "52"], [], [], []]


NAMES = [
    ("Herren Wanderhose Alpha", "", True), ("Hiking Trousers Men", None, True), ("Trekking Pants", "für Kinder", False), ("Kletterhose", "", False),
    ("Softshellhose Damen", "", False), ("Pantalon Montagne homme", "", True), ("Dámské outdoor kalhoty", "", False), ("Pánské outdoor kalhoty", "", True),
    ("W´s Trail Pants", "", False), ("Winterhose", "", False), ("Stretch Pants zip off", "", False), ("Rucksack 30 L", "", False),
    ("Langlaufhose", "", False), ("Reisehose leicht", "auch als Shorts", True), (None, "", False)]


def test_eligibility(spark):
    df = spark.createDataFrame(NAMES, "n string, d string, e boolean")
    assert df.where(tx.is_eligible(c("n"), c("d")) != c("e")).collect() == []


def test_brand_matching(spark):
    rows = [("haglofs", "x", "Haglöfs"), (None, "Neu: Fjallraven Keb", "Fjällräven"), ("", "arc’teryx gamma", "Arc'teryx"), ("Other", "Crab trousers", ""),
            (None, "Rab und Mammut", "Mammut"), ("RAB", "Mammut", "Rab"), (None, "66° north pants", ""), (None, "66°North pants", "66°North")]
    df = spark.createDataFrame(rows, "b string, n string, e string")
    assert df.where(tx.match_brand(c("b"), c("n"), DEFAULT.brands) != c("e")).collect() == []


def test_folding(spark):
    got = table(spark, [("Klättermusen Ærlig Øst’s É",)], "t string", a=tx.fold(c("t")), b=tx.fold(c("t"), o_slash=False, ae=False))
    assert got == [("klattermusen aerlig ost's e", "klattermusen ærlig øst's e")]


def test_money(spark):
    got = table(spark, [("UVP 1.299,00 € jetzt 899,95 €",)], "t string", first=mo.parse_money(c("t")), card=mo.card_amounts(c("t")),
                ref=mo.labelled_reference(c("t")), euros=mo.euro_amounts(c("t")))
    assert got == [(1299.0, [1299.0, 899.95], 1299.0, [1299.0, 899.95])]
    got = table(spark, [("£12.50",), ("12,50 CHF",), ("12.50",), ("€1.234,50",)], "t string", v=mo.money_with_currency(c("t"))["value"],
                k=mo.money_with_currency(c("t"))["currency"])
    assert got == [(12.5, "GBP"), (12.5, "CHF"), (None, None), (1234.5, "EUR")]
    got = table(spark, [("1.299",), ("59,90 €",), ("x",), (None,)], "t string", us=mo.parse_money(c("t")), de=mo.parse_money(c("t"), locale="de"))
    assert got == [(1.299, 1299.0), (59.9, 59.9), (None, None), (None, None)]


def test_badges(spark):
    got = table(spark, [(["-20 %", "bis zu 55 %"],), (["90%"],), ([],)], "l array<string>", b=mo.badge_discount(c("l")))
    assert [g[0] and g[0]["pct"] for g in got] == [55, None, None]
    got = table(spark, [("bis -50 %",), ("up to 50%",), ("Rabatt 50 %",)], "t string", u=mo.is_up_to(c("t")))
    assert [g[0] for g in got] == [True, True, False]


def test_keys(spark):
    rows = [("s1", "https://S1.example/p/1/?utm_source=a&q=2&ref=b#x", "Mammut", "Herren Runbold Pants - Night Blue | L", "night blue"),
            ("s1", "kein Link", "Mammut", "Hose", None), ("s2", "https://s2.example/?aid=1&amp;", "Mammut", "MAMMUT Runbold Pants", None)]
    got = table(spark, rows, "s string, u string, b string, n string, k string", key=ur.offer_key(c("s"), c("u"), c("b"), c("n"), c("k")),
                model=ur.model_key(c("b"), c("n"), c("k"), F.lit("K")), hide=ur.hide_key(ur.model_key(c("b"), c("n"), c("k"), F.lit("K"))))
    assert got == [("s1|s1.example/p/1?q=2", "model|mammut|runbold pants", "model|mammut|runbold"),
                   ("s1|mammut|hose|", "url|K", "url|K"), ("s2|s2.example/", "model|mammut|runbold pants", "model|mammut|runbold")]


def test_url_score(spark):
    rows = [("https://a.example/mammut/hosen-alpha",), ("https://a.example/damen/hose",), ("https://a.example/outlet/",), ("https://a.example/x",),
            ("https://a.example/norr%C3%B8na/pants",)]
    assert [g[0] for g in table(spark, rows, "u string", s=ur.url_score(c("u"), DEFAULT.brands))] == [13, -11, -3, 0, 13]


def test_same_site(spark):
    rows = [("https://www.a.example/x", "https://a.example"), ("http://a.example", "https://a.example"), ("https://de.a.example", "https://a.example")]
    assert table(spark, rows, "a string, b string", x=ur.same_site(c("a"), c("b")), y=ur.same_site(c("a"), c("b"), "family")) == [
        (True, True), (False, True), (False, True)]


def test_score_rounds_half_up_and_tiers(spark):
    df = spark.createDataFrame([("confirmed", 80, 60.0, None, 50.0), ("no", 0, -10.0, 5.0, 50.0)], "s string, f int, d double, r double, k double")
    got = [tuple(r) for r in df.select(sc.deal_score(c("s"), c("f"), c("d"), c("r"), c("k")), sc.deal_tier(c("d"), c("f"))).collect()]
    # (30 + 20 + 13.5 + 7) / 0.8 = 88.125 and 6 / 0.8 = 7.5
    assert got == [(88, "Top Deal"), (8, "Near Miss")]


def test_fit(spark):
    rows = [("Trekking Pants", "stretch, leicht"), ("Alpine Pants heavyweight", ""), ("Travel Pants bib", ""), ("Hiking Trousers snow gaiter", "")]
    assert [g[0] for g in table(spark, rows, "n string, d string", f=tx.product_fit(c("n"), c("d")))] == [70, 0, 0, 40]


def test_diagnose_and_groups(spark):
    rows = [("blocked", 0, None, None, None, None, "blocked"), ("success", 0, None, None, None, None, "parser-empty"), ("success", 5, 0, 0, 0, 0, "no-relevant-products"),
            ("success", 5, 3, 0, 2, 0, "no-reference-price"), ("success", 5, 3, None, 0, 0, "no-reference-price"), ("partial", 5, 3, 2, 0, 0, "selection-filtered"),
            ("success", 5, 3, 2, 2, 0, "no-qualified-deal"), ("blocked", 5, 3, 2, 2, 1, None)]
    df = spark.createDataFrame(rows, "s string, p long, e long, v long, r long, q long, x string")
    got = sc.diagnose(c("s"), c("p"), c("e"), c("v"), c("r"), c("q"))
    assert df.where(~got.eqNullSafe(c("x"))).collect() == []


def test_overlapping_brands_in_a_title(spark):
    from pyspark.sql import functions as F

    from offerloom.functions import text as tx
    df = spark.createDataFrame([("a b c",), ("x a b",), ("ab c",)], "t string")
    got = [r[0] for r in df.select(tx.match_brand(F.lit(None).cast("string"), F.col("t"), ["b c", "a b"])).collect()]
    assert got == ["b c", "a b", ""]
