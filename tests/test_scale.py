"""What must not grow faster than the rows: tasks that read a table, values that are computed again, columns that travel."""
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from offerloom.checks import views
from offerloom.functions import money as mo
from offerloom.functions import urls as ur
from offerloom.operators import aggregates as ag
from offerloom.operators import details as de
from offerloom.operators import ranking as rk
from offerloom.sources.page_index import Page

c = F.col


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("rule, most", [
    (lambda t: mo.post_reference(t)["value"], 2), (lambda t: mo.money_with_currency(t)["value"], 5),
    (lambda t: mo.euro_amounts(t), 2), (lambda t: mo.parse_money(t, "decimal"), 0)])
def test_patterns_are_tried_once(spark, rule, most):
    plan = _plan(spark.createDataFrame([], "t string").select(rule(c("t")).alias("x")))
    assert plan.count("regexp_extract") <= most
    assert plan.count("regexp_replace") <= 4


def test_amounts_of_odd_texts(spark):
    rows = spark.createDataFrame([("PVG: 1.299,90 € statt 1.499,00 €", "€ 1.299,90"), ("UVP 99 €", "12,50 CHF"), ("", ""), (None, None), ("PVG: € x", "0 €")], "t string, m string")
    out = rows.select(mo.post_reference(c("t")).alias("r"), mo.money_with_currency(c("m")).alias("m"), mo.parse_money(c("m"), "decimal").alias("d"),
                      mo.parse_money(c("m"), "strip_symbols").alias("s"), mo.parse_money(c("m"), "feed_cents").alias("f")).collect()
    assert [tuple(x["r"]) if x["r"] else None for x in out] == [(1299.9, "post:price-comparison"), (99.0, "post:labelled-reference-price"), None, None, None]
    assert [tuple(x["m"]) if x["m"] else None for x in out] == [(1299.9, "EUR"), (12.5, "CHF"), None, None, None]
    assert [x["d"] for x in out] == [1299.9, None, None, None, None]
    assert [x["s"] for x in out] == [1299.9, 12.5, None, None, None]
    assert [x["f"] for x in out] == [1299.9, None, 0.0, 0.0, 0.0]


def test_a_table_of_one_file_is_dealt(spark, tmp_path):
    path = f"{tmp_path}/lineitem.parquet"
    spark.range(5000).select(c("id").alias("l_orderkey")).coalesce(1).write.parquet(path)
    out = views.shared(spark, str(tmp_path), "SELECT l_orderkey FROM {lineitem}")
    sizes = [n for n in out.rdd.glom().map(len).collect()]
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(sizes) <= 2 * 5000 / len(sizes) and sum(sizes) == 5000
    fine = spark.range(0, 5000, 1, 64)
    assert views.dealt(fine) is fine


def test_plain_addresses_are_not_parsed(monkeypatch):
    bases = ["https://www.Shop1.example/a/b?c=1#d", "http://x.example"]
    plain = ["/p/1?x=1", "/", "/a%20b/c.html", "https://y.example/p/2?u=v", "http://y.example"]
    odd = ["/a/../b", "//y.example/z", "/p#top", "?x=1", "p/2", "/a/./b", "/a?", "mailto:x", "/a;b", "https://y.example#x"]
    for b in [*bases, "https://h:80/p", "", None]:
        for h in plain + odd:
            out = urljoin(b or "", h)
            assert ur.resolve(b, h) == (out if out.startswith("http") else ""), (b, h)

    def fail(*_):
        raise AssertionError("parsed")
    monkeypatch.setattr(ur, "urljoin", fail)
    assert [ur.resolve(bases[0], h) for h in plain[:2]] == ["https://www.Shop1.example/p/1?x=1", "https://www.Shop1.example/"]


def test_attributes_are_read_once_per_text():
    page = Page('<a class="x" href="/1">a</a><a class="x" href="/1">b</a>' + f'<a title="{"t" * 300}">c</a>')
    assert page.attributes[0] is page.attributes[1] and page.attributes[0] == {"class": "x", "href": "/1"}
    assert page.attributes[2] == {"title": "t" * 300}


_OFFER = ("source_id string, arm string, url string, brand string, name string, color string, description string, reason string, eligible boolean, price_evidence boolean, "
          "rrp_verified boolean, discount_verified boolean, discount_source string, size_fit string, product_fit_score int, shipping_known boolean, "
          "effective_cost_eur double, effective_discount_pct double, score long, class string, seq long, price double")


def test_counted_rankings_are_narrow(spark):
    rows = spark.createDataFrame([
        ("s", "a", "https://s.example/1", "Rab", "Rab Torque Pants", "Blue", "d", None, True, True, True, False, None, "confirmed", 80, True, 50.0, 60.0, 70, "Top Deal", 1, 50.0),
        ("s", "a", "https://s.example/1", "Rab", "Rab Torque Pants", "Blue", "d", None, True, True, True, False, None, "confirmed", 80, True, 50.0, 60.0, 60, "Top Deal", 2, 50.0),
        ("s", "b", "https://s.example/2", "Rab", "x", None, None, "product-mismatch", False, False, True, False, None, None, None, True, None, None, None, None, 3, 9.0)], _OFFER)
    got = rk.qualified_by_source(rows.where("reason IS NULL"))
    assert [tuple(x) for x in got.collect()] == [("s", 1)]
    arms = ag.arm_metrics(rows)
    assert {(x["arm"], x["source_id"]): (x["raw_offers"], x["unique_urls"], x["qualified_offers"]) for x in arms.collect()} == {
        ("a", "s"): (2, 1, 1), ("a", None): (2, 1, 1), ("b", "s"): (1, 1, 0), ("b", None): (1, 1, 0)}
    for df in (got, arms):
        for line in _plan(df).splitlines():
            assert not ("min_by" in line and "description" in line)


def test_sets_of_an_address_are_dealt_once(spark):
    asked = spark.createDataFrame([("s", "u", "blue hose keb"), ("s", "v", "grey hose"), (None, "w", "a hose")], "source_id string, url string, words string")
    offered = spark.createDataFrame([("s", "u", "blue hose"), ("s", "u", "red jacke"), ("s", "x", "grey hose"), (None, "w", "a hose")], "source_id string, url string, words string")
    met = de.similar_sets(asked, offered)
    assert [tuple(x) for x in met.collect()] == [("s", "u", "blue hose keb", "blue hose")]
    plan = _plan(met)
    # each of the four readings joins to no count of its words any more
    assert plan.count("Join Inner") == 2
