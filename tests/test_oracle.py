"""Registered queries against SQL on the smallest tables. OFFERLOOM_ALL=1 runs every query."""
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

SOME = ["select_deals", "best_per_model", "screen_offers", "rejection_histogram", "source_coverage", "merge_snapshot", "merge_detail", "to_eur_as_of", "apply_shipping",
        "price_change", "compare_sources", "jsonld_offers", "html_card_offers", "read_json_feed", "shopify_to_offers", "coverage_by_window", "rank_urls", "fold_documents",
        "card_rows_lateral", "sql_functions", "size_classes_by_table", "product_fit_by_table", "offer_lifetimes", "ordered_price_drops", "price_steps", "complete_report"]


def _names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql()) if os.environ.get("OFFERLOOM_ALL") else SOME


def _plain(v):
    if v is None or v != v:
        return None
    if type(v).__name__ in ("NAType", "NaTType"):
        return None
    if type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def _rows(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object)
    return sorted((tuple(_plain(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    from offerloom.checks.views import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    got, want = queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got = got.map(lambda v: _plain(v))
    want = want.map(lambda v: _plain(v))
    assert len(got) > 0 and _rows(got) == _rows(want)


def test_repeated_candidates(spark, con):
    from __spark_entry__ import oracle_sql, queries
    want = con.execute(oracle_sql()["validate_repeated_extractions"]).df()
    got = queries()["validate_repeated_extractions"](spark, SF).toPandas()
    assert _rows(got) == _rows(want)
    assert got.duplicated(["l_orderkey", "url"]).any() and len(got) > len(con.execute(oracle_sql()["validate_extractions"]).df())
