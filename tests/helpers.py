"""Small builders for test rows."""
from pyspark.sql import functions as F

from offerloom.schemas import RAW_OFFERS

RAW = dict(seq=0, source_id="s1", merchant="Shop", merchant_country="DE", url="https://s1.example/p/1", image_url=None, brand="Mammut",
           name="Runbold Trekking Pants", color=None, sizes=["L"], currency="EUR", price=50.0, rrp=100.0, rrp_source="feed:rrp",
           observed_discount_pct=None, discount_source=None, shipping=None, return_cost=None, size_availability="available",
           availability="in_stock", description="")


def raw(spark, *rows, extra=None):
    data = [{**RAW, "seq": i, **r} for i, r in enumerate(rows)]
    names = [f.name for f in RAW_OFFERS.fields]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in data], RAW_OFFERS)
    for name, kind in (extra or {}).items():
        keyed = spark.createDataFrame([(r["seq"], r.get(name)) for r in data], f"seq long, {name} {kind}")
        df = df.join(keyed, "seq")
    return df


OFFER = dict(seq=0, source_id="s1", url="https://s1.example/p/1", brand="Mammut", name="Runbold Alpha Pants", color=None, size_fit="confirmed",
             product_fit_score=80, score=80, effective_discount_pct=60.0, effective_cost_eur=50.0, rrp_verified=True, discount_verified=False,
             discount_source=None, shipping_known=True, description="")
OFFER_SCHEMA = ("seq long, source_id string, url string, brand string, name string, color string, size_fit string, product_fit_score int, score long, "
                "effective_discount_pct double, effective_cost_eur double, rrp_verified boolean, discount_verified boolean, discount_source string, "
                "shipping_known boolean, description string")


def normalized(spark, *rows):
    data = [{**OFFER, "seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[k] for k in OFFER) for r in data], OFFER_SCHEMA)


def sources(spark, *rows):
    rows = rows or [("s1", "Shop", "DE", "https://s1.example", 1), ("s2", "Boutique", "FR", "https://s2.example", 2)]
    return spark.createDataFrame(list(rows), "source_id string, name string, country string, base_url string, priority int")


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, column, **named):
    """Value of a column expression over one row of text columns."""
    df = spark.createDataFrame([tuple(named.values())], ", ".join(f"{k} string" for k in named)) if named else spark.range(1)
    return df.select(F.expr(column) if isinstance(column, str) else column).first()[0]
