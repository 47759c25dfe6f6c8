"""Declared schemas. Foreign JSON is read with these, never inferred."""
from pyspark.sql import types as T

_s, _d, _l, _b, _i = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.IntegerType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


SOURCES = struct(source_id=_s, name=_s, country=_s, base_url=_s, priority=_i)

RAW_OFFERS = struct(
    seq=_l, source_id=_s, merchant=_s, merchant_country=_s, url=_s, image_url=_s, brand=_s,
    name=_s, color=_s, sizes=T.ArrayType(_s), currency=_s, price=_d, rrp=_d, rrp_source=_s,
    observed_discount_pct=_d, discount_source=_s, shipping=_d, return_cost=_d,
    size_availability=_s, availability=_s, description=_s)

RAW_COLUMNS = [f.name for f in RAW_OFFERS.fields]

COVERAGE = struct(
    source_id=_s, name=_s, status=_s, discovered_urls=_l, parsed_offers=_l, eligible_offers=_l,
    price_evidence_offers=_l, priced_offers=_l, verified_reference_offers=_l,
    available_size_offers=_l, qualified_offers=_l, elapsed_ms=_l,
    rejection_reasons=T.MapType(_s, _l), technical_path=T.ArrayType(_s),
    http_statuses=T.ArrayType(_i), diagnostic_code=_s, note=_s)

FX_RATES = struct(rate_date=T.DateType(), currency=_s, rate=_d)

# Product feeds in JSON: numbers may come as text, so prices are read as text.
FEED_ROW = struct(
    url=_s, link=_s, image=_s, imageUrl=_s, brand=_s, name=_s, title=_s, color=_s,
    sizes=T.ArrayType(_s), currency=_s, price=_s, rrp=_s, msrp=_s, listPrice=_s, shipping=_s,
    availability=_s, description=_s)

SHOPIFY_PRODUCT = struct(
    title=_s, handle=_s, vendor=_s, product_type=_s, body_html=_s,
    options=T.ArrayType(struct(name=_s, position=_i)),
    variants=T.ArrayType(struct(title=_s, price=_s, compare_at_price=_s, available=_b,
                                option1=_s, option2=_s, option3=_s)),
    images=T.ArrayType(struct(src=_s)))

WOO_PRODUCT = struct(
    name=_s, permalink=_s, short_description=_s, is_in_stock=_b, on_sale=_b,
    prices=struct(price=_s, regular_price=_s, currency_code=_s, currency_minor_unit=_i),
    images=T.ArrayType(struct(src=_s)),
    attributes=T.ArrayType(struct(name=_s, terms=T.ArrayType(struct(name=_s)))),
    brands=T.ArrayType(struct(name=_s)))

_money = struct(value=_d, currency=_s)
MAGENTO_ITEM = struct(
    name=_s, url_key=_s, url_suffix=_s, stock_status=_s, manufacturer=_s,
    small_image=struct(url=_s),
    price_range=struct(minimum_price=struct(regular_price=_money, final_price=_money)),
    configurable_options=T.ArrayType(struct(
        attribute_code=_s, label=_s, values=T.ArrayType(struct(label=_s, value_index=_l)))),
    variants=T.ArrayType(struct(
        attributes=T.ArrayType(struct(code=_s, label=_s, value_index=_l)),
        product=struct(stock_status=_s))))

MAGENTO_AGGREGATIONS = T.ArrayType(struct(
    attribute_code=_s, options=T.ArrayType(struct(label=_s, value=_s))))

TSV_FEED = struct(**{c: _s for c in [
    "Hersteller", "Bezeichnung", "Beschreibung", "Kategorie", "Geschlecht", "Stichworte", "VK",
    "Partnerlink", "Groesse", "Versandkosten", "Lieferstatus", "Modellnr", "Bild-url", "Währung"]})

STATE_ELEMENT = struct(
    id=_s, productId=_s, name=_s, description=_s, brand=struct(name=_s),
    price=struct(current=_s, old=_s, previous=_s, priceForSchemaOrgOffer=_s),
    images=T.ArrayType(struct(src=_s)))
STATE_ELEMENTS = T.ArrayType(T.StructType(
    [T.StructField("data", STATE_ELEMENT)] + STATE_ELEMENT.fields))
