"""The scalar rules as SQL functions: CREATE TEMPORARY FUNCTION ... RETURN an expression.

A body is the SQL text that Catalyst gives for the Column expression of the DataFrame API, so there
is one definition of each rule, and a call is expanded in place: no Python, no UDF, pushed down and
folded like any expression. Rules that need lambda functions have no such text; they stay Column
functions."""
from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import money as mo
from . import scoring as sc
from . import text as tx
from . import urls as ur

_TEXT = "STRING"


def _plain(value, use):
    """The value as often as it is used: SQL text has no name for it."""
    return use(value)


#: name -> (arguments, type of the result, rule)
FUNCTIONS = {
    "first_price": ({"t": _TEXT}, "DOUBLE", lambda t: mo.parse_money(t, once=_plain)),                                                    # F1
    "feed_price": ({"t": _TEXT}, "DOUBLE", lambda t: mo.parse_money(t, "decimal", once=_plain)),
    "german_price": ({"t": _TEXT}, "DOUBLE", lambda t: mo.parse_money(t, "strip_dots", once=_plain)),
    "post_price": ({"t": _TEXT}, "DOUBLE", lambda t: mo.parse_money(t, "de_first", once=_plain)),
    "shop_price": ({"t": _TEXT}, "DOUBLE", lambda t: mo.parse_money(t, "plain", once=_plain)),
    "attribute_price": ({"t": _TEXT}, "DOUBLE", lambda t: mo.parse_money(t, "strip_symbols", once=_plain)),
    "card_price": ({"t": _TEXT}, "DOUBLE", lambda t: mo.parse_money(t, "first_amount", once=_plain)),
    "currency_code": ({"t": _TEXT}, _TEXT, mo.currency_code),                                                                # F3
    "labelled_reference": ({"t": _TEXT}, "DOUBLE", lambda t: mo.labelled_reference(t, once=_plain)),                                                   # F5
    "is_up_to": ({"t": _TEXT}, "BOOLEAN", mo.is_up_to),                                                                      # F7
    "clean_text": ({"t": _TEXT}, _TEXT, tx.clean_text),                                                                      # F8
    "decode_entities": ({"t": _TEXT}, _TEXT, tx.decode_entities),
    "post_text": ({"t": _TEXT}, _TEXT, tx.post_text),
    "fold_text": ({"t": _TEXT}, _TEXT, lambda t: tx.fold(t)),                                                                # F10
    "is_eligible": ({"name": _TEXT, "description": _TEXT}, "BOOLEAN", tx.is_eligible),                                       # F11
    "is_relevant_category": ({"name": _TEXT, "category": _TEXT, "gender": _TEXT, "tags": _TEXT}, "BOOLEAN", tx.is_relevant_category),
    "is_product_text": ({"t": _TEXT}, "BOOLEAN", tx.is_product_text),
    "product_fit": ({"name": _TEXT, "description": _TEXT}, "INT", lambda n, d: tx.product_fit(n, d).cast("int")),            # F15
    "deal_score": ({"size_fit": _TEXT, "fit": "DOUBLE", "discount": "DOUBLE", "return_cost": "DOUBLE", "cost": "DOUBLE"}, "BIGINT",
                   lambda *a: sc.deal_score(*a)),                                                                            # F16
    "deal_tier": ({"discount": "DOUBLE", "fit": "DOUBLE"}, _TEXT, sc.deal_tier),                                             # F17
    "effective_discount": ({"cost": "DOUBLE", "price": "DOUBLE", "rrp": "DOUBLE", "badge": "DOUBLE"}, "DOUBLE", sc.effective_discount),  # F18
    "nominal_discount": ({"price": "DOUBLE", "rrp": "DOUBLE", "badge": "DOUBLE"}, "DOUBLE", sc.nominal_discount),
    "rrp_verified": ({"price": "DOUBLE", "rrp": "DOUBLE", "source": _TEXT}, "BOOLEAN", sc.rrp_verified),                     # F19
    "discount_verified": ({"pct": "DOUBLE", "source": _TEXT}, "BOOLEAN", lambda p, s: sc.discount_verified(p, s)),
    "canonical_url": ({"url": _TEXT}, _TEXT, lambda u: ur.canonical_url(u)),                                                 # F23
    "host_of": ({"url": _TEXT}, _TEXT, ur.host_of),                                                                          # F24
    "same_site": ({"a": _TEXT, "b": _TEXT}, "BOOLEAN", lambda a, b: ur.same_site(a, b)),
    "same_price": ({"a": "DOUBLE", "b": "DOUBLE"}, "BOOLEAN", lambda a, b: mo.same_price(a, b)),                             # F27
    "title_without_badge": ({"t": _TEXT}, _TEXT, tx.strip_title_badge),                                                      # F28
    "is_sold_out": ({"availability": _TEXT}, "BOOLEAN", tx.is_sold_out),                                                     # F29
    "colour_excluded": ({"colour": _TEXT}, "BOOLEAN", lambda x: tx.colour_excluded(x)),                                      # F30
    "colour_bonus": ({"colour": _TEXT}, "INT", lambda x: tx.colour_bonus(x).cast("int")),
    "diagnose": ({"status": _TEXT, "parsed": "BIGINT", "eligible": "BIGINT", "evidence": "BIGINT", "priced": "BIGINT", "qualified": "BIGINT"}, _TEXT,
                 sc.diagnose),                                                                                               # F31
    "coverage_group": ({"status": _TEXT, "parsed": "BIGINT", "eligible": "BIGINT", "qualified": "BIGINT"}, _TEXT, sc.coverage_group),  # F32
    "run_date": ({"ts": "TIMESTAMP"}, "DATE", sc.run_date),                                                                  # F34
    "has_step": ({"path": "ARRAY<STRING>", "marker": _TEXT}, "BOOLEAN", lambda p, m: F.coalesce(F.array_contains(p, m), F.lit(False))),  # F36
}


def body(spark: SparkSession, arguments: dict, rule: Column) -> str:
    """The SQL text of an expression over the arguments."""
    empty = spark.createDataFrame([], ", ".join(f"{k} {t}" for k, t in arguments.items()))
    plan = empty.select(rule.alias("result"))._jdf.queryExecution().analyzed()
    text = plan.expressions().head().child().sql()
    if "lambdafunction(" in text:
        raise ValueError("an expression with lambda functions has no SQL text")
    return text


def create_functions(spark: SparkSession, names=None) -> None:
    """Create the functions in this session, all of them or those named."""
    for name in names or FUNCTIONS:
        arguments, result, rule = FUNCTIONS[name]
        text = body(spark, arguments, rule(*[F.col(k) for k in arguments]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{k} {t}' for k, t in arguments.items())}) RETURNS {result} RETURN {text}")
