"""Amounts, currencies, reference prices and discount badges."""
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import EDGE, SPACE, any_of, blank, edges, let, squeeze

# An amount on a card: thousands groups or plain digits, optional decimals.
AMOUNT = r"(\d{1,3}(?:\.\d{3})+(?:,\d{2})?|\d+(?:[.,]\d{2})?)"
_NO_DIGIT_BEFORE = r"(?<![\d.,])"
_FIRST_NUMBER = rf"\d{{1,3}}(?:(?:\.|{SPACE})\d{{3}})+(?:,\d{{1,2}})?|\d+(?:[.,]\d{{1,2}})?"
_DE_FIRST = r"\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|\d+(?:,\d{1,2})?"
_CURRENCY = "€|EUR|CHF|£|GBP|Kč|CZK|zł|PLN"


def number(c, once=let) -> Column:
    """A plain decimal number, NULL for any other text."""
    return once(F.trim(c), lambda t: F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double")))


def positive(n: Column) -> Column:
    return F.when(n > 0, n)


def amount(c, once=let) -> Column:
    """A card amount: a comma makes dots thousands; dots alone only in groups of three. `c` is used
    several times: a value that was computed before, as `once` gives it."""
    return number(F.when(c.contains(","), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
                  .when(c.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.replace(c, F.lit("."), F.lit("")))
                  .otherwise(c), once)


def decimals(text) -> Column:
    """The text with a dot for decimals, where it may have thousands marks as well."""
    both = text.contains(",") & text.contains(".")
    return F.replace(F.when(both, F.replace(text, F.lit("."), F.lit(""))).otherwise(text), F.lit(","), F.lit("."))


def parse_money(c, style: str = "first_number", locale: str | None = None, once=let) -> Column:
    """F1. One function, one `style` per kind of source:

    first_number   first amount in markup text; with locale="de" a lone "1.299" is 1299
    decimal        text of a JSON feed with dot or comma decimals
    strip_dots     German feed text, every dot is a thousands mark
    feed_cents     like strip_dots, but zero and blank are the amount 0
    de_first       first amount in a German post
    plain          shop-API text
    strip_symbols  attribute text, everything but digits and separators removed
    first_amount   first card amount

    `once` computes a value for several uses.
    """
    text = blank(c)
    no_space = F.regexp_replace(text, f"{SPACE}|€", "")
    if style == "first_number":
        def read(t):
            grouped = t.contains(",") & t.contains(".")
            if locale == "de":
                grouped = grouped | t.rlike(r"^\d{1,3}(?:\.\d{3})+$")
            joined = F.replace(F.regexp_replace(t, rf"\.|{SPACE}", ""), F.lit(","), F.lit("."))
            return F.when(grouped, joined).otherwise(F.replace(t, F.lit(","), F.lit(".")))
        first = F.regexp_extract(F.regexp_replace(text, SPACE, " "), _FIRST_NUMBER, 0)
        return once(first, lambda t: once(number(read(t), once), positive))
    if style == "decimal":
        return once(no_space, lambda t: once(amount(t, once), positive))
    if style in ("strip_dots", "feed_cents"):
        n = F.replace(F.replace(no_space, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        if style == "feed_cents":
            return once(n, lambda t: F.when(t == "", F.lit(0.0)).otherwise(number(t, once)))
        return once(number(n, once), positive)
    if style == "de_first":
        return once(F.regexp_extract(text, _DE_FIRST, 0), lambda t: once(amount(t, once), positive))
    if style == "plain":
        return once(number(F.replace(text, F.lit(","), F.lit(".")), once), positive)
    if style == "strip_symbols":
        kept = F.regexp_replace(text, "[^0-9,.-]", "")
        return once(kept, lambda t: once(number(decimals(t), once), positive))
    if style == "first_amount":
        return once(F.regexp_extract(text, AMOUNT, 1), lambda t: amount(t, once))
    raise ValueError(f"unknown money style: {style}")


def _all(text, pattern) -> Column:
    return F.regexp_extract_all(blank(text), F.lit(pattern), F.lit(1))


def card_amounts(text) -> Column:
    """distinct plausible "N €" amounts of a listing card, in text order."""
    found = F.transform(_all(text, rf"{_NO_DIGIT_BEFORE}{AMOUNT}{SPACE}*€"), lambda t: amount(t))
    return F.array_distinct(F.filter(found, lambda n: (n > 5) & (n < 5000)))


def euro_amounts(text) -> Column:
    """all "N €" amounts, else all "€ N"; the two notations are never mixed."""
    def read(found):
        return F.filter(F.transform(found, lambda t: amount(t)), lambda n: n > 0)
    after = _all(text, rf"{_NO_DIGIT_BEFORE}{AMOUNT}{SPACE}*(?i:€|EUR)")
    before = _all(text, rf"(?i:€|EUR){SPACE}*{AMOUNT}")
    return let(after, lambda a: F.when(F.size(a) > 0, read(a)).otherwise(read(before)))


def card_values(text) -> Column:
    """All positive "N €" amounts of a product card, repeats kept."""
    found = _all(text, rf"{_NO_DIGIT_BEFORE}{AMOUNT}{SPACE}*(?i:€|EUR)")
    return F.filter(F.transform(found, lambda t: amount(t)), lambda n: n > 0)


def currency_code(token) -> Column:
    """F3."""
    table = F.create_map(*[F.lit(x) for kv in fv.CURRENCY_TOKENS.items() for x in kv])
    return F.try_element_at(table, F.upper(F.trim(token)))


_MONEY_BEFORE = rf"(?iu)({_CURRENCY}){SPACE}*(\d[\d.,\s\u00a0\u202f]*)"
_MONEY_AFTER = rf"(?iu)(\d[\d.,\s\u00a0\u202f]*)({_CURRENCY})"
_MONEY_ANY = (rf"(?iu)((?:{_CURRENCY}){SPACE}*\d[\d.,\s\u00a0\u202f]*|\d[\d.,\s\u00a0\u202f]*(?:{_CURRENCY}))")


def money_with_currency(evidence) -> Column:
    """F1 with_currency: struct(value, currency) of the first quoted amount, else NULL."""
    quote = F.regexp_extract(squeeze(evidence), _MONEY_ANY, 1)

    def parts(q, pattern, digits, token):
        return F.struct(F.regexp_replace(F.regexp_extract(q, pattern, digits), SPACE, "").alias("digits"),
                        F.regexp_extract(q, pattern, token).alias("token"))

    def read(q):
        split = F.when(q.rlike(rf"^{_MONEY_BEFORE}"), parts(q, _MONEY_BEFORE, 2, 1)).otherwise(parts(q, _MONEY_AFTER, 1, 2))
        return let(split, lambda p: let(
            F.struct(let(number(decimals(p["digits"])), positive).alias("value"), currency_code(p["token"]).alias("currency")),
            lambda m: F.when(m["value"].isNotNull() & m["currency"].isNotNull(), m)))
    return let(quote, read)


def money_mentions(text) -> Column:
    """How many amounts with a currency a text names."""
    return F.size(F.regexp_extract_all(blank(text), F.lit(_MONEY_ANY), F.lit(1)))


def money_claim_matches(value, currency, evidence) -> Column:
    """the quoted evidence, parsed again, equals the claim."""
    return F.coalesce(let(money_with_currency(evidence), lambda m: (
        (m["value"] == value) & (m["currency"] == F.upper(currency)))), F.lit(False))


_LABEL_WORDS = [x.replace(r"\b", "") for x in fv.REFERENCE_LABELS]
_LABELLED = (rf"{edges(any_of(fv.REFERENCE_LABELS))}{SPACE}*:?{SPACE}*(?:€|eur)?{SPACE}*{AMOUNT}")
_COMPARED = (rf"{EDGE}{any_of(fv.COMPARISON_LABELS)}{EDGE}{SPACE}*:?{SPACE}*(?:ab{SPACE}*)?{AMOUNT}"
             rf"{SPACE}*(?:€|eur)")


def labelled_reference(text, once=let) -> Column:
    """the amount directly after a reference-price label. The pattern is only tried on texts that
    hold one of the labels, and once. (`once` computes a value for several uses.)"""
    return once(F.lower(blank(text)), lambda low: F.when(
        reduce(or_, [low.contains(w) for w in _LABEL_WORDS]),
        once(F.regexp_extract(low, _LABELLED, 1), lambda t: once(amount(t, once), positive))))


def post_reference(text) -> Column:
    """F5 for posts: struct(value, source); a named comparison price wins."""
    def found(value, source):
        return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(source).alias("source"))))
    compared = let(F.regexp_extract(F.lower(blank(text)), _COMPARED, 1), lambda t: let(amount(t), positive))
    return F.coalesce(found(compared, "post:price-comparison"), found(labelled_reference(text), "post:labelled-reference-price"))


def badge_discount(labels) -> Column:
    """first label that names 40-80 %, as struct(pct, label)."""
    pct = F.transform(labels, lambda t: F.struct(
        F.regexp_extract(t, r"(\d{1,2})\s*%", 1).try_cast("int").alias("pct"), t.alias("label")))
    return F.get(F.filter(pct, lambda p: p["pct"].between(fv.BADGE_MIN_PCT, fv.BADGE_MAX_PCT)), F.lit(0))


def is_up_to(text) -> Column:
    """"bis 50 %" and its translations: the discount holds for some variants only."""
    return F.lower(blank(text)).rlike(edges(
        rf"\b{any_of(fv.UP_TO_WORDS)}\b[^%\d]{{0,6}}\d{{1,2}}\s*%"))


def same_price(a, b, tolerance: str = "band") -> Column:
    """within 2 % (at least 0.5) of b, or equal to the cent."""
    gap = F.abs(a - b)
    return gap <= F.greatest(b * 0.02, F.lit(0.5)) if tolerance == "band" else gap < 0.011


def resolve_card_price(values, struck, labelled, rule: str = "card") -> Column:
    """struct(price, rrp, from_struck). A reference is kept only above the price.

    rule="card": with a labelled reference the lowest other amount is the price, else the
    first amount. rule="rendered": always the lowest amount that is not the reference."""
    reference = F.coalesce(struck, labelled)

    def pick(vals):
        if rule == "rendered":
            rest = F.filter(vals, lambda v: reference.isNull() | (v != reference))
            return F.coalesce(F.array_min(rest), F.array_min(vals))
        rest = F.filter(vals, lambda v: F.abs(v - labelled) > 0.001)
        return F.coalesce(F.when(struck.isNull() & labelled.isNotNull(), F.array_min(rest)), F.get(vals, F.lit(0)))

    return let(pick(values), lambda price: F.struct(
        price.alias("price"), F.when(reference > price, reference).alias("rrp"),
        struck.isNotNull().alias("from_struck")))


def first_reference(candidates: Column, price) -> Column:
    """First struct(value, source) whose value is above the price, NULL if none."""
    return F.get(F.filter(candidates, lambda c: c["value"] > price), F.lit(0))
