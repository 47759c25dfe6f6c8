"""Scores, tiers, evidence and diagnostic labels."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def truth(c) -> Column:
    """NULL means "not verified"."""
    return F.coalesce(c, F.lit(False))


def rrp_verified(price, rrp, rrp_source) -> Column:
    """a reference above the price whose provenance is known."""
    return truth((rrp > price) & (rrp_source != ""))


def discount_verified(pct, source, minimum: float = fv.MIN_DISCOUNT_PCT) -> Column:
    """an explicit merchant badge of at least `minimum` percent."""
    return truth((source != "") & ~F.isnan(pct) & (pct >= minimum))


def has_evidence(price, rrp, rrp_source, pct, source) -> Column:
    return rrp_verified(price, rrp, rrp_source) | discount_verified(pct, source)


def effective_discount(cost, price, rrp, badge) -> Column:
    """percent off including known shipping and return costs."""
    return F.when(rrp.isNotNull(), (1 - cost / rrp) * 100).otherwise((1 - (cost / price) * (1 - badge / 100)) * 100)


def nominal_discount(price, rrp, badge) -> Column:
    return F.when(rrp.isNotNull(), (1 - price / rrp) * 100).otherwise(badge)


def _clamp(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def deal_score(size_fit, fit, discount, return_cost, cost, market_price=None) -> Column:
    """F16: weighted 0-100 score; an unknown market price is left out of the weights."""
    w = fv.SCORE_WEIGHTS
    market_price = F.lit(None).cast("double") if market_price is None else market_price
    known = truth(market_price > 0)
    size = F.lit(0.0)
    for label, points in fv.SIZE_POINTS.items():
        size = F.when(size_fit == label, F.lit(float(points))).otherwise(size)
    merchant = (F.when(return_cost.isNull(), F.lit(float(fv.RETURN_POINTS_UNKNOWN)))
                .when(return_cost == 0, F.lit(float(fv.RETURN_POINTS_FREE)))
                .otherwise(F.lit(float(fv.RETURN_POINTS_PAID))))
    market = F.when(known, _clamp((market_price - cost) / market_price * 200)).otherwise(F.lit(0.0))
    total = (size * w["size"] + fit * w["fit"] + market * w["market"]
             + _clamp(discount * 1.5) * w["discount"] + merchant * w["merchant"])
    return F.floor(total / F.when(known, F.lit(1.0)).otherwise(F.lit(fv.UNKNOWN_MARKET_DIVISOR)) + 0.5)


def deal_tier(discount, fit) -> Column:
    """F17."""
    return (F.when((discount >= 55) & (fit >= 70), F.lit("Top Deal"))
            .when(discount >= 45, F.lit("Strong Deal"))
            .when(discount >= 40, F.lit("Good Deal"))
            .otherwise(F.lit("Near Miss")))


def implausible(discount) -> Column:
    return truth(discount > fv.IMPLAUSIBLE_PCT)


def up_to_unchecked(discount_source, verified, size_fit) -> Column:
    """An "up to" badge without a reference price and without a confirmed size."""
    return (truth(F.endswith(discount_source, F.lit("-upto"))) & ~truth(verified)
            & ~F.coalesce(size_fit.isin("confirmed", "probable"), F.lit(False)))


def near_reason(discount, discount_source, rrp_ok, badge_ok, size_fit, minimum) -> Column:
    """F33."""
    texts = fv.NEAR_REASONS
    return (F.when(implausible(discount), F.lit(texts["implausible"]))
            .when(up_to_unchecked(discount_source, rrp_ok, size_fit), F.lit(texts["up_to"]))
            .when(~truth(rrp_ok) & ~truth(badge_ok), F.lit(texts["no_evidence"]))
            .when(discount < minimum, F.lit(texts["below_minimum"]))
            .otherwise(F.lit(texts["check"])))


def _none(c) -> Column:
    return F.coalesce(c, F.lit(0)) == 0


def diagnose(status, parsed, eligible, evidence, priced, qualified) -> Column:
    """the first reason why a source yields no deal."""
    return (F.when((status == "blocked") & (parsed == 0), F.lit("blocked"))
            .when(parsed == 0, F.lit("parser-empty"))
            .when(_none(eligible), F.lit("no-relevant-products"))
            .when(_none(F.coalesce(evidence, priced)), F.lit("no-reference-price"))
            .when(_none(priced), F.lit("selection-filtered"))
            .when(_none(qualified), F.lit("no-qualified-deal")))


def coverage_group(status, parsed, eligible, qualified) -> Column:
    """F32: the bucket of a source in the report. A source with deals or eligible
    products but no parsed count is not expected; the first bucket that fits counts."""
    g = fv.COVERAGE_GROUPS
    return (F.when(~_none(qualified), F.lit(g["deals"]))
            .when(~_none(eligible), F.lit(g["eligible"]))
            .when(~_none(parsed), F.lit(g["products"]))
            .when(status == "blocked", F.lit(g["blocked"]))
            .otherwise(F.lit(g["empty"])))


def has_step(path, marker: str) -> Column:
    """a marker in the technical path of a source."""
    return F.coalesce(F.array_contains(path, marker), F.lit(False))


def run_date(ts) -> Column:
    """UTC date of a run (session time zone UTC)."""
    return F.to_date(ts)
