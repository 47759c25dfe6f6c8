"""Reasoned filter, size trust, re-screening and gates."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import money as mo
from ..functions import scoring as sc
from ..functions import sizes as sz
from ..functions import text as tx
from ..settings import DEFAULT, Profile
from .joins import to_eur, without_hidden
from .ranking import with_keys


def screen_offers(raw: DataFrame, profile: Profile = DEFAULT, rates: DataFrame | None = None,
                  day_col: str | None = None) -> DataFrame:
    """Every raw row with the first failing rule in `reason` (NULL = accepted) and the
    normalized columns. Nothing is dropped. The costly steps are computed once per row and
    their results reused by the rules, by filters on `reason` and by the counters."""
    c = F.col
    d = tx.computed(raw, {"name": tx.strip_title_badge(c("name"))})
    d = tx.computed(d, {
        "_brand": tx.match_brand(c("brand"), c("name"), profile.brands),
        "eligible": (tx.blank(c("name")) != "") & tx.is_eligible(c("name"), c("description")),
        "rrp_verified": sc.rrp_verified(c("price"), c("rrp"), c("rrp_source")),
        "discount_verified": sc.discount_verified(c("observed_discount_pct"), c("discount_source"))})
    d = d.withColumn("price_evidence", c("eligible") & (c("rrp_verified") | c("discount_verified")))
    d = tx.computed(d, {"_early": F.coalesce(
        F.when(tx.blank(c("name")) == "", F.lit("name-missing")),
        F.when(c("_brand") == "", F.lit("brand-not-allowed")),
        F.when(tx.blank(c("currency")) == "", F.lit("currency-missing")),
        F.when(c("price").isNull() | F.isnan("price") | (c("price") <= 0), F.lit("price-missing")),
        F.when(~c("rrp_verified") & ~c("discount_verified"), F.lit("discount-unverified")),
        F.when(~c("eligible"), F.lit("product-mismatch")),
        F.when(tx.is_sold_out(c("availability")), F.lit("sold-out")),
        F.when(tx.colour_excluded(c("color"), profile.excluded_colours), F.lit("excluded-color")))})
    d = tx.computed(d, {"_size": F.when(c("_early").isNull(), sz.size_evidence(
        c("sizes"), sz.size_system(c("merchant_country")), profile))})
    d = to_eur(d, rates, day_col)
    d = d.withColumn("reason", F.coalesce(
        c("_early"), F.when(c("_size") == "no", F.lit("incompatible-size")),
        F.when(c("eur_rate").isNull(), F.lit("conversion-error"))))
    ok = c("reason").isNull()
    d = d.withColumns({
        "brand": F.coalesce(tx.or_null(c("_brand")), c("brand")),
        "rrp": F.when(c("rrp_verified"), c("rrp")),
        "size_fit": F.when(ok, F.when((c("_size") == "confirmed") & (tx.blank(c("size_availability")) != "available"),
                                      F.lit("unconfirmed")).otherwise(c("_size"))),
        "product_fit_score": F.when(ok, F.least(F.lit(100), tx.product_fit(
            c("name"), c("description"), c("eligible"), profile.excluded_terms)
            + tx.colour_bonus(c("color"), profile.preferred_colours))),
        "price_eur": F.when(ok, c("price") * c("eur_rate")),
        "shipping_known": c("shipping").isNotNull(),
        "shipping_eur": F.when(ok, F.coalesce(c("shipping") * c("eur_rate"), F.lit(0.0))),
        "return_cost_eur": F.when(ok, c("return_cost") * c("eur_rate"))})
    d = d.withColumns({
        "rrp_eur": F.when(ok, c("rrp") * c("eur_rate")),
        "effective_cost_eur": c("price_eur") + c("shipping_eur") + F.coalesce("return_cost_eur", F.lit(0.0))})
    d = d.withColumns({
        "nominal_discount_pct": F.when(ok, sc.nominal_discount(
            c("price_eur"), c("rrp_eur"), c("observed_discount_pct"))),
        "effective_discount_pct": F.when(ok, sc.effective_discount(
            c("effective_cost_eur"), c("price_eur"), c("rrp_eur"), c("observed_discount_pct")))})
    d = d.withColumns({
        "score": F.when(ok, sc.deal_score(c("size_fit"), c("product_fit_score"), c("effective_discount_pct"),
                                          c("return_cost_eur"), c("effective_cost_eur"))),
        "class": F.when(ok, sc.deal_tier(c("effective_discount_pct"), c("product_fit_score")))})
    return d.drop("_brand", "_early", "_size", "eur_rate")


def accepted(screened: DataFrame) -> DataFrame:
    """The normalized offers of a screened table."""
    return screened.where(F.col("reason").isNull()).drop("reason")


def normalize_offers(raw: DataFrame, profile: Profile = DEFAULT, rates=None, day_col=None) -> DataFrame:
    return accepted(screen_offers(raw, profile, rates, day_col))


def downgrade_size_trust(offers: DataFrame) -> DataFrame:
    """A confirmed size without availability evidence is only unconfirmed."""
    weak = (F.col("size_fit") == "confirmed") & (tx.blank(F.col("size_availability")) != "available")
    return offers.withColumn("size_fit", F.when(weak, F.lit("unconfirmed")).otherwise(F.col("size_fit")))


def rescreen(offers: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Stored offers judged by the current product rules, without hidden models."""
    kept = offers.where(tx.is_eligible(F.col("name"), F.col("description")) & F.col("name").isNotNull())
    kept = kept if "hide_key" in kept.columns else with_keys(kept)
    return kept if hidden is None else without_hidden(kept, hidden)


def listing_gates(cards: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """P5: brand, product-word and price gate over card texts; adds brand and price."""
    gated = cards.where(tx.is_product_text(F.col("text"))).withColumns({
        "brand": tx.brand_contained(F.col("text"), profile.brands),
        "price": F.array_min(mo.card_amounts(F.col("text")))})
    return gated.where((F.col("brand") != "") & F.col("price").isNotNull())


def size_check_candidates(raw: DataFrame, minimum: float = fv.MIN_DISCOUNT_PCT) -> DataFrame:
    """Eligible offers with a strong claim but no size evidence."""
    c = F.col
    ref = F.when(sc.rrp_verified(c("price"), c("rrp"), c("rrp_source")), (1 - c("price") / c("rrp")) * 100)
    badge = F.when(tx.blank(c("discount_source")) != "", c("observed_discount_pct"))
    return raw.where((tx.blank(c("name")) != "") & tx.is_eligible(c("name"), c("description"))
                     & (tx.blank(c("size_availability")) != "available")
                     & (F.greatest(F.coalesce(ref, F.lit(0.0)), F.coalesce(badge, F.lit(0.0))) >= minimum))


def premium_only(df: DataFrame, brands) -> DataFrame:
    """P7."""
    return df.where(tx.is_premium(F.col("brand"), F.col("name"), brands))
