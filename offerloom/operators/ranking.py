"""Windows (W1-W5), top-k (L1-L6) and the deal selection."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import scoring as sc
from ..functions import text as tx
from ..functions import urls as ur
from ..settings import DEFAULT, Profile


def top_per_group(df: DataFrame, keys, order, n: int | None) -> DataFrame:
    """The first n rows per key, all rows where n is None. `row_number <= n` becomes a partial limit before the
    shuffle (WindowGroupLimit), so a hot key ships at most n rows per task."""
    if n is None:
        return df
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def cap_per_group(df: DataFrame, keys, seq, n: int | None) -> DataFrame:
    """The first n rows per key in their order; None caps nothing."""
    return top_per_group(df, keys, [F.asc(seq)], n)


def first_per_key(df: DataFrame, keys, seq) -> DataFrame:
    """W4."""
    return top_per_group(df, keys, [F.asc(seq)], 1)


def last_per_key(df: DataFrame, keys, seq) -> DataFrame:
    """W5."""
    return top_per_group(df, keys, [F.desc(seq)], 1)


def latest_snapshot(snapshots: DataFrame, now, hours: int = fv.SNAPSHOT_MAX_AGE_HOURS,
                    keys=("source_id",)) -> DataFrame:
    """Per source all rows of its newest fresh snapshot. The newest time is aggregated
    first, so only one small row per source is joined back."""
    alive = fresh(snapshots, "collected_at", now, F.expr(f"INTERVAL {hours} HOURS"))
    newest = alive.groupBy(*keys).agg(F.max("collected_at").alias("collected_at"))
    return alive.join(newest, [*keys, "collected_at"], "left_semi")


def fresh(df: DataFrame, ts: str, now, age: Column) -> DataFrame:
    """P4."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return df.where(F.col(ts) >= now - age)


def with_keys(offers: DataFrame) -> DataFrame:
    """Adds offer_key (F20), model_key (F21) and hide_key."""
    c = F.col
    d = tx.computed(offers, {"offer_key": ur.offer_key(c("source_id"), c("url"), c("brand"), c("name"), c("color"))})
    d = tx.computed(d, {"model_key": ur.model_key(c("brand"), c("name"), c("color"), c("offer_key"))})
    return tx.computed(d, {"hide_key": ur.hide_key(c("model_key"))})


def _keyed(offers: DataFrame) -> DataFrame:
    return offers if "model_key" in offers.columns else with_keys(offers)


def best_per_offer(offers: DataFrame, scope=()) -> DataFrame:
    """The best-evidenced row of every offer key; `first_seq` is the key's first row.

    An aggregation instead of a window: each task sends one row per key."""
    c = F.col
    proven = sc.truth(c("rrp_verified")) | sc.truth(c("discount_verified"))
    rows = _keyed(offers).where(~F.coalesce(c("size_fit") == "no", F.lit(False)))
    rows = rows.withColumn("class", F.when(proven, sc.deal_tier(
        c("effective_discount_pct"), F.coalesce(c("product_fit_score"), F.lit(0)))).otherwise(F.lit("Near Miss")))
    rank = (proven.cast("int") + sc.truth(c("shipping_known")).cast("int")
            + F.coalesce(c("size_fit") == "confirmed", F.lit(False)).cast("int"))
    order = F.struct((-rank).alias("a"), (-c("score")).alias("b"), c("effective_cost_eur").alias("c"),
                     c("seq").alias("d"))
    keys = [*scope, "offer_key"]
    payload = [x for x in rows.columns if x not in keys]
    return (rows.groupBy(*keys)
            .agg(F.min_by(F.struct(*payload), order).alias("r"), F.min("seq").alias("first_seq"))
            .select(*keys, "r.*", "first_seq"))


def qualifies(minimum: float) -> Column:
    """A published deal: evidence, tier, minimum discount and no doubtful number."""
    c = F.col
    return ((sc.truth(c("rrp_verified")) | sc.truth(c("discount_verified"))) & (c("class") != "Near Miss")
            & (c("effective_discount_pct") >= minimum)
            & ~sc.up_to_unchecked(c("discount_source"), c("rrp_verified"), c("size_fit"))
            & ~sc.implausible(c("effective_discount_pct")))


def best_per_model(best: DataFrame, minimum: float = fv.MIN_DISCOUNT_PCT, scope=()) -> DataFrame:
    """One row per model (within `scope`); `model_seq` is the model's first offer."""
    c = F.col
    keys = [*scope, "model_key"]
    rows = best.withColumn("qualifies", qualifies(minimum))
    order = F.struct((-c("qualifies").cast("int")).alias("a"), (-c("score")).alias("b"),
                     c("effective_cost_eur").alias("c"), c("first_seq").alias("d"))
    payload = [x for x in rows.columns if x not in keys]
    return (rows.groupBy(*keys)
            .agg(F.min_by(F.struct(*payload), order).alias("r"), F.min("first_seq").alias("model_seq"))
            .select(*keys, "r.*", "model_seq"))


def rank_models(offers: DataFrame, minimum: float = fv.MIN_DISCOUNT_PCT, scope=()) -> DataFrame:
    return best_per_model(best_per_offer(offers, scope), minimum, scope)


#: What a ranking reads of an offer beside its keys.
RANKED = ["source_id", "size_fit", "rrp_verified", "discount_verified", "discount_source", "effective_discount_pct",
          "product_fit_score", "shipping_known", "score", "effective_cost_eur", "seq"]


def ranked_only(offers: DataFrame, scope=(), more=()) -> DataFrame:
    """Offers with nothing but their keys, what ranks them and `more`: where models are only counted, or
    few columns of them are shown, the others need not travel through both aggregations."""
    keys = dict.fromkeys([*scope, *RANKED, "offer_key", "model_key", *more])
    return _keyed(offers).select(*keys)


def deals_of(ranked: DataFrame) -> DataFrame:
    """L1: every qualifying model, best score first."""
    return ranked.where("qualifies").orderBy(F.desc("score"), F.asc("model_seq"))


def near_of(ranked: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """L1: the best models that just missed, with the reason."""
    c = F.col
    near = ranked.where(~c("qualifies") & (c("effective_discount_pct") >= profile.near_min))
    return (near.withColumns({
        "class": F.lit("Near Miss"),
        "reason": sc.near_reason(c("effective_discount_pct"), c("discount_source"), c("rrp_verified"),
                                 c("discount_verified"), c("size_fit"), profile.min_discount)})
        .orderBy(F.desc("score"), F.asc("model_seq")).limit(profile.near_limit))


def select_deals(offers: DataFrame, profile: Profile = DEFAULT):
    """L1: (deals, near misses). Both read the same ranking; write or persist `rank_models`
    yourself when both are consumed."""
    ranked = rank_models(offers, profile.min_discount)
    return deals_of(ranked), near_of(ranked, profile)


def qualified_by_source(offers: DataFrame, minimum: float = fv.MIN_DISCOUNT_PCT) -> DataFrame:
    """Qualified models per source, each source judged on its own."""
    return rank_models(ranked_only(offers, ("source_id",)), minimum, ("source_id",)).groupBy("source_id").agg(
        F.count_if("qualifies").alias("qualified_offers"))


def rank_urls(urls: DataFrame, brands, limit: int | None = None) -> DataFrame:
    """L2: distinct addresses per source with their score; the `limit` most promising ones where
    it is given. Duplicates collapse in a partial aggregation before the ranking."""
    once = urls.groupBy("source_id", "url").agg(F.min("idx").alias("idx"))
    scored = once.withColumn("score", ur.url_score(F.col("url"), brands))
    return top_per_group(scored, ["source_id"], [F.desc("score"), F.asc("idx")], limit)


def detail_candidates(offers: DataFrame, brands, limit: int | None = None) -> DataFrame:
    """L3: which product pages to read first: deals without sizes, then offers without
    evidence, then the rest; every page once."""
    c = F.col
    proven = sc.has_evidence(c("rrp") - 1, c("rrp"), c("rrp_source"), c("observed_discount_pct"), c("discount_source"))
    sized = F.coalesce(F.size("sizes"), F.lit(0)) > 0
    wanted = ((tx.blank(c("url")) != "") & (tx.blank(c("name")) != "")
              & ~F.lower(tx.blank(c("availability"))).rlike("out.of.stock|sold.out|ausverkauft")
              & tx.is_eligible(c("name"), c("description")) & tx.is_premium(c("brand"), c("name"), brands))
    # computed: a plain filter would be pushed into the offers and build the name once per rule
    rows = tx.computed(offers, {"_wanted": wanted}).where("_wanted").drop("_wanted")
    rows = rows.withColumns({
        "priority": F.when(proven & ~sized, F.lit(1)).when(~proven, F.lit(2)).otherwise(F.lit(3)),
        "page_key": F.lower(F.regexp_replace(c("url"), "[?#].*$", ""))})
    once = top_per_group(rows, ["source_id", "page_key"], [F.asc("priority"), F.asc("seq")], 1)
    return once if limit is None else top_per_group(once, ["source_id"], [F.asc("priority"), F.asc("seq")], limit)


def latest(df: DataFrame, order_col: str, n: int, tie: str | None = None) -> DataFrame:
    """Newest n rows, missing times last (TakeOrdered, no full sort)."""
    order = [F.desc_nulls_last(order_col)] + ([F.desc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)
