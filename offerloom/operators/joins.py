"""Enrichment and merge joins (J1-J14) and key-based set operations."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.money import same_price
from ..functions.scoring import has_evidence
from ..storage import stored
from .ranking import first_per_key, top_per_group

SALTS = 16


def broadcastable(table: DataFrame) -> bool:
    """Catalyst's size of `table` is below its broadcast threshold."""
    most = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def lookup_join(facts: DataFrame, table: DataFrame, on, spread, how: str = "left") -> DataFrame:
    """Join many rows to a table with one row per key.

    No size is assumed: a table that Catalyst holds for small enough is joined as it is, so that
    it is broadcast once and not once per salt. Otherwise both sides shuffle, and a key that holds
    a large part of all rows would land in one task; so the rows of every key are spread over
    SALTS reducers by a hash of the `spread` columns (stable when a task is repeated) and the
    table rows are repeated per salt."""
    on = [on] if isinstance(on, str) else list(on)
    spread = [spread] if isinstance(spread, str) else list(spread)
    if broadcastable(table):
        return facts.join(table, on, how)
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, on + ["_salt"], how).drop("_salt")


# ---- U1-U5 ------------------------------------------------------------------
def union_all(*dfs: DataFrame) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(dfs, keys) -> DataFrame:
    """Every key once."""
    return union_all(*[d.select(*keys) for d in dfs]).distinct()


def semi_by_key(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Rows of `a` whose key is in `b`. `b` is reduced to its distinct keys first, so
    repeated keys do not travel; a hot key of `a` is split by AQE (left side of a semi join)."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def anti_by_key(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Rows of `a` whose key is not in `b`."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


except_by_key = anti_by_key


def replace_by_key(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """U4: rows of `b`, and those of `a` with another key."""
    return union_all(anti_by_key(a, b, keys), b)


# ---- J1-J5 --------------------------------------------------------------------
def enrich_source_brand(offers: DataFrame, source_brands: DataFrame) -> DataFrame:
    """Offers of a single-brand source inherit its brand (source_id, store_brand)."""
    joined = lookup_join(offers, source_brands.select("source_id", "store_brand"), "source_id", "url")
    return joined.withColumn("brand", F.coalesce(tx.or_null(F.col("brand")), "store_brand")).drop("store_brand")


def latest_rates(rates: DataFrame, day=None) -> DataFrame:
    """Newest positive rate per currency, on or before `day` when one is given."""
    valid = rates.where((F.col("rate") > 0) & ~F.isnan("rate"))
    if day is not None:
        valid = valid.where(F.col("rate_date") <= F.lit(day))
    return valid.groupBy(F.upper("currency").alias("currency")).agg(F.max_by("rate", "rate_date").alias("rate"))


def rates_as_of(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """J2 with history: for each distinct (currency, rate_date) pair the latest rate on or
    before it. Pairs and rates are few per currency, so one ordered pass carries rates forward."""
    from pyspark.sql import Window
    asked = pairs.select(F.upper("currency").alias("currency"), "rate_date").distinct()
    known = rates.where((F.col("rate") > 0) & ~F.isnan("rate")).groupBy(
        F.upper("currency").alias("currency"), "rate_date").agg(F.max("rate").alias("rate"))
    both = asked.join(known, ["currency", "rate_date"], "full_outer")
    carry = Window.partitionBy("currency").orderBy("rate_date").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rate", F.last("rate", ignorenulls=True).over(carry)).join(
        asked, ["currency", "rate_date"], "left_semi")


def to_eur(offers: DataFrame, rates: DataFrame | None, day_col: str | None = None) -> DataFrame:
    """Adds `eur_rate`; EUR is 1, a currency without a usable rate stays NULL."""
    code = F.upper(F.col("currency"))
    if rates is None:
        return offers.withColumn("eur_rate", F.when(code == "EUR", F.lit(1.0)))
    if day_col is None:
        table, keys = latest_rates(rates), ["_code"]
        if not broadcastable(table):  # a row per currency, sized by the rates it comes from: the offers would be shuffled for it
            table = stored(table, "rates")
        rows = offers.withColumn("_code", code)
        table = table.select(F.col("currency").alias("_code"), "rate")
    else:
        rows = offers.withColumn("_code", code).withColumn("_day", F.col(day_col))
        asked = rows.select(F.col("_code").alias("currency"), F.col("_day").alias("rate_date"))
        table = rates_as_of(asked, rates).select(
            F.col("currency").alias("_code"), F.col("rate_date").alias("_day"), "rate")
        keys = ["_code", "_day"]
    out = lookup_join(rows, table, keys, "url")
    return out.withColumn("eur_rate", F.when(code == "EUR", F.lit(1.0)).otherwise(F.col("rate"))).drop(*keys, "rate")


def apply_shipping(offers: DataFrame, policies: DataFrame) -> DataFrame:
    """(source_id, fee, free_from, free_returns) fills only what an offer does not state."""
    table = policies.select("source_id", "fee", "free_from", "free_returns")
    joined = lookup_join(offers, table, "source_id", "url")
    applies = (F.col("currency") == "EUR") & F.col("price").isNotNull() & F.col("fee").isNotNull()
    fee = F.when(F.col("price") >= F.col("free_from"), F.lit(0.0)).otherwise(F.col("fee"))
    return (joined
            .withColumn("shipping", F.coalesce("shipping", F.when(applies, fee)))
            .withColumn("return_cost", F.coalesce(
                "return_cost", F.when(applies & F.col("free_returns"), F.lit(0.0))))
            .drop("fee", "free_from", "free_returns"))


_OUT = "out.of.stock"


def merge_snapshot(direct: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Direct rows win and take over the snapshot's checks at the same price; snapshot
    offers with an unseen address are added. `origin` is direct, enriched or added."""
    checks = ["price", "sizes", "size_availability", "rrp", "rrp_source", "availability"]
    given = snapshot.where(tx.blank(F.col("url")) != "")
    # one aggregation of the snapshot holds both what an offer takes over and what is added
    per_url = given.groupBy("source_id", "url").agg(
        F.max_by(F.struct(*checks), "seq").alias("s"), F.min_by(F.struct(*given.columns), "seq").alias("first"))
    j = direct.withColumn("_here", F.lit(True)).join(per_url, ["source_id", "url"], "full")
    s, here = F.col("s"), F.col("_here").isNotNull()
    at_price = F.coalesce(same_price(s["price"], F.col("price")), F.lit(False))
    sizes_new = at_price & F.coalesce(
        (s["size_availability"] == "available") & (F.size(s["sizes"]) > 0)
        & (F.coalesce(F.col("size_availability"), F.lit("")) != "available"), F.lit(False))
    rrp_new = at_price & F.coalesce(
        (s["rrp_source"] != "") & (tx.blank(F.col("rrp_source")) == "") & (s["rrp"] > F.col("price")), F.lit(False))
    out_new = at_price & F.lower(tx.blank(s["availability"])).rlike(_OUT) & ~F.lower(
        tx.blank(F.col("availability"))).rlike(_OUT)
    j = tx.computed(j, {"_sizes": sizes_new, "_rrp": rrp_new, "_out": out_new})
    taken = {"sizes": ("_sizes", s["sizes"]), "size_availability": ("_sizes", F.lit("available")), "rrp": ("_rrp", s["rrp"]),
             "rrp_source": ("_rrp", s["rrp_source"]), "availability": ("_out", s["availability"])}

    def column(name):
        own = F.col(name) if name in direct.columns else F.lit(None)
        if name in taken:
            own = F.when(F.col(taken[name][0]), taken[name][1]).otherwise(own)
        if name in ("source_id", "url"):  # the join's own columns hold either side
            return F.col(name)
        return F.when(here, own).otherwise(F.col("first")[name] if name in given.columns else F.lit(None)).alias(name)
    names = [*direct.columns, *[n for n in given.columns if n not in direct.columns]]
    origin = F.when(~here, F.lit("added")).when(F.col("_sizes") | F.col("_rrp") | F.col("_out"), F.lit("enriched")).otherwise(F.lit("direct"))
    return j.select(*[column(n) for n in names if n != "origin"], origin.alias("origin"))


def snapshot_counters(merged: DataFrame) -> DataFrame:
    """J4 counters per source."""
    return merged.groupBy("source_id").agg(
        F.count_if(F.col("origin") == "added").alias("added"),
        F.count_if(F.col("origin") == "enriched").alias("enriched"),
        F.count(F.lit(1)).alias("parsed_offers"))


def without_hidden(offers: DataFrame, hidden: DataFrame) -> DataFrame:
    """Offers whose hide_key was not hidden."""
    return anti_by_key(offers, hidden, ["hide_key"])


# ---- J6-J8 -----------------------------------------------------------------------
def merge_detail(offers: DataFrame, variants: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Product-page variants (source_id, page_url, seq and raw columns) confirm stock, sizes and a
    reference for listing offers. Work is done once per distinct (source, url, words of the name,
    price) and joined back; `details` finds what belongs together inside an address."""
    from . import details as de
    key = ["source_id", "url", "_words", "_price"]
    offers = offers.withColumns({"_words": de.word_set(F.col("name")), "_price": F.coalesce("price", F.lit(-1.0))})
    asked = offers.select(*key).distinct().withColumnRenamed("_words", "words")

    def variants_of(rows):
        return rows.select("source_id", F.col("page_url").alias("url"), F.col("name").alias("v_name"), F.col("price").alias("v_price"), "sizes",
                           "size_availability", "availability", F.col("rrp").alias("v_rrp"), F.col("rrp_source").alias("v_src"), F.col("seq").alias("v_seq"))
    found = de.found_details(asked, variants_of(variants), need_name=False).withColumnRenamed("words", "_words").select(
        *key, F.col("sold").alias("d_sold"), F.col("sizes").alias("d_sizes"), F.col("ref").alias("d_ref"))
    out = offers.join(found, key, "left")
    if cards is not None:
        fallback = de.found_details(asked, variants_of(cards), need_name=True).withColumnRenamed("words", "_words").select(*key, F.col("ref").alias("c_ref"))
        out = out.join(fallback, key, "left").withColumn("d_ref", F.coalesce("d_ref", "c_ref")).drop("c_ref")
    sold_out = F.coalesce(F.col("d_sold"), F.lit(False))
    sizes = F.transform(F.coalesce(F.col("d_sizes"), F.array()), lambda x: x["size"])
    take_sizes = ~sold_out & (F.size(sizes) > 0) & (F.coalesce(F.size("sizes"), F.lit(0)) <= 0)
    proven = has_evidence(F.col("rrp") - 1, F.col("rrp"), F.col("rrp_source"),
                          F.col("observed_discount_pct"), F.col("discount_source"))
    take_ref = ~sold_out & ~proven & F.col("d_ref").isNotNull()
    out = out.withColumns({"_sold": sold_out, "_take_sizes": take_sizes, "_take_ref": take_ref, "_new": sizes})
    return out.withColumns({
        "availability": F.when(F.col("_sold"), F.lit("out_of_stock")).otherwise(F.col("availability")),
        "sizes": F.when(F.col("_take_sizes"), F.col("_new")).otherwise(F.col("sizes")),
        "size_availability": F.when(F.col("_take_sizes"), F.lit("available")).otherwise(F.col("size_availability")),
        "rrp": F.when(F.col("_take_ref"), F.col("d_ref.rrp")).otherwise(F.col("rrp")),
        "rrp_source": F.when(F.col("_take_ref"), F.concat(F.lit("detail:"), F.col("d_ref.src")))
        .otherwise(F.col("rrp_source"))}).drop(
            "_sold", "_take_sizes", "_take_ref", "_new", "d_sold", "d_sizes", "d_ref", "_words", "_price")


def discount_checks(offers: DataFrame, limit: int | None = None) -> DataFrame:
    """L4: per source the offers with a strong badge, the `limit` strongest where it is given."""
    strong = offers.where(tx.is_eligible(F.col("name"), F.col("description"))
                          & (tx.blank(F.col("discount_source")) != "")
                          & (F.col("observed_discount_pct") >= fv.MIN_DISCOUNT_PCT))
    return top_per_group(strong, ["source_id"], [F.desc("observed_discount_pct"), F.asc("seq")], limit)


def validate_discount_on_detail(offers: DataFrame, variants: DataFrame,
                                limit: int | None = None) -> DataFrame:
    """J7, inside a source: page variants at exactly the listing price replace the listing row and
    inherit its badge when they carry no reference of their own."""
    asked = discount_checks(offers, limit).select(
        "source_id", F.col("url").alias("page_url"), F.col("price").alias("_price"),
        F.col("observed_discount_pct").alias("_pct"), F.col("discount_source").alias("_src"))
    hit = variants.join(asked, ["source_id", "page_url"]).where(same_price(F.col("price"), F.col("_price"), "exact"))
    bare = tx.blank(F.col("rrp_source")) == ""
    detail = hit.withColumns({
        "observed_discount_pct": F.when(bare, F.col("_pct")).otherwise(F.col("observed_discount_pct")),
        "discount_source": F.when(bare, F.col("_src")).otherwise(F.col("discount_source"))}).drop(
            "_price", "_pct", "_src", "page_url")
    by_url = lambda d: d.withColumn("_url", F.lower("url"))
    return replace_by_key(by_url(offers), by_url(detail), ["source_id", "_url"]).drop("_url")


def merge_rendered_evidence(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """J8, per page: rendered evidence at the same price fills static rows without any, and
    rendered rows with an unseen address are added - only on pages where some rendered row
    carries evidence, or where there is no static row at all."""
    page = ["source_id", "page_url"]
    proven = (tx.blank(F.col("rrp_source")) != "") | (tx.blank(F.col("discount_source")) != "")
    usable = union_distinct([rendered.where(proven), anti_by_key(rendered, static, page)], page)
    shown = semi_by_key(rendered, usable, page)
    cols = ["rrp", "rrp_source", "observed_discount_pct", "discount_source"]
    last = shown.groupBy(*page, "url").agg(F.max_by(F.struct("price", *cols), "seq").alias("d"))
    j = static.join(last, [*page, "url"], "left")
    d = F.col("d")
    take = ~proven & F.coalesce(
        same_price(d["price"], F.col("price"), "exact")
        & ((tx.blank(d["rrp_source"]) != "") | (tx.blank(d["discount_source"]) != "")), F.lit(False))
    j = j.withColumn("_take", take)
    filled = j.withColumns({c: F.when(F.col("_take"), d[c]).otherwise(F.col(c)) for c in cols}).drop("d", "_take")
    return union_all(filled, anti_by_key(shown, static, [*page, "url"]))


# ---- J11-J12 -------------------------------------------------------------------------
def match_brand_join(offers: DataFrame, brands: DataFrame) -> DataFrame:
    """F12 for brand lists too long for an expression. `brands` has (brand, ord). Every
    distinct (brand, name) pair is split into word n-grams of the lengths that brands have, which
    meet the brand words in an equi join; the exact rule decides, the lowest `ord` wins."""
    def term(c):
        return F.trim(tx.fold(c))

    def words(c):
        return F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")
    dim = brands.withColumn("term", term(F.col("brand"))).select(
        F.col("brand").alias("known"), "ord", "term", F.array_join(words(F.col("term")), " ").alias("gram"))
    pairs = offers.select("brand", "name").distinct().withColumns(
        {"_b": term(F.col("brand")), "_t": term(F.col("name"))})
    most = dim.agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 1  # one number of the brand table
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1))),
        lambda i: F.array_join(F.slice("_w", i, n), " "))))
    by_title = (pairs.withColumn("_w", words(F.col("_t"))).withColumn("gram", F.explode(F.array_distinct(grams)))
                .join(dim, "gram")
                .where(F.expr("rlike(_t, concat('(?:^|[^a-z0-9])\\\\Q', term, '\\\\E(?=$|[^a-z0-9])'))"))
                .groupBy("brand", "name").agg(F.min_by("known", "ord").alias("title_brand")))
    by_field = dim.groupBy(F.col("term").alias("_b")).agg(F.min_by("known", "ord").alias("field_brand"))
    found = (pairs.select("brand", "name", "_b").join(by_field, "_b", "left").join(
        by_title.withColumnsRenamed({"brand": "_brand", "name": "_name"}),
        F.col("brand").eqNullSafe(F.col("_brand")) & F.col("name").eqNullSafe(F.col("_name")), "left")
        .select(F.coalesce("brand", F.lit("\u0000")).alias("_kb"), F.coalesce("name", F.lit("\u0000")).alias("_kn"),
                F.coalesce("field_brand", "title_brand", F.lit("")).alias("matched_brand")))
    keyed = offers.withColumns({"_kb": F.coalesce("brand", F.lit("\u0000")),
                                "_kn": F.coalesce("name", F.lit("\u0000"))})
    return keyed.join(found, ["_kb", "_kn"], "left").drop("_kb", "_kn")


def expected_batches(sources: DataFrame, index_col: str, size: int = fv.BATCH_SIZE) -> DataFrame:
    """How many sources each batch must report."""
    return sources.groupBy(F.floor(F.col(index_col) / size).cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("source_count"))


def missing_batches(expected: DataFrame, batches: DataFrame) -> DataFrame:
    """Expected batches without a complete result."""
    return expected.join(batches.select("batch", "source_count").distinct(), ["batch", "source_count"], "left_anti")
