"""Screening, keys, selection, joins, coverage and reports over the offer view."""
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import scoring as sc
from ..functions import sizes as sz
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import aggregates as ag
from ..operators import history as hi
from ..operators import joins as jo
from ..operators import normalize as no
from ..operators import ranking as rk
from ..settings import DEFAULT
from ..storage import stored
from . import oracle_parts as op
from .registry import query
from .views import POLICIES_SQL, SEQ, fx_rates, raw_offers, shared, table

c = F.col
BR = list(DEFAULT.brands)


def screened(spark, d):
    return no.screen_offers(raw_offers(spark, d), rates=fx_rates(spark, d))


def offers(spark, d):
    return no.accepted(screened(spark, d))


def keyed(spark, d):
    return rk.with_keys(offers(spark, d))


def hidden_models(spark, d):
    """Every offer of every seventh part hides its model."""
    return keyed(spark, d).where(c("l_partkey") % 7 == 0).select("hide_key").distinct()


HIDDEN_CTE = "hidden AS (SELECT DISTINCT hide_key FROM keyed WHERE l_partkey % 7 = 0)"

# ---- selection (W1, W2, L1) ------------------------------------------------------
_PICK = "source_id, offer_key, model_key, class, score, effective_discount_pct, effective_cost_eur, l_orderkey, l_linenumber"
_PICK_COLS = [x.strip() for x in _PICK.split(",")]


@query("select_deals", f"{op.MODELS} SELECT {_PICK} FROM models WHERE qualifies")
def select_deals(spark, d):
    return rk.deals_of(rk.rank_models(offers(spark, d))).select(*_PICK_COLS)


_NEAR = op.quote(fv.NEAR_REASONS["implausible"])


@query("near_misses", f"""{op.MODELS} SELECT source_id, offer_key, model_key, 'Near Miss' AS class, score, effective_discount_pct,
  CASE WHEN effective_discount_pct > 85 THEN {op.quote(fv.NEAR_REASONS['implausible'])}
    WHEN coalesce(ends_with(discount_source, '-upto'), false) AND NOT rrp_verified AND size_fit NOT IN ('confirmed', 'probable') THEN {op.quote(fv.NEAR_REASONS['up_to'])}
    WHEN NOT rrp_verified AND NOT discount_verified THEN {op.quote(fv.NEAR_REASONS['no_evidence'])}
    WHEN effective_discount_pct < 40 THEN {op.quote(fv.NEAR_REASONS['below_minimum'])} ELSE {op.quote(fv.NEAR_REASONS['check'])} END AS reason
  FROM models WHERE NOT qualifies AND effective_discount_pct >= 30 ORDER BY score DESC, model_seq LIMIT 12""")
def near_misses(spark, d):
    return rk.near_of(rk.rank_models(rk.ranked_only(offers(spark, d)))).select(
        "source_id", "offer_key", "model_key", "class", "score", "effective_discount_pct", "reason")


@query("best_per_offer", f"{op.BEST} SELECT offer_key, class, score, effective_cost_eur, l_orderkey, l_linenumber, l_partkey, first_seq.l_orderkey AS first_order FROM best".replace("first_seq.l_orderkey", "first_seq[1]"))
def best_per_offer(spark, d):
    return rk.best_per_offer(offers(spark, d)).select(
        "offer_key", "class", "score", "effective_cost_eur", "l_orderkey", "l_linenumber", "l_partkey",
        c("first_seq.l_orderkey").alias("first_order"))


@query("best_per_model", f"{op.MODELS} SELECT model_key, offer_key, qualifies, score, effective_cost_eur FROM models")
def best_per_model(spark, d):
    return rk.rank_models(offers(spark, d)).select("model_key", "offer_key", "qualifies", "score", "effective_cost_eur")


@query("qualified_by_source", f"""{op.BEST}, {op.model_ctes(scope='source_id')}
  SELECT source_id, count(*) FILTER (qualifies) AS qualified_offers FROM models GROUP BY source_id""")
def qualified_by_source(spark, d):
    return rk.qualified_by_source(offers(spark, d))


# ---- screening (P1-P7) ------------------------------------------------------------
_NORM = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, brand, name, reason, eligible, rrp_verified, discount_verified, size_fit, "
         "product_fit_score, price_eur, rrp_eur, shipping_eur, return_cost_eur, effective_cost_eur, nominal_discount_pct, "
         "effective_discount_pct, score, class")


@query("screen_offers", f"{op.SCREEN} SELECT {_NORM} FROM (SELECT * REPLACE (CAST(product_fit_score AS DOUBLE) AS product_fit_score, CAST(score AS DOUBLE) AS score) FROM screened)")
def screen_offers(spark, d):
    """Nullable whole numbers are compared as doubles."""
    d = screened(spark, d).withColumns({x: c(x).cast("double") for x in ("product_fit_score", "score")})
    return d.select(*[x.strip() for x in _NORM.split(",")])


@query("normalize_offers", f"{op.SCREEN} SELECT source_id, url, brand, score, class, effective_discount_pct FROM offers")
def normalize_offers(spark, d):
    return offers(spark, d).select("source_id", "url", "brand", "score", "class", "effective_discount_pct")


@query("downgrade_size_trust", f"""WITH {op.RAW_CTE}, e AS (SELECT *, list_transform(sizes, lambda x: {op.SIZE_CLASS}) AS sc FROM raw),
  f AS (SELECT *, {op.EVIDENCE} AS size_fit FROM e)
  SELECT source_id, CASE WHEN size_fit = 'confirmed' AND size_availability <> 'available' THEN 'unconfirmed' ELSE size_fit END AS size_fit,
    count(*) AS n FROM f GROUP BY 1, 2""")
def downgrade_size_trust(spark, d):
    raw = raw_offers(spark, d)
    fit = raw.withColumn("size_fit", sz.size_evidence(c("sizes"), sz.size_system(c("merchant_country"))))
    return no.downgrade_size_trust(fit).groupBy("source_id", "size_fit").agg(F.count(F.lit(1)).alias("n"))


@query("rescreen_offers", f"{op.KEYED}, {HIDDEN_CTE} SELECT source_id, offer_key, hide_key, score FROM keyed WHERE {op.eligible('name', 'description')} AND hide_key NOT IN (SELECT hide_key FROM hidden)")
def rescreen_offers(spark, d):
    return no.rescreen(keyed(spark, d), hidden_models(spark, d)).select("source_id", "offer_key", "hide_key", "score")


@query("fresh_events", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 HOUR")
def fresh_events(spark, d):
    ev = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    now = ev.agg(F.max("ts")).first()[0]
    return rk.fresh(ev, "ts", now, F.expr("INTERVAL 30 HOURS")).select("event_id", "user_id")


@query("size_check_candidates", f"""WITH {op.RAW_CTE} SELECT source_id, url, price FROM raw WHERE coalesce(name, '') <> '' AND {op.eligible('name', 'description')}
  AND size_availability <> 'available' AND greatest(coalesce(CASE WHEN rrp > price AND rrp_source IS NOT NULL THEN (1 - price / rrp) * 100 END, 0),
    coalesce(CASE WHEN discount_source IS NOT NULL THEN observed_discount_pct END, 0)) >= 40""")
def size_check_candidates(spark, d):
    return no.size_check_candidates(raw_offers(spark, d)).select("source_id", "url", "price")


def _premium(text):
    return "(" + " OR ".join(f"contains({text}, {op.quote(op.fold_word(b).replace('ae', 'ae'))})" for b in fv.BRANDS) + ")"


_FOLD_TEXT = op.fold("coalesce(brand, '') || ' ' || coalesce(name, '')")


@query("premium_offers", f"WITH {op.RAW_CTE} SELECT source_id, brand, count(*) AS n FROM raw WHERE {_premium(_FOLD_TEXT)} GROUP BY 1, 2")
def premium_offers(spark, d):
    return no.premium_only(raw_offers(spark, d), BR).groupBy("source_id", "brand").agg(F.count(F.lit(1)).alias("n"))


# ---- functions on the view -----------------------------------------------------------
@query("match_brand", f"WITH {op.RAW_CTE} SELECT brand AS raw_brand, {op.BRAND} AS matched_brand, count(*) AS n FROM raw GROUP BY 1, 2")
def match_brand(spark, d):
    return raw_offers(spark, d).select(c("brand").alias("raw_brand"), tx.match_brand(c("brand"), c("name"), BR).alias(
        "matched_brand")).groupBy("raw_brand", "matched_brand").agg(F.count(F.lit(1)).alias("n"))


@query("match_brand_join", f"WITH {op.RAW_CTE} SELECT brand AS raw_brand, {op.BRAND} AS matched_brand, count(*) AS n FROM raw GROUP BY 1, 2")
def match_brand_join(spark, d):
    brands = spark.createDataFrame([(b, i) for i, b in enumerate(BR)], "brand string, ord int")
    return jo.match_brand_join(raw_offers(spark, d), brands).groupBy(
        c("brand").alias("raw_brand"), "matched_brand").agg(F.count(F.lit(1)).alias("n"))


@query("size_classes", f"""WITH {op.RAW_CTE}, x AS (SELECT merchant_country, unnest(sizes) AS x FROM raw)
  SELECT x AS size, merchant_country, {op.SIZE_CLASS} AS size_class, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def size_classes(spark, d):
    raw = raw_offers(spark, d).select("merchant_country", F.explode("sizes").alias("size"))
    per_label = raw.groupBy("size", "merchant_country").agg(F.count(F.lit(1)).alias("n"))
    return per_label.select("size", "merchant_country", sz.normalize_size(
        c("size"), sz.size_system(c("merchant_country"))).alias("size_class"), "n")


@query("size_evidence", f"""WITH {op.RAW_CTE}, e AS (SELECT *, list_transform(sizes, lambda x: {op.SIZE_CLASS}) AS sc FROM raw)
  SELECT merchant_country, {op.EVIDENCE} AS evidence, count(*) AS n FROM e GROUP BY 1, 2""")
def size_evidence(spark, d):
    return raw_offers(spark, d).select("merchant_country", sz.size_evidence(c("sizes"), sz.size_system(
        c("merchant_country"))).alias("evidence")).groupBy("merchant_country", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query("product_fit", f"""WITH {op.RAW_CTE}, e AS (SELECT *, {op.eligible('name', 'description')} AS eligible FROM raw WHERE name IS NOT NULL)
  SELECT name, description, max({op.FIT}) AS fit, bool_or(eligible) AS eligible FROM e GROUP BY 1, 2""")
def product_fit(spark, d):
    names = raw_offers(spark, d).where(c("name").isNotNull()).select("name", "description").distinct()
    return names.withColumns({"fit": tx.product_fit(c("name"), c("description")),
                              "eligible": tx.is_eligible(c("name"), c("description"))})


@query("offer_and_model_keys", f"WITH {op.RAW_CTE}, {op.key_ctes('raw')} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, offer_key, model_key, hide_key FROM keyed")
def offer_and_model_keys(spark, d):
    return rk.with_keys(raw_offers(spark, d)).select(*SEQ, "offer_key", "model_key", "hide_key")


@query("name_similarity", f"""WITH {op.RAW_CTE}, n AS (SELECT DISTINCT name, p_name || ' ' || color AS other FROM raw WHERE name IS NOT NULL),
  w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array({op.fold('name')}, '[^a-z0-9]+'), lambda x: length(x) > 2)) AS a,
    list_distinct(list_filter(regexp_split_to_array({op.fold('other')}, '[^a-z0-9]+'), lambda x: length(x) > 2)) AS b FROM n)
  SELECT name, other, CAST(len(list_intersect(a, b)) AS DOUBLE) / least(len(a), len(b)) AS similarity FROM w""")
def name_similarity(spark, d):
    pairs = raw_offers(spark, d).where(c("name").isNotNull()).select(
        "name", F.concat_ws(" ", "p_name", "color").alias("other")).distinct()
    return pairs.withColumn("similarity", tx.name_similarity(c("name"), c("other")))


# ---- joins -------------------------------------------------------------------------------
@query("enrich_source_brand", f"""WITH {op.RAW_CTE}, b AS (SELECT 'shop-' || CAST(s_suppkey AS VARCHAR) AS source_id, 'Mammut' AS store_brand FROM supplier WHERE s_suppkey % 4 = 0)
  SELECT source_id, coalesce(nullif(brand, ''), store_brand) AS brand, count(*) AS n FROM raw LEFT JOIN b USING (source_id) GROUP BY 1, 2""")
def enrich_source_brand(spark, d):
    dim = table(spark, d, "supplier").where(c("s_suppkey") % 4 == 0).select(
        F.concat(F.lit("shop-"), c("s_suppkey").cast("string")).alias("source_id"), F.lit("Mammut").alias("store_brand"))
    return jo.enrich_source_brand(raw_offers(spark, d), dim).groupBy("source_id", "brand").agg(F.count(F.lit(1)).alias("n"))


@query("to_eur_as_of", f"""WITH {op.RAW_CTE}, {op.RATES_CTE}, days AS (SELECT DISTINCT currency, run_date FROM raw),
  r AS (SELECT days.currency, run_date, arg_max(fx.rate, fx.rate_date) AS rate FROM days JOIN fx ON fx.currency = days.currency AND fx.rate_date <= run_date GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN raw.currency = 'EUR' THEN 1.0::DOUBLE ELSE r.rate END AS eur_rate
  FROM raw LEFT JOIN r ON r.currency = raw.currency AND r.run_date = raw.run_date""")
def to_eur_as_of(spark, d):
    return jo.to_eur(raw_offers(spark, d), fx_rates(spark, d), "run_date").select(*SEQ, "eur_rate")


@query("apply_shipping", f"""WITH {op.RAW_CTE}, {op.POLICY_CTE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  coalesce(shipping, CASE WHEN currency = 'EUR' AND fee IS NOT NULL THEN CASE WHEN price >= free_from THEN 0 ELSE fee END END)::DOUBLE AS shipping,
  coalesce(return_cost, CASE WHEN currency = 'EUR' AND free_returns THEN 0 END)::DOUBLE AS return_cost
  FROM raw LEFT JOIN policy USING (source_id)""")
def apply_shipping(spark, d):
    return jo.apply_shipping(raw_offers(spark, d), shared(spark, d, POLICIES_SQL)).select(*SEQ, "shipping", "return_cost")


@query("without_hidden", f"{op.KEYED}, {HIDDEN_CTE} SELECT hide_key, count(*) AS n FROM keyed WHERE hide_key NOT IN (SELECT hide_key FROM hidden) GROUP BY 1")
def without_hidden(spark, d):
    return jo.without_hidden(keyed(spark, d), hidden_models(spark, d)).groupBy("hide_key").agg(F.count(F.lit(1)).alias("n"))


def _direct(raw):
    return raw.where(c("l_linestatus_is_o"))


def _arms(spark, d):
    raw = raw_offers(spark, d)
    return raw.where(c("arm") == "direct"), raw.where(c("arm") == "local")


SNAPSHOT_CTES = f"""WITH {op.RAW_CTE}, direct AS (SELECT * FROM raw WHERE arm = 'direct'), snap AS (SELECT * FROM raw WHERE arm = 'local'),
 lastsnap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY seq DESC) AS rn FROM snap) WHERE rn = 1),
 firstsnap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY seq) AS rn FROM snap) WHERE rn = 1),
 j AS (SELECT d.*, s.sizes AS s_sizes, s.rrp AS s_rrp, s.rrp_source AS s_src, s.availability AS s_av,
    coalesce(abs(s.price - d.price) <= greatest(d.price * 0.02::DOUBLE, 0.5), false) AS band, s.size_availability AS s_sa
   FROM direct d LEFT JOIN lastsnap s ON s.source_id = d.source_id AND s.url = d.url),
 f AS (SELECT *, band AND s_sa = 'available' AND size_availability <> 'available' AS ts,
    band AND s_src IS NOT NULL AND rrp_source IS NULL AND s_rrp > price AS tr FROM j),
 merged AS (SELECT source_id, url, price, CASE WHEN ts THEN s_sizes ELSE sizes END AS sizes, CASE WHEN ts THEN 'available' ELSE size_availability END AS size_availability,
    CASE WHEN tr THEN s_src ELSE rrp_source END AS rrp_source, CASE WHEN ts OR tr THEN 'enriched' ELSE 'direct' END AS origin FROM f
  UNION ALL SELECT source_id, url, price, sizes, size_availability, rrp_source, 'added' FROM firstsnap s
    WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.source_id = s.source_id AND d.url = s.url))"""


@query("merge_snapshot", f"{SNAPSHOT_CTES} SELECT source_id, url, price, array_to_string(sizes, ',') AS sizes, size_availability, rrp_source, origin FROM merged")
def merge_snapshot(spark, d):
    return jo.merge_snapshot(*_arms(spark, d)).select(
        "source_id", "url", "price", F.array_join("sizes", ",").alias("sizes"), "size_availability", "rrp_source", "origin")


@query("snapshot_counters", f"""{SNAPSHOT_CTES} SELECT source_id, count(*) FILTER (origin = 'added') AS added,
  count(*) FILTER (origin = 'enriched') AS enriched, count(*) AS parsed_offers FROM merged GROUP BY 1""")
def snapshot_counters(spark, d):
    return jo.snapshot_counters(jo.merge_snapshot(*_arms(spark, d)))


# ---- coverage and reports ---------------------------------------------------------------------
@query("rejection_histogram", f"{op.SCREEN} SELECT source_id, reason, count(*) AS n FROM screened WHERE reason IS NOT NULL GROUP BY 1, 2")
def rejection_histogram(spark, d):
    return ag.rejection_histogram(screened(spark, d))


@query("top_reasons", f"""{op.SCREEN}, h AS (SELECT source_id, reason, count(*) AS n FROM screened WHERE reason IS NOT NULL GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, reason) AS rank FROM h QUALIFY rank <= 3""")
def top_reasons(spark, d):
    return ag.top_reasons(ag.rejection_histogram(screened(spark, d)))


COVERAGE_CTES = f"""{op.BEST}, {op.model_ctes(scope='source_id')},
 q AS (SELECT source_id, count(*) FILTER (qualifies) AS qualified FROM models GROUP BY 1),
 cov0 AS (SELECT source_id, count(*) AS parsed_offers, count(*) FILTER (eligible) AS eligible_offers, count(*) FILTER (price_evidence) AS price_evidence_offers,
   count(*) FILTER (reason IS NULL) AS priced_offers, count(*) FILTER (reason IS NULL AND rrp_verified) AS verified_reference_offers,
   count(*) FILTER (reason IS NULL AND size_fit = 'confirmed') AS available_size_offers FROM screened GROUP BY 1),
 coverage AS (SELECT 'shop-' || CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name,
   CASE WHEN s_suppkey % 9 = 4 THEN 'blocked' WHEN s_suppkey % 9 = 5 THEN 'browser'
     WHEN coalesce(priced_offers, 0) = 0 THEN 'partial' ELSE 'success' END AS status0,
   coalesce(parsed_offers, 0) AS parsed_offers, coalesce(eligible_offers, 0) AS eligible_offers, coalesce(price_evidence_offers, 0) AS price_evidence_offers,
   coalesce(priced_offers, 0) AS priced_offers, coalesce(verified_reference_offers, 0) AS verified_reference_offers,
   coalesce(available_size_offers, 0) AS available_size_offers, coalesce(qualified, 0) AS qualified_offers,
   CASE WHEN status0 = 'browser' AND coalesce(priced_offers, 0) = 0 THEN 'partial' ELSE status0 END AS status,
   CASE WHEN coalesce(parsed_offers, 0) = 0 THEN CASE WHEN status0 = 'blocked' THEN 'blocked' ELSE 'parser-empty' END
     WHEN eligible_offers = 0 THEN 'no-relevant-products' WHEN price_evidence_offers = 0 THEN 'no-reference-price'
     WHEN priced_offers = 0 THEN 'selection-filtered' WHEN coalesce(qualified, 0) = 0 THEN 'no-qualified-deal' END AS diagnostic_code
  FROM supplier LEFT JOIN cov0 ON cov0.source_id = 'shop-' || CAST(s_suppkey AS VARCHAR) LEFT JOIN q ON q.source_id = 'shop-' || CAST(s_suppkey AS VARCHAR))"""
_COV = ("source_id, name, status, parsed_offers, eligible_offers, price_evidence_offers, priced_offers, verified_reference_offers, "
        "available_size_offers, qualified_offers, diagnostic_code")


def crawl_states(spark, d):
    """Crawl results per source: what a collection step would report."""
    k = c("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("shop-"), k.cast("string")).alias("source_id"), c("s_name").alias("name"),
        F.when(k % 9 == 4, "blocked").when(k % 9 == 5, "browser").otherwise("success").alias("status"),
        F.when(k % 11 != 0, F.array(F.lit("http-fetch"), F.when(k % 2 == 0, F.lit("browser-success")).otherwise(
            F.lit("json-ld")))).alias("technical_path"))


_REPORTED = [*rk.RANKED, "url", "brand", "name", "color", "eligible", "price_evidence", "reason", "class"]


def screened_once(spark, d, *more):
    """The screened rows with what reports read of them, written once: a report reads them several times."""
    return stored(screened(spark, d).select(*_REPORTED, *more), "screened")


def coverage(spark, d):
    return ag.source_coverage(screened_once(spark, d), crawl_states(spark, d))


@query("source_coverage", f"{COVERAGE_CTES} SELECT {_COV} FROM coverage")
def source_coverage(spark, d):
    return coverage(spark, d).select(*[x.strip() for x in _COV.split(",")])


_G = {k: op.quote(v) for k, v in fv.COVERAGE_GROUPS.items()}


@query("coverage_groups", f"""{COVERAGE_CTES}, g AS (SELECT *, CASE WHEN qualified_offers > 0 THEN {_G['deals']} WHEN eligible_offers > 0 THEN {_G['eligible']}
   WHEN parsed_offers > 0 THEN {_G['products']} WHEN status = 'blocked' THEN {_G['blocked']} ELSE {_G['empty']} END AS coverage_group FROM coverage)
  SELECT coverage_group, count(*) OVER (PARTITION BY coverage_group) AS group_size, source_id,
   CASE coverage_group WHEN {_G['deals']} THEN name || ' (' || qualified_offers || ')' WHEN {_G['eligible']} THEN name || ' (' || eligible_offers || ')' ELSE name END AS label FROM g""")
def coverage_groups(spark, d):
    return ag.coverage_groups(coverage(spark, d))


@query("source_quality", f"""{COVERAGE_CTES} SELECT count(*) FILTER (priced_offers > 0) AS usable_sources, count(*) FILTER (verified_reference_offers > 0) AS verified_reference_sources,
  count(*) FILTER (available_size_offers > 0) AS confirmed_size_sources, CAST(sum(qualified_offers) AS BIGINT) AS qualified_deals FROM coverage""")
def source_quality(spark, d):
    return ag.source_quality(coverage(spark, d))


@query("run_report", f"""{COVERAGE_CTES}, {op.model_ctes(out='allmodels')}
  SELECT (SELECT count(*) FROM coverage) AS attempted_sources, (SELECT count(*) FROM coverage WHERE status = 'success') AS success,
   (SELECT count(*) FROM coverage WHERE status = 'partial') AS partial, (SELECT count(*) FROM coverage WHERE status = 'browser') AS browser,
   (SELECT count(*) FROM coverage WHERE status = 'blocked') AS blocked, (SELECT count(*) FROM coverage WHERE status = 'failed') AS failed,
   (SELECT CAST(sum(parsed_offers) AS BIGINT) FROM coverage) AS raw_offers, (SELECT count(*) FROM keyed) AS normalized_offers,
   (SELECT count(*) FROM keyed) AS screened_offers, (SELECT count(DISTINCT offer_key) FROM keyed) AS distinct_offers,
   (SELECT count(*) FROM keyed WHERE size_fit = 'confirmed') AS confirmed_size_offers,
   (SELECT count(*) FROM allmodels WHERE qualifies) AS qualified_deals,
   least(12, (SELECT count(*) FROM allmodels WHERE NOT qualifies AND effective_discount_pct >= 30)) AS near_misses""")
def run_report(spark, d):
    rows = screened_once(spark, d)
    norm = rk.with_keys(no.accepted(rows))
    return ag.run_report(ag.source_coverage(rows, crawl_states(spark, d)), norm, norm, rk.rank_models(rk.ranked_only(norm)))


@query("browser_step_counts", """SELECT step, count(*) AS sources FROM (SELECT unnest(['http-fetch', CASE WHEN s_suppkey % 2 = 0 THEN 'browser-success' ELSE 'json-ld' END]) AS step
  FROM supplier WHERE s_suppkey % 11 <> 0) GROUP BY 1""")
def browser_step_counts(spark, d):
    return ag.browser_step_counts(crawl_states(spark, d))


@query("technical_step_flags", """SELECT 'shop-' || CAST(s_suppkey AS VARCHAR) AS source_id, s_suppkey % 11 <> 0 AND s_suppkey % 2 = 0 AS recovered,
  false AS limited FROM supplier""")
def technical_step_flags(spark, d):
    p = c("technical_path")
    return crawl_states(spark, d).select("source_id", sc.has_step(p, "browser-success").alias("recovered"),
                                         sc.has_step(p, "browser-provider-rate-limited").alias("limited"))


@query("arm_metrics", f"""{op.KEYED}, {op.best_ctes()}, {op.model_ctes(scope='arm, source_id')},
 bestarm AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY arm, offer_key ORDER BY
   (CAST(rrp_verified OR discount_verified AS INT) + CAST(shipping_known AS INT) + CAST(size_fit = 'confirmed' AS INT)) DESC, score DESC, effective_cost_eur, seq) AS rn,
   min(seq) OVER (PARTITION BY arm, offer_key) AS first_seq FROM keyed) WHERE rn = 1), {op.model_ctes('bestarm', 'armmodels', 'arm, source_id')},
 q AS (SELECT arm, source_id, count(*) FILTER (qualifies) AS qualified FROM armmodels GROUP BY 1, 2),
 m AS (SELECT arm, source_id, count(*) AS raw_offers, count(DISTINCT url) AS unique_urls, count(*) FILTER (eligible) AS relevant_offers,
   count(*) FILTER (price_evidence) AS evidence_offers, count(*) FILTER (reason IS NULL) AS normalized_offers,
   count(*) FILTER (reason IS NULL AND effective_discount_pct >= 40) AS discount40_offers, count(*) FILTER (reason IS NULL AND size_fit = 'confirmed') AS confirmed_size_offers,
   min(price) FILTER (price > 0) AS min_price, max(price) FILTER (price > 0) AS max_price FROM screened GROUP BY 1, 2),
 t AS (SELECT m.*, coalesce(qualified, 0) AS qualified_offers FROM m LEFT JOIN q USING (arm, source_id))
 SELECT arm, source_id, CAST(sum(raw_offers) AS BIGINT) AS raw_offers, CAST(sum(unique_urls) AS BIGINT) AS unique_urls, CAST(sum(relevant_offers) AS BIGINT) AS relevant_offers,
  CAST(sum(evidence_offers) AS BIGINT) AS evidence_offers, CAST(sum(normalized_offers) AS BIGINT) AS normalized_offers, CAST(sum(discount40_offers) AS BIGINT) AS discount40_offers,
  CAST(sum(confirmed_size_offers) AS BIGINT) AS confirmed_size_offers, CAST(sum(qualified_offers) AS BIGINT) AS qualified_offers,
  min(min_price) AS min_price, max(max_price) AS max_price FROM t GROUP BY GROUPING SETS ((arm, source_id), (arm))""")
def arm_metrics(spark, d):
    return ag.arm_metrics(screened_once(spark, d, "arm", "price"))
