"""Merges, set operations, windows, top-k, run comparison and price history."""
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import aggregates as ag
from ..operators import history as hi
from ..operators import joins as jo
from ..operators import normalize as no
from ..operators import ranking as rk
from ..plans.runs import ab_report, publish_by
from ..settings import DEFAULT
from ..storage import stored
from . import oracle_parts as op
from .core import COVERAGE_CTES, SNAPSHOT_CTES, _arms, offers, screened  # noqa: F401
from .registry import query
from .views import SEQ, raw_offers, shared, table

c = F.col
BR = list(DEFAULT.brands)
RAW = f"WITH {op.RAW_CTE}"
ARMS = f"{RAW}, direct AS (SELECT * FROM raw WHERE arm = 'direct'), local AS (SELECT * FROM raw WHERE arm = 'local')"
_W = "list_distinct(list_filter(regexp_split_to_array({}, '[^a-z0-9]+'), lambda x: length(x) > 2))"


def _similar(a, b):
    wa, wb = _W.format(f"strip_accents(lower({a}))"), _W.format(f"strip_accents(lower({b}))")
    return f"len(list_intersect({wa}, {wb})) >= 0.6 * least(len({wa}), len({wb}))"


# ---- J6-J8 ---------------------------------------------------------------------------
_DETAIL = f"""{ARMS}, asked AS (SELECT DISTINCT source_id, url, name, price FROM direct),
 pairs AS (SELECT a.source_id, a.url, a.name, a.price, v.seq, v.sizes[1] AS size, v.l_returnflag2 AS rf, v.size_availability AS sa, v.rrp AS vr, v.rrp_source AS vs,
    coalesce(abs(v.price - a.price) <= greatest(a.price * 0.02::DOUBLE, 0.5), false) AS band
   FROM asked a JOIN (SELECT *, CASE WHEN l_quantity % 2 = 0 THEN 'OutOfStock' ELSE 'InStock' END AS l_returnflag2 FROM local) v ON v.url = a.url AND v.source_id = a.source_id
   WHERE v.name IS NULL OR (a.name IS NOT NULL AND {_similar('v.name', 'a.name')})),
 found AS (SELECT source_id, url, coalesce(name, '~') AS name, price, bool_and(rf = 'OutOfStock') AS sold,
    list(DISTINCT size) FILTER (band AND sa = 'available') AS sizes, arg_min(vr, seq) FILTER (band AND vr > price AND vs IS NOT NULL) AS ref FROM pairs GROUP BY 1, 2, 3, 4)
 SELECT {', '.join('d.' + s for s in SEQ)}, CASE WHEN f.sold THEN 'out_of_stock' ELSE availability END AS availability,
   CASE WHEN NOT coalesce(f.sold, false) AND f.ref IS NOT NULL AND d.rrp_source IS NULL AND NOT (discount_source IS NOT NULL AND coalesce(observed_discount_pct, 0) >= 40) THEN f.ref ELSE d.rrp END AS rrp,
   CASE WHEN NOT coalesce(f.sold, false) AND f.ref IS NOT NULL AND d.rrp_source IS NULL AND NOT (discount_source IS NOT NULL AND coalesce(observed_discount_pct, 0) >= 40) THEN 'detail:feed:rrp' ELSE d.rrp_source END AS rrp_source,
   CASE WHEN NOT coalesce(f.sold, false) AND len(f.sizes) > 0 THEN array_to_string(list_sort(f.sizes), ',') ELSE '' END AS sizes
 FROM direct d LEFT JOIN found f ON f.source_id = d.source_id AND f.url = d.url AND f.name = coalesce(d.name, '~') AND f.price = d.price"""


@query("merge_detail", _DETAIL)
def merge_detail(spark, d):
    direct, local = _arms(spark, d)
    variants = local.withColumn("page_url", c("url")).withColumn(
        "availability", F.when(c("l_quantity") % 2 == 0, F.lit("OutOfStock")).otherwise(F.lit("InStock"))).withColumn(
        "sizes", F.slice("sizes", 1, 1))
    listing = direct.withColumn("sizes", F.array().cast("array<string>"))
    return jo.merge_detail(listing, variants).select(*SEQ, "availability", "rrp", "rrp_source",
                                                     F.array_join(F.array_sort("sizes"), ",").alias("sizes"))


_TOP8 = f"""top8 AS (SELECT * FROM direct WHERE {op.eligible('name', 'description')} AND discount_source IS NOT NULL AND observed_discount_pct >= 40)"""


@query("discount_checks", f"{ARMS}, {_TOP8} SELECT source_id, {', '.join(SEQ)}, observed_discount_pct FROM top8")
def discount_checks(spark, d):
    return jo.discount_checks(_arms(spark, d)[0]).select("source_id", *SEQ, "observed_discount_pct")


@query("validate_discount_on_detail", f"""{ARMS}, {_TOP8}, hit AS (SELECT v.*, t.observed_discount_pct AS tp, t.discount_source AS ts FROM top8 t JOIN
   (SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE rrp_source END AS rrp_source) FROM direct) v ON v.url = t.url AND abs(v.price - t.price) < 0.011)
  SELECT {', '.join(SEQ)}, url, CASE WHEN rrp_source IS NULL THEN tp ELSE observed_discount_pct END AS observed_discount_pct, rrp_source, 'detail' AS kind FROM hit
  UNION ALL SELECT {', '.join(SEQ)}, url, observed_discount_pct, rrp_source, 'listing' FROM direct WHERE lower(url) NOT IN (SELECT lower(url) FROM hit)""")
def validate_discount_on_detail(spark, d):
    direct = _arms(spark, d)[0]
    variants = direct.withColumn("page_url", c("url")).withColumn(
        "rrp_source", F.when(c("l_partkey") % 3 != 0, c("rrp_source"))).withColumn("kind", F.lit("detail"))
    return jo.validate_discount_on_detail(direct.withColumn("kind", F.lit("listing")), variants).select(
        *SEQ, "url", "observed_discount_pct", "rrp_source", "kind")


_REND = f"""{ARMS}, st AS (SELECT *, 'page-' || l_partkey % 50 AS page_url FROM direct), rn AS (SELECT * REPLACE (CASE WHEN l_partkey % 50 < 25 THEN NULL ELSE rrp_source END AS rrp_source,
    CASE WHEN l_partkey % 50 < 25 THEN NULL ELSE discount_source END AS discount_source), 'page-' || l_partkey % 50 AS page_url FROM local),
 ok AS (SELECT DISTINCT source_id, page_url FROM rn r WHERE rrp_source IS NOT NULL OR discount_source IS NOT NULL OR NOT EXISTS (SELECT 1 FROM st WHERE st.source_id = r.source_id AND st.page_url = r.page_url)),
 shown AS (SELECT * FROM rn SEMI JOIN ok USING (source_id, page_url)),
 lastr AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY source_id, page_url, url ORDER BY seq DESC) = 1),
 j AS (SELECT st.*, r.rrp_source AS r_src, r.discount_source AS r_ds, coalesce(st.rrp_source IS NULL AND st.discount_source IS NULL AND abs(r.price - st.price) < 0.011
     AND (r.rrp_source IS NOT NULL OR r.discount_source IS NOT NULL), false) AS take FROM st LEFT JOIN lastr r ON r.source_id = st.source_id AND r.page_url = st.page_url AND r.url = st.url)"""


@query("merge_rendered_evidence", f"""{_REND} SELECT {', '.join(SEQ)}, CASE WHEN take THEN r_src ELSE rrp_source END AS rrp_source, CASE WHEN take THEN r_ds ELSE discount_source END AS discount_source FROM j
  UNION ALL SELECT {', '.join(SEQ)}, rrp_source, discount_source FROM shown s WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.source_id = s.source_id AND st.page_url = s.page_url AND st.url = s.url)""")
def merge_rendered_evidence(spark, d):
    page = F.concat(F.lit("page-"), (c("l_partkey") % 50).cast("string"))
    direct, local = (x.withColumn("page_url", page) for x in _arms(spark, d))
    bare = c("l_partkey") % 50 < 25
    rendered = local.withColumns({x: F.when(~bare, c(x)) for x in ("rrp_source", "discount_source")})
    return jo.merge_rendered_evidence(direct, rendered).select(*SEQ, "rrp_source", "discount_source")


# ---- U1-U5, W3-W5, L3-L6 ------------------------------------------------------------------
@query("union_all_arms", f"{RAW} SELECT arm, count(*) AS n FROM raw GROUP BY 1")
def union_all_arms(spark, d):
    return jo.union_all(*_arms(spark, d)).groupBy("arm").agg(F.count(F.lit(1)).alias("n"))


@query("union_distinct_urls", f"{RAW} SELECT DISTINCT source_id, url FROM raw")
def union_distinct_urls(spark, d):
    return jo.union_distinct(_arms(spark, d), ["source_id", "url"])


@query("except_by_key", f"{ARMS} SELECT {', '.join(SEQ)} FROM local l WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.source_id = l.source_id AND d.url = l.url)")
def except_by_key(spark, d):
    direct, local = _arms(spark, d)
    return jo.except_by_key(local, direct, ["source_id", "url"]).select(*SEQ)


@query("replace_by_key", f"""{ARMS} SELECT {', '.join(SEQ)} FROM local UNION ALL
  SELECT {', '.join(SEQ)} FROM direct l WHERE NOT EXISTS (SELECT 1 FROM local d WHERE d.source_id = l.source_id AND d.url = l.url)""")
def replace_by_key(spark, d):
    direct, local = _arms(spark, d)
    return jo.replace_by_key(direct, local, ["source_id", "url"]).select(*SEQ)


@query("semi_by_key", f"{ARMS} SELECT {', '.join(SEQ)} FROM local l WHERE EXISTS (SELECT 1 FROM direct d WHERE d.source_id = l.source_id AND d.url = l.url)")
def semi_by_key(spark, d):
    direct, local = _arms(spark, d)
    return jo.semi_by_key(local, direct, ["source_id", "url"]).select(*SEQ)


def _snapshots(spark, d):
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), c("user_id").cast("string")).alias("source_id"),
        c("ts").cast("timestamp").alias("collected_at"), "event_id", c("value").alias("price"))


@query("latest_snapshot", """SELECT 'u' || user_id AS source_id, event_id, value AS price FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 HOUR
  QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def latest_snapshot(spark, d):
    s = _snapshots(spark, d)
    return rk.latest_snapshot(s, s.agg(F.max("collected_at")).first()[0]).select("source_id", "event_id", "price")


@query("snapshot_stats", """SELECT count(*) AS fresh_snapshots, count(*) FILTER (n > 0) AS snapshots_with_offers, strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS latest FROM
  (SELECT user_id, max(ts) AS seen, count(*) FILTER (event_type = 'view') AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 HOUR GROUP BY 1)""")
def snapshot_stats(spark, d):
    ev = table(spark, d, "events").withColumn("at", c("ts").cast("timestamp"))
    now = ev.agg(F.max("at")).first()[0]
    snaps = rk.fresh(ev, "at", now, F.expr("INTERVAL 30 HOURS")).groupBy("user_id").agg(
        F.max("at").alias("collected_at"), F.count_if(c("event_type") == "view").alias("offers"))
    return ag.snapshot_stats(snaps, now).select("fresh_snapshots", "snapshots_with_offers",
                                                F.date_format("latest_collected_at", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("first_per_key", f"{RAW} SELECT {', '.join(SEQ)}, source_id, url FROM raw QUALIFY row_number() OVER (PARTITION BY source_id, url ORDER BY seq) = 1")
def first_per_key(spark, d):
    return rk.first_per_key(raw_offers(spark, d), ["source_id", "url"], "seq").select(*SEQ, "source_id", "url")


@query("last_per_key", f"""{RAW} SELECT {', '.join(SEQ)} FROM raw QUALIFY row_number() OVER (PARTITION BY source_id, lower(url), array_to_string(sizes, '/'), price, rrp ORDER BY seq DESC) = 1""")
def last_per_key(spark, d):
    from ..plans.collect import dedupe_listings
    return dedupe_listings(raw_offers(spark, d)).select(*SEQ)


@query("cap_per_group", f"{RAW} SELECT source_id, {', '.join(SEQ)} FROM raw QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY seq) <= 400")
def cap_per_group(spark, d):
    return rk.cap_per_group(raw_offers(spark, d), ["source_id"], "seq", 400).select("source_id", *SEQ)


_PREMIUM = "(" + " OR ".join(f"contains(t, {op.quote(op.fold_word(b))})" for b in fv.BRANDS) + ")"


@query("detail_candidates", f"""{RAW}, e AS (SELECT *, {op.fold("coalesce(brand, '') || ' ' || coalesce(name, '')")} AS t, lower(regexp_replace(url, '[?#].*$', '')) AS page_key,
    (rrp_source IS NOT NULL OR (discount_source IS NOT NULL AND coalesce(observed_discount_pct, 0) >= 40)) AS proven, l_quantity % 2 = 0 AS sized
   FROM raw WHERE name IS NOT NULL AND {op.eligible('name', 'description')} AND availability <> 'Ausverkauft'),
  r AS (SELECT *, CASE WHEN proven AND NOT sized THEN 1 WHEN NOT proven THEN 2 ELSE 3 END AS priority FROM e WHERE {_PREMIUM}),
  o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_id, page_key ORDER BY priority, seq) = 1)
  SELECT source_id, page_key, priority FROM o QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY priority, seq) <= 50""")
def detail_candidates(spark, d):
    raw = raw_offers(spark, d).withColumn("sizes", F.when(c("l_quantity") % 2 == 0, c("sizes")).otherwise(
        F.array().cast("array<string>")))
    return rk.detail_candidates(raw, BR, 50).select("source_id", "page_key", "priority")


# ---- runs: months of ship dates -----------------------------------------------------------
MONTH = "date_format(run_date, 'yyyy-MM')"
_MON = "strftime(run_date, '%Y-%m')"


def monthly(spark, d):
    return screened(spark, d).withColumn("run_date", F.date_format("run_date", "yyyy-MM"))


MONTHLY = op.SCREEN.replace("screened AS (", "screened0 AS (", 1).replace(
    "offers AS (SELECT * FROM screened WHERE", f"screened AS (SELECT * REPLACE ({_MON} AS run_date) FROM screened0), offers AS (SELECT * FROM screened WHERE")


def month_reports(spark, d):
    """Per month: source coverage and report counters."""
    rows = monthly(spark, d)
    ok = c("reason").isNull()
    cov = rows.groupBy("run_date", "source_id", "l_suppkey").agg(
        F.count(F.lit(1)).alias("parsed_offers"), F.count_if(ok).alias("priced_offers"),
        F.count_if(ok & (c("effective_discount_pct") >= 40)).alias("qualified_offers"),
        F.count_if(ok & (c("size_fit") == "confirmed")).alias("confirmed"))
    cov = cov.withColumns({
        "name": c("source_id"), "status": F.when(c("priced_offers") > 0, F.lit("success")).when(
            c("l_suppkey") % 3 == 0, F.lit("blocked")).otherwise(F.lit("partial")),
        "technical_path": F.when((c("l_suppkey") % 7 != 0) | (F.substring("run_date", 6, 2) != "03"), F.when(
            c("l_suppkey") % 2 == 0, F.array(F.lit("browser-success"))).otherwise(F.array().cast("array<string>")))})
    cov = stored(cov, "month-coverage")  # read by the report and beside it
    report = cov.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("attempted_sources"),
        *[F.count_if(c("status") == s).alias(s) for s in ("success", "partial", "browser", "blocked", "failed")],
        F.sum("parsed_offers").alias("raw_offers"), F.sum("priced_offers").alias("normalized_offers"),
        F.sum("confirmed").alias("confirmed_size_offers"), F.sum("qualified_offers").alias("qualified_deals"),
        F.lit(None).cast("long").alias("near_misses"))
    return cov, report


_MREP = f"""{MONTHLY}, cov AS (SELECT run_date, source_id, l_suppkey, count(*) AS parsed, count(*) FILTER (reason IS NULL) AS priced,
   count(*) FILTER (reason IS NULL AND effective_discount_pct >= 40) AS qualified, count(*) FILTER (reason IS NULL AND size_fit = 'confirmed') AS confirmed FROM screened GROUP BY 1, 2, 3),
 cov2 AS (SELECT *, CASE WHEN priced > 0 THEN 'success' WHEN l_suppkey % 3 = 0 THEN 'blocked' ELSE 'partial' END AS status,
   l_suppkey % 7 <> 0 OR substr(run_date, 6, 2) <> '03' AS known, l_suppkey % 2 = 0 AS recovered FROM cov),
 wide AS (SELECT run_date, count(*) AS attemptedSources, count(*) FILTER (status IN ('success', 'partial')) AS reachedSources, count(*) AS sourcesWithProducts,
   CASE WHEN bool_and(known) THEN count(*) FILTER (recovered) END AS browserRecoveredSources, CASE WHEN bool_and(known) THEN 0 END AS browserProviderLimitedSources,
   count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, 0 AS browser, count(*) FILTER (status = 'blocked') AS blocked, 0 AS failed,
   sum(parsed) AS raw_offers, sum(priced) AS normalized_offers, sum(confirmed) AS confirmed_size_offers, sum(qualified) AS qualified_deals FROM cov2 GROUP BY 1),
 long AS (""" + " UNION ALL ".join(f"SELECT run_date, '{m}' AS metric, CAST({m} AS BIGINT) AS value FROM wide" for m in [
    "attemptedSources", "reachedSources", "sourcesWithProducts", "browserRecoveredSources", "browserProviderLimitedSources", "success", "partial",
    "browser", "blocked", "failed", "raw_offers", "normalized_offers", "confirmed_size_offers", "qualified_deals"]) + \
    " UNION ALL SELECT run_date, 'near_misses', CAST(NULL AS BIGINT) FROM wide)"


@query("run_metrics", f"{_MREP} SELECT run_date, metric, CAST(value AS DOUBLE) AS value FROM long")
def run_metrics(spark, d):
    cov, report = month_reports(spark, d)
    return ag.run_metrics(report, cov).withColumn("value", c("value").cast("double"))


@query("compare_runs", f"""{_MREP} SELECT a.metric, coalesce(a.value, 0) AS current, CAST(b.value AS DOUBLE) AS previous, CAST(coalesce(a.value, 0) - b.value AS DOUBLE) AS delta
  FROM long a JOIN long b USING (metric) WHERE a.run_date = '1998-04' AND b.run_date = '1998-03'""")
def compare_runs(spark, d):
    cov, report = month_reports(spark, d)
    m = ag.run_metrics(report.where(c("run_date").isin("1998-03", "1998-04")), cov)
    out = hi.compare_runs(m.where("run_date = '1998-04'"), m.where("run_date = '1998-03'"))
    return out.withColumns({x: c(x).cast("double") for x in ("previous", "delta")})


@query("compare_sources", f"""{_MREP} SELECT a.source_id, a.status, b.status AS previous_status, a.parsed AS parsed_offers, b.parsed AS previous_parsed_offers, a.parsed - b.parsed AS parsed_delta,
  a.priced - b.priced AS priced_delta, a.qualified - b.qualified AS qualified_delta FROM (SELECT * FROM cov2 WHERE run_date = '1998-04') a LEFT JOIN (SELECT * FROM cov2 WHERE run_date = '1998-03') b USING (source_id)""")
def compare_sources(spark, d):
    cov, _ = month_reports(spark, d)
    out = hi.compare_sources(cov.where("run_date = '1998-04'"), cov.where("run_date = '1998-03'"))
    return out.select("source_id", "status", "previous_status", "parsed_offers", "previous_parsed_offers", "parsed_delta", "priced_delta", "qualified_delta")


@query("previous_run", f"""{_MREP}, r AS (SELECT DISTINCT run_date FROM cov2) SELECT max(run_date) AS run_date FROM r WHERE run_date <= '1998-04'""")
def previous_run(spark, d):
    runs = monthly(spark, d).select("run_date").distinct()
    return hi.previous_run(runs, "1998-04")


PUBLISHED = f"""{MONTHLY}, {op.key_ctes()}, best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_date, offer_key ORDER BY
   (CAST(rrp_verified OR discount_verified AS INT) + CAST(shipping_known AS INT) + CAST(size_fit = 'confirmed' AS INT)) DESC, score DESC, effective_cost_eur, seq) AS rn,
   min(seq) OVER (PARTITION BY run_date, offer_key) AS first_seq FROM keyed) WHERE rn = 1), {op.model_ctes(scope='run_date')},
 near AS (SELECT * FROM models WHERE NOT qualifies AND effective_discount_pct >= 30 QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY score DESC, model_seq) <= 12),
 published AS (SELECT *, 'deal' AS list FROM models WHERE qualifies UNION ALL SELECT *, 'near' FROM near),
 points AS (SELECT offer_key, run_date, effective_cost_eur AS price FROM published)"""


def points(spark, d):
    ranked = rk.rank_models(rk.ranked_only(no.accepted(monthly(spark, d)), ("run_date",), ["url"]), 40, ("run_date",))
    runs = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("run_date")).distinct()
    return hi.history_points(publish_by(ranked, ["run_date"]), runs.withColumn("finished_at", c("run_date")))


@query("published_runs", f"{PUBLISHED} SELECT run_date, list, count(*) AS n, CAST(sum(score) AS BIGINT) AS scores FROM published GROUP BY 1, 2")
def published_runs(spark, d):
    ranked = rk.rank_models(no.accepted(monthly(spark, d)), 40, ("run_date",))
    return publish_by(ranked, ["run_date"]).groupBy("run_date", "list").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("scores"))


@query("price_history", f"""{PUBLISHED} SELECT offer_key, array_to_string(list(run_date ORDER BY run_date), ',') AS dates, list(price ORDER BY run_date)[1] AS first_price, count(*) AS n FROM points GROUP BY 1""")
def price_history(spark, d):
    h = hi.price_history(points(spark, d))
    return h.select("offer_key", F.array_join(F.transform("points", lambda p: p["date"]), ",").alias("dates"),
                    c("points")[0]["price"].alias("first_price"), F.size("points").cast("long").alias("n"))


@query("price_change", f"""{PUBLISHED} SELECT offer_key, count(*) AS observations, arg_min(price, run_date) AS first_price, arg_max(price, run_date) AS last_price,
  CASE WHEN count(*) > 1 THEN arg_min(price, run_date) END AS earlier_price, arg_max(row(price, previous), run_date)[2] AS previous_price, arg_max(price, run_date) - arg_max(row(price, previous), run_date)[2] AS last_step,
  arg_max(row(price, low), run_date)[2] AS lowest_before FROM (SELECT *, lag(price) OVER (PARTITION BY offer_key ORDER BY run_date) AS previous,
    min(price) OVER (PARTITION BY offer_key ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM points) GROUP BY 1""")
def price_change(spark, d):
    return hi.price_change(points(spark, d))


@query("price_steps", f"""{PUBLISHED}, s AS (SELECT *, lag(price) OVER (PARTITION BY offer_key ORDER BY run_date) AS previous_price,
    min(price) OVER (PARTITION BY offer_key ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest_before FROM points)
  SELECT offer_key, run_date, price, previous_price, lowest_before, price - previous_price AS step, coalesce(price < lowest_before, false) AS new_low FROM s""")
def price_steps(spark, d):
    return hi.price_steps(points(spark, d)).drop("seq")


@query("complete_runs", f"""{RAW} SELECT {_MON} AS run_date, count(DISTINCT floor(l_suppkey / 6)) AS batch_count FROM raw GROUP BY 1
  HAVING count(DISTINCT floor(l_suppkey / 6)) = (SELECT count(DISTINCT floor(s_suppkey / 6)) FROM supplier)""")
def complete_runs(spark, d):
    raw = raw_offers(spark, d).select(F.date_format("run_date", "yyyy-MM").alias("run_date"), F.floor(c("l_suppkey") / 6).alias("batch"))
    n = jo.expected_batches(table(spark, d, "supplier"), "s_suppkey").count()
    return ag.complete_runs(raw, n)


@query("missing_batches", """WITH b AS (SELECT CAST(floor(s_suppkey / 6) AS BIGINT) AS batch, count(*) AS source_count, count(*) FILTER (s_suppkey % 13 <> 1) AS done FROM supplier GROUP BY 1)
  SELECT batch, source_count FROM b WHERE done <> source_count""")
def missing_batches(spark, d):
    s = table(spark, d, "supplier")
    return jo.missing_batches(jo.expected_batches(s, "s_suppkey"), jo.expected_batches(s.where(c("s_suppkey") % 13 != 1), "s_suppkey"))


@query("batch_status", f"""{op.SCREEN} SELECT CAST(floor(l_suppkey / 6) AS BIGINT) AS batch, count(DISTINCT source_id) AS source_count, count(*) AS normalized_offers FROM offers GROUP BY 1""")
def batch_status(spark, d):
    b = offers(spark, d).withColumns({"batch": F.floor(c("l_suppkey") / 6), "run_date": F.lit("x")})
    return ag.batch_status(b).drop("run_date")


@query("latest_runs", f"{RAW} SELECT run_date, n FROM (SELECT {_MON} AS run_date, count(*) AS n FROM raw GROUP BY 1) ORDER BY run_date DESC LIMIT 30")
def latest_runs(spark, d):
    runs = raw_offers(spark, d).groupBy(F.date_format("run_date", "yyyy-MM").alias("run_date")).agg(F.count(F.lit(1)).alias("n"))
    return rk.latest(runs, "run_date", 30)


@query("compare_arms", f"""{ARMS}, m AS (SELECT arm, source_id, count(*) AS n FROM raw GROUP BY 1, 2)
  SELECT l.source_id, l.n AS local_raw_offers, d.n AS direct_raw_offers FROM m l LEFT JOIN m d ON d.source_id = l.source_id AND d.arm = 'direct' WHERE l.arm = 'local'""")
def compare_arms(spark, d):
    m = raw_offers(spark, d).groupBy("arm", "source_id").agg(F.count(F.lit(1)).alias("raw_offers"))
    return hi.compare_arms(m)


@query("ab_selection", PUBLISHED.replace(f"REPLACE ({_MON} AS run_date)", "REPLACE (arm AS run_date)") + " SELECT run_date AS arm, list, offer_key, score FROM published")
def ab_selection(spark, d):
    return ab_report(screened(spark, d))[2].select("arm", "list", "offer_key", "score")


@query("apply_hide_events", """WITH log AS (SELECT 'm' || user_id AS hide_key, 'L' || event_id AS label, CASE WHEN event_type = 'error' THEN 'unhide' ELSE 'hide' END AS action, ts, event_id FROM events),
  u AS (SELECT hide_key, max(ts) AS undone FROM log WHERE action = 'unhide' GROUP BY 1)
  SELECT hide_key, arg_max(label, ts) AS label, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS hidden_at FROM log LEFT JOIN u USING (hide_key)
  WHERE action = 'hide' AND (undone IS NULL OR ts > undone) GROUP BY 1""")
def apply_hide_events(spark, d):
    from ..operators.sinks import apply_hide_events as apply
    log = table(spark, d, "events").select(
        F.concat(F.lit("m"), c("user_id").cast("string")).alias("hide_key"), F.concat(F.lit("L"), c("event_id").cast("string")).alias("label"),
        F.when(c("event_type") == "error", F.lit("unhide")).otherwise(F.lit("hide")).alias("action"), c("ts").cast("timestamp").alias("at"))
    # The stored state is what the first half of the log leads to; the second half arrives.
    half = log.agg(F.expr("min(at) + (max(at) - min(at)) / 2")).first()[0]
    empty = log.limit(0).select("hide_key", "label", c("at").alias("hidden_at"))
    stored = apply(empty, log.where(c("at") <= half))
    return apply(stored, log.where(c("at") > half)).select(
        "hide_key", "label", F.date_format("hidden_at", "yyyy-MM-dd HH:mm:ss").alias("hidden_at"))
