"""Stored tables, composite runs and streams over the given tables."""
from pyspark.sql import functions as F

from ..operators import joins as jo
from ..operators import normalize as no
from ..operators import sinks as sk
from ..plans import collect, runs
from ..sources.reference import stored
from ..storage import stored as written
from ..streaming import observations as ob
from . import oracle_parts as op
from .core import COVERAGE_CTES, HIDDEN_CTE, crawl_states, hidden_models, keyed, offers, screened  # noqa: F401
from .registry import query
from .sources import BASE, base, de
from .views import POLICIES_SQL, SEQ, TASKS_PER_CORE, fx_rates, raw_offers, shared, table

c = F.col

# ---- K1-K3, K5, S23 ------------------------------------------------------------------------
_B = "CAST(floor(l_suppkey / 6) AS INT)"


@query("write_batches", f"WITH {op.RAW_CTE} SELECT {_B} AS batch, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM raw GROUP BY 1")
def write_batches(spark, d):
    """K1 twice: the second write of a batch replaces the first."""
    path = sk.work_folder(spark, "batches")
    raw = raw_offers(spark, d).withColumn("batch", F.floor(c("l_suppkey") / 6).cast("int")).drop("run_date")
    sk.write_batch(raw.limit(0).unionByName(raw.withColumn("l_partkey", F.lit(-1).cast("bigint"))), path, "2024-01-02")
    sk.write_batch(raw, path, "2024-01-02", batches=raw.select("batch").distinct())
    return stored(spark, path, "2024-01-02").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@query("stored_scan", f"WITH {op.RAW_CTE} SELECT {', '.join(SEQ)} FROM raw WHERE run_date < DATE '1998-01-01' AND {_B} IN (0, 1)")
def stored_scan(spark, d):
    path = sk.work_folder(spark, "scan")
    raw = raw_offers(spark, d).withColumns({"batch": F.floor(c("l_suppkey") / 6).cast("int"), "run_date": F.trunc("run_date", "year")})
    sk.write_batch(raw.select(*SEQ, "run_date", "batch"), path)
    return stored(spark, path, before="1998-01-01", batches=[0, 1]).select(*SEQ)


@query("write_snapshots", """WITH s AS (SELECT 'u' || user_id AS source_id, CAST(ts AS DATE) AS day, event_id, value, event_type FROM events)
  SELECT source_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM s WHERE event_type = 'view' OR NOT EXISTS
   (SELECT 1 FROM s v WHERE v.source_id = s.source_id AND v.day = s.day AND v.event_type = 'view') GROUP BY 1, 2""")
def write_snapshots(spark, d):
    """K3: the "view" rows arrive later and replace the snapshot of their source and day."""
    path = sk.work_folder(spark, "snapshots")
    s = table(spark, d, "events").select(
        F.concat(F.lit("u"), c("user_id").cast("string")).alias("source_id"), c("ts").cast("timestamp").alias("collected_at"), "event_id", "event_type")
    sk.write_snapshots(s, path)
    sk.write_snapshots(s.where("event_type = 'view'"), path)
    return spark.read.parquet(path).groupBy("source_id", F.date_format("collected_date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("write_summary", f"{op.SCREEN} SELECT arm, count(*) AS n, count(*) FILTER (reason IS NULL) AS ok FROM screened GROUP BY 1")
def write_summary(spark, d):
    path = sk.work_folder(spark, "summary")
    sk.write_summary(screened(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("reason").isNull()).alias("ok")), path)
    return spark.read.schema("arm string, n long, ok long").json(path)


# ---- X1-X4 ---------------------------------------------------------------------------------------
_RAW2 = f"""{op.POLICY_CTE}, raw2 AS (SELECT raw.* REPLACE (coalesce(nullif(brand, ''), CASE WHEN l_suppkey % 4 = 0 THEN 'Mammut' END) AS brand,
   CAST(coalesce(shipping, CASE WHEN currency = 'EUR' AND fee IS NOT NULL THEN CASE WHEN price >= free_from THEN 0 ELSE fee END END) AS DOUBLE) AS shipping,
   CAST(coalesce(return_cost, CASE WHEN currency = 'EUR' AND free_returns THEN 0 END) AS DOUBLE) AS return_cost) FROM raw LEFT JOIN policy USING (source_id))"""
RUN = f"WITH {op.RAW_CTE}, {op.RATES_CTE}, {_RAW2}, {op.screen_ctes('raw2')}, {op.key_ctes()}, {op.best_ctes()}, {op.model_ctes(scope='source_id')}" + \
    COVERAGE_CTES[COVERAGE_CTES.index(",\n q AS"):]
DAY = "2024-01-03"


def _batch_inputs(spark, d):
    k = c("s_suppkey")
    supplier = table(spark, d, "supplier")
    brands = supplier.where(k % 4 == 0).select(F.concat(F.lit("shop-"), k.cast("string")).alias("source_id"), F.lit("Mammut").alias("store_brand"))
    index = supplier.select(F.concat(F.lit("shop-"), k.cast("string")).alias("source_id"), F.floor(k / 6).cast("int").alias("batch"))
    crawl = crawl_states(spark, d).join(index, "source_id")
    raw = raw_offers(spark, d).drop("run_date")
    return raw, crawl, dict(source_brands=brands, policies=shared(spark, d, POLICIES_SQL), rates=fx_rates(spark, d))


def _stored_run(spark, d):
    root = sk.work_folder(spark, "run")
    raw, crawl, dims = _batch_inputs(spark, d)
    runs.run_batch(raw, crawl, root, DAY, **dims)
    return root


@query("run_batch", f"""{RUN} SELECT source_id, status, parsed_offers, eligible_offers, price_evidence_offers, priced_offers, verified_reference_offers,
  available_size_offers, qualified_offers, diagnostic_code FROM coverage""")
def run_batch(spark, d):
    root = _stored_run(spark, d)
    return stored(spark, f"{root}/coverage", DAY).select(
        "source_id", "status", "parsed_offers", "eligible_offers", "price_evidence_offers", "priced_offers",
        "verified_reference_offers", "available_size_offers", "qualified_offers", "diagnostic_code")


_FINAL = f"""{RUN}, {HIDDEN_CTE}, shown AS (SELECT * FROM keyed WHERE hide_key NOT IN (SELECT hide_key FROM hidden)),
 {op.best_ctes('shown', 'best2')}, {op.model_ctes('best2', 'picks')}"""


def _expected(spark, d):
    return jo.expected_batches(table(spark, d, "supplier"), "s_suppkey").withColumn("batch", c("batch").cast("int"))


def _hidden(spark, root):
    from ..operators.ranking import with_keys
    return with_keys(no.accepted(stored(spark, f"{root}/screened", DAY))).where(c("l_partkey") % 7 == 0).select("hide_key").distinct()


@query("finalize_run", f"{_FINAL} SELECT offer_key, model_key, score, class, effective_cost_eur FROM picks WHERE qualifies")
def finalize_run(spark, d):
    root = _stored_run(spark, d)
    out = runs.finalize_run(spark, root, DAY, _expected(spark, d), _hidden(spark, root))
    return out.deals.select("offer_key", "model_key", "score", "class", "effective_cost_eur")


@query("finalize_report", f"""{_FINAL} SELECT (SELECT count(*) FROM coverage) AS attempted_sources, (SELECT count(*) FROM keyed) AS normalized_offers, (SELECT count(*) FROM shown) AS screened_offers,
  (SELECT count(DISTINCT offer_key) FROM shown) AS distinct_offers, (SELECT count(*) FROM picks WHERE qualifies) AS qualified_deals,
  least(12, (SELECT count(*) FROM picks WHERE NOT qualifies AND effective_discount_pct >= 30)) AS near_misses""")
def finalize_report(spark, d):
    root = _stored_run(spark, d)
    out = runs.finalize_run(spark, root, DAY, _expected(spark, d), _hidden(spark, root))
    return out.report.select("attempted_sources", "normalized_offers", "screened_offers", "distinct_offers", "qualified_deals", "near_misses")


@query("replay_latest", f"{RUN}, {op.model_ctes('best', 'picks')} SELECT offer_key, score, class FROM picks WHERE qualifies")
def replay_latest(spark, d):
    root = _stored_run(spark, d)
    return runs.replay_latest(spark, root, _expected(spark, d).count()).deals.select("offer_key", "score", "class")


@query("current_view", f"""{RUN}, {op.model_ctes('best', 'picks')} SELECT offer_key, score, 1 AS observations, effective_cost_eur AS last_price FROM picks WHERE qualifies""")
def current_view(spark, d):
    root = _stored_run(spark, d)
    runs.finalize_run(spark, root, DAY, _expected(spark, d))
    return runs.current_view(spark, root)[0].select("offer_key", "score", "observations", "last_price")


_DAYS = ["2024-01-03", "2024-01-04", "2024-01-05"]
#: Three runs of all sources: the second is a tenth dearer for a third of the parts, the third lacks a fifth of the lines.
_RAW3 = """raw2 AS (SELECT raw.* REPLACE (CAST(CASE WHEN day = 1 AND l_partkey % 3 = 0 THEN floor(price * 110 + 0.5) / 100 ELSE price END AS DOUBLE) AS price), day
  FROM raw, (VALUES (0), (1), (2)) days(day) WHERE day < 2 OR l_orderkey % 5 <> 0)"""
_THREE = f"""WITH {op.RAW_CTE}, {op.RATES_CTE}, {_RAW3}, {op.screen_ctes('raw2')}, {op.key_ctes()}, best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY day, offer_key ORDER BY
   (CAST(rrp_verified OR discount_verified AS INT) + CAST(shipping_known AS INT) + CAST(size_fit = 'confirmed' AS INT)) DESC, score DESC, effective_cost_eur, seq) AS rn,
   min(seq) OVER (PARTITION BY day, offer_key) AS first_seq FROM keyed) WHERE rn = 1), {op.model_ctes(scope='day')},
 near AS (SELECT * FROM models WHERE NOT qualifies AND effective_discount_pct >= 30 QUALIFY row_number() OVER (PARTITION BY day ORDER BY score DESC, model_seq) <= 12),
 points AS (SELECT offer_key, day, effective_cost_eur AS price FROM models WHERE qualifies UNION ALL SELECT offer_key, day, effective_cost_eur FROM near),
 change AS (SELECT offer_key, count(*) AS observations, arg_min(price, day) AS first_price, arg_max(price, day) AS last_price, arg_max(row(price, previous), day)[2] AS previous_price, arg_max(row(price, low), day)[2] AS lowest_before
   FROM (SELECT *, lag(price) OVER (PARTITION BY offer_key ORDER BY day) AS previous, min(price) OVER (PARTITION BY offer_key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM points) GROUP BY 1)"""


def _three_runs(spark, d):
    """Three stored runs; the second is published once more at the end, as after a correction."""
    root = sk.work_folder(spark, "runs")
    raw, crawl, dims = _batch_inputs(spark, d)
    dearer = F.when(c("l_partkey") % 3 == 0, F.floor(c("price") * 110 + 0.5) / 100).otherwise(c("price"))
    for k, day in enumerate(_DAYS):
        rows = raw if k < 2 else raw.where(c("l_orderkey") % 5 != 0)
        runs.run_batch(rows.withColumn("price", dearer) if k == 1 else rows, crawl, root, day, rates=dims["rates"])
        runs.finalize_run(spark, root, day, _expected(spark, d))
    runs.finalize_run(spark, root, _DAYS[1], _expected(spark, d))
    return root


@query("current_view_of_three_runs", f"""{_THREE} SELECT m.offer_key, m.score, observations, first_price, last_price, previous_price, last_price - previous_price AS last_step, lowest_before
  FROM models m JOIN change ON change.offer_key = m.offer_key WHERE m.day = 2 AND m.qualifies""")
def current_view_of_three_runs(spark, d):
    return runs.current_view(spark, _three_runs(spark, d))[0].select(
        "offer_key", "score", "observations", "first_price", "last_price", "previous_price", "last_step", "lowest_before")


_TWO = _THREE.replace("(VALUES (0), (1), (2))", "(VALUES (0), (1))").replace("WHERE day < 2 OR l_orderkey % 5 <> 0", "WHERE l_suppkey % 11 <> 5")
_COUNTS = {"raw_offers": "(SELECT count(*) FROM raw2 x WHERE x.day = {0})", "normalized_offers": "(SELECT count(*) FROM keyed x WHERE x.day = {0})",
           "confirmed_size_offers": "(SELECT count(*) FROM keyed x WHERE x.day = {0} AND size_fit = 'confirmed')",
           "qualified_deals": "(SELECT count(*) FROM models x WHERE x.day = {0} AND qualifies)", "near_misses": "(SELECT count(*) FROM near x WHERE x.day = {0})"}


def _two_runs(spark, d):
    """Two stored runs with their times; every eleventh source is not registered any more."""
    root = sk.work_folder(spark, "runs")
    raw, crawl, dims = _batch_inputs(spark, d)
    kept = table(spark, d, "supplier").where(c("s_suppkey") % 11 != 5).select(F.concat(F.lit("shop-"), c("s_suppkey").cast("string")).alias("source_id"))
    crawl = jo.semi_by_key(crawl, kept, ["source_id"])
    expected = crawl.groupBy("batch").agg(F.count(F.lit(1)).alias("source_count"))
    dearer = F.when(c("l_partkey") % 3 == 0, F.floor(c("price") * 110 + 0.5) / 100).otherwise(c("price"))
    for k, day in enumerate(_DAYS[:2]):
        runs.run_batch(raw.withColumn("price", dearer) if k else raw, crawl, root, day, rates=dims["rates"], started_at=f"{day} 05:00:00", finished_at=f"{day} 06:30:00")
        out = runs.finalize_run(spark, root, day, expected)
    return out


@query("compared_runs", f"{_TWO} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {q.format(1)} AS current, CAST({q.format(0)} AS DOUBLE) AS previous, CAST({q.format(1)} - {q.format(0)} AS DOUBLE) AS delta, 'previous-day' AS baseline_kind" for m, q in _COUNTS.items()))
def compared_runs(spark, d):
    """What the second run publishes beside the first."""
    out = _two_runs(spark, d).metrics.where(c("metric").isin(*_COUNTS))
    return out.select("metric", "current", c("previous").cast("double").alias("previous"), c("delta").cast("double").alias("delta"), "baseline_kind")


@query("complete_report", f"""{_TWO} SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 11 <> 5) AS planned_sources, (SELECT count(*) FROM supplier WHERE s_suppkey % 11 <> 5) AS attempted_sources,
  (SELECT count(DISTINCT l_suppkey) FROM raw WHERE l_suppkey % 11 = 5) AS unknown_sources, (SELECT count(*) FROM raw WHERE l_suppkey % 11 = 5) AS unknown_offers,
  '2024-01-04 05:00:00' AS started, '2024-01-04 06:30:00' AS finished, {_COUNTS['qualified_deals'].format(1)} AS qualified_deals""")
def complete_report(spark, d):
    """A5: times, planned sources and what came from sources that are not registered."""
    return _two_runs(spark, d).report.select(
        "planned_sources", "attempted_sources", "unknown_sources", "unknown_offers", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"),
        F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished"), "qualified_deals")


# ---- X6 -----------------------------------------------------------------------------------------------
@query("collect_offers", f"""WITH {op.RAW_CTE}, kinds AS (SELECT *, CASE l_suppkey % 5 WHEN 0 THEN 'shop-api' WHEN 1 THEN 'commerce-api' WHEN 2 THEN 'listing' WHEN 3 THEN 'feed' ELSE 'json-ld' END AS kind FROM raw)
  SELECT source_id, kind AS rung, count(*) AS n FROM kinds GROUP BY 1, 2""")
def collect_offers(spark, d):
    """Every kind of data exists for the sources that end at it; listings of rung "listing"
    carry evidence, so the later rungs of those sources are not used."""
    raw = raw_offers(spark, d).withColumn("page_id", c("l_orderkey"))
    k = c("l_suppkey") % 5
    raw = raw.withColumn("rrp_source", F.when(k == 2, F.lit("x")).otherwise(c("rrp_source")))
    raw = raw.withColumn("url", F.concat("url", F.lit("?n="), F.concat_ws("-", *SEQ)))
    states = crawl_states(spark, d).select("source_id", "name", F.lit(2).alias("discovered_urls"), F.lit(False).alias("blocked"),
                                           F.lit(False).alias("is_post_source"))
    out, _ = collect.collect_offers(
        states, shop_api=raw.where(k == 0), commerce_api=raw.where(k.isin(0, 1)), listings=raw.where(k == 2),
        json_feed=raw.where(k.isin(0, 2, 3)), jsonld=raw.where(k.isin(1, 2, 3, 4)), cards=raw)
    return out.groupBy("source_id", "rung").agg(F.count(F.lit(1)).alias("n"))


# ---- streams ---------------------------------------------------------------------------------------------
def _events(spark, d):
    return ob.read_observations(spark, d, table(spark, d, "events").schema, pattern="events.parquet")


def _run(stream, spark, mode="update"):
    path = sk.work_folder(spark, "stream")
    ob.write_versions(stream, f"{path}/table", f"{path}/checkpoint", mode).awaitTermination()
    return spark.read.parquet(f"{path}/table")


@query("dedupe_stream", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def dedupe_stream(spark, d):
    e = _events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return _run(ob.dedupe_stream(e, ["user_id", "event_type", "day"]), spark, "append").select("user_id", "event_type", "day")


@query("coverage_by_window", """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS parsed_offers, count(*) FILTER (value > 0) AS priced_offers FROM events GROUP BY 1, 2""")
def coverage_by_window(spark, d):
    t = _run(ob.coverage_by_window(_events(spark, d), ["user_id"]), spark)
    return ob.newest_versions(t, ["run_date", "user_id"]).select(
        "user_id", F.date_format("run_date", "yyyy-MM-dd").alias("day"), "parsed_offers", "priced_offers")


@query("latest_offer_state", """SELECT user_id, event_type, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 HOUR
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) = 1""")
def latest_offer_state(spark, d):
    t = _run(ob.latest_offer_state(_events(spark, d), ["user_id"], ["event_type", "value"]), spark)
    return ob.current_state(t, ["user_id"], F.lit(t.agg(F.max("ts")).first()[0])).select("user_id", "event_type", "value")


@query("late_rows", "SELECT event_type, ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS late, count(*) AS n FROM events GROUP BY 1, 2")
def late_rows(spark, d):
    now = table(spark, d, "events").agg(F.max("ts").cast("timestamp")).first()[0]
    t = _run(ob.late_rows(_events(spark, d), F.lit(now)), spark, "append")
    return t.groupBy("event_type", "late").agg(F.count(F.lit(1)).alias("n"))


@query("price_drop_alerts", """WITH m AS (SELECT user_id, floor(epoch(ts) / 2592000) AS slot, arg_min(value, row(ts, value)) AS first_price, arg_max(value, row(ts, value)) AS last_price, count(*) AS observations FROM events GROUP BY 1, 2)
  SELECT user_id, first_price, last_price, observations FROM m WHERE observations > 1 AND last_price < first_price""")
def price_drop_alerts(spark, d):
    moves = ob.price_moves(_events(spark, d), ["user_id"], price="value")
    t = ob.newest_versions(_run(moves, spark), ["user_id", "slot"])
    return ob.price_drop_alerts(t).select("user_id", "first_price", "last_price", "observations")


@query("feed_stream", f"{BASE} SELECT brand, count(*) AS n, CAST(sum(pc) AS BIGINT) AS cents FROM base WHERE brand <> 'Salewa' AND p_type NOT IN ('STANDARD', 'PROMO') GROUP BY 1")
def feed_stream(spark, d):
    """The gates of S3 over a feed that arrives file by file."""
    from ..schemas import TSV_FEED
    from ..sources import feeds
    rows = base(spark, d, vk=de("pc")).select(
        c("brand").alias("Hersteller"), c("name").alias("Bezeichnung"), F.lit("t").alias("Beschreibung"),
        F.when(c("name").endswith("Jacke"), F.lit("Herren > Jacken")).when(c("name").contains("Damen"), F.lit("Damen > Hosen"))
        .otherwise(F.lit("Herren > Hosen")).alias("Kategorie"),
        F.when(c("name").contains("Damen"), F.lit("Damen")).otherwise(F.lit("Unisex")).alias("Geschlecht"), F.lit("x").alias("Stichworte"), c("vk").alias("VK"),
        c("url").alias("Partnerlink"), F.lit("L").alias("Groesse"), F.lit("0").alias("Versandkosten"), F.lit("bald").alias("Lieferstatus"),
        c("l_partkey").cast("string").alias("Modellnr"), F.lit("i").alias("Bild-url"), F.lit("EUR").alias("Währung"))
    path = sk.work_folder(spark, "feed")
    rows.write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    stream = feeds.tsv_rows(ob.read_feed_stream(spark, path, TSV_FEED, max_files=4), "shop-1")
    t = _run(stream.select("brand", "price"), spark, "append")
    return t.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(c("price") * 100).cast("long")).alias("cents"))


@query("select_deals_stream", f"{op.MODELS} SELECT offer_key, model_key, score FROM models WHERE qualifies")
def select_deals_stream(spark, d):
    path = sk.work_folder(spark, "deals-stream")
    # four micro-batches, each of as many files as there are tasks to read them; the rows are dealt before they are wide
    raw = raw_offers(spark, d, 4 * TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    raw.write.parquet(f"{path}/raw")
    written_files = len(spark.read.schema(raw.schema).parquet(f"{path}/raw").inputFiles())
    files = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", max(1, -(-written_files // 4))).parquet(f"{path}/raw")
    stream = no.normalize_offers(files, rates=written(fx_rates(spark, d), "rates"))  # read by every micro-batch
    ob.select_deals_stream(stream, f"{path}/best", f"{path}/checkpoint").awaitTermination()
    return ob.stream_models(spark.read.parquet(f"{path}/best")).where("qualifies").select("offer_key", "model_key", "score")
