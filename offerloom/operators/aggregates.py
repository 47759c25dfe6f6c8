"""Grouping of variants, coverage per source and report counters."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import scoring as sc
from ..functions import text as tx
from .ranking import qualified_by_source


def group_variants(rows: DataFrame, keys, size_col: str = "size", seq: str = "seq") -> DataFrame:
    """A1: one row per key: the first row's values, distinct sizes in order of appearance,
    in stock when any row is. Sizes are made distinct in a first aggregation, so a key with
    very many rows only carries its different sizes into the second."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in (*keys, size_col, seq, "in_stock")]
    per_size = rows.groupBy(*keys, size_col).agg(
        F.min(seq).alias(seq), F.min_by(F.struct(*rest), F.col(seq)).alias("r"), F.bool_or("in_stock").alias("in_stock"))
    sized = F.when(tx.blank(F.col(size_col)) != "", F.struct(F.col(seq), F.col(size_col)))
    out = per_size.groupBy(*keys).agg(
        F.min_by("r", seq).alias("r"), F.min(seq).alias(seq), F.bool_or("in_stock").alias("in_stock"),
        F.array_sort(F.collect_list(sized)).alias("s"))
    return out.select(*keys, "r.*", seq, "in_stock", F.transform("s", lambda x: x[size_col]).alias("sizes"))


def source_counts(screened: DataFrame) -> DataFrame:
    """A2 + A3: counters and the rejection histogram of every source in one pass. Counts per
    (source, reason) are partially aggregated; the second step sees at most eleven rows per source."""
    ok = F.col("reason").isNull()
    per_reason = screened.groupBy("source_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("eligible"),
        F.count_if("price_evidence").alias("evidence"),
        F.count_if(ok & F.col("rrp_verified")).alias("verified"),
        F.count_if(ok & (F.col("size_fit") == "confirmed")).alias("confirmed"))
    return per_reason.groupBy("source_id").agg(
        F.sum("n").alias("parsed_offers"), F.sum("eligible").alias("eligible_offers"),
        F.sum("evidence").alias("price_evidence_offers"),
        F.sum(F.when(ok, F.col("n")).otherwise(F.lit(0))).alias("priced_offers"),
        F.sum("verified").alias("verified_reference_offers"),
        F.sum("confirmed").alias("available_size_offers"),
        F.map_from_entries(F.collect_list(F.when(~ok, F.struct("reason", "n")))).alias("rejection_reasons"))


def rejection_histogram(screened: DataFrame) -> DataFrame:
    """A3 in long form: (source_id, reason, n)."""
    return screened.where(F.col("reason").isNotNull()).groupBy("source_id", "reason").agg(
        F.count(F.lit(1)).alias("n"))


def top_reasons(histogram: DataFrame, n: int = 3) -> DataFrame:
    """A4: the largest reasons per source."""
    order = Window.partitionBy("source_id").orderBy(F.desc("n"), F.asc("reason"))
    return histogram.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def source_coverage(screened: DataFrame, crawl: DataFrame | None = None,
                    minimum: float = fv.MIN_DISCOUNT_PCT) -> DataFrame:
    """A2 with A3 and F31. `crawl` (source_id, name, status, ...) is the driving side, so
    sources without any row are reported too. A source counted as reached becomes partial
    when none of its offers was accepted."""
    offers = screened.where(F.col("reason").isNull())
    counts = source_counts(screened).join(qualified_by_source(offers, minimum), "source_id", "left")
    if crawl is None:
        crawl = counts.select("source_id", F.col("source_id").alias("name"), F.lit("success").alias("status"))
    zero = ["parsed_offers", "eligible_offers", "price_evidence_offers", "priced_offers",
            "verified_reference_offers", "available_size_offers", "qualified_offers"]
    drop = [c for c in zero + ["rejection_reasons", "diagnostic_code"] if c in crawl.columns]
    out = crawl.drop(*drop).join(counts, "source_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    c = F.col
    out = out.withColumn("status", F.when(
        c("status").isin("success", "browser") & (c("priced_offers") == 0), F.lit("partial")).otherwise(c("status")))
    return out.withColumn("diagnostic_code", sc.diagnose(
        c("status"), c("parsed_offers"), c("eligible_offers"), c("price_evidence_offers"),
        c("priced_offers"), c("qualified_offers")))


def status_counts(coverage: DataFrame) -> DataFrame:
    """The coverage part of A5: one row."""
    return coverage.agg(
        F.count(F.lit(1)).alias("attempted_sources"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "partial", "browser", "blocked", "failed")],
        F.coalesce(F.sum("parsed_offers"), F.lit(0)).alias("raw_offers"))


def offer_counts(normalized: DataFrame, screened: DataFrame) -> DataFrame:
    """The offer part of A5: one row. Distinct keys are counted exactly (partial aggregation
    by key, then a global count)."""
    a = normalized.agg(F.count(F.lit(1)).alias("normalized_offers"))
    b = screened.groupBy("offer_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("size_fit") == "confirmed").alias("c")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("screened_offers"), F.count(F.lit(1)).alias("distinct_offers"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("confirmed_size_offers"))
    return one_row(a, b)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put single-row aggregates with different columns side by side (union, then max)."""
    from functools import reduce
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def run_report(coverage: DataFrame, normalized: DataFrame, screened: DataFrame, ranked: DataFrame,
               near_min: float = fv.NEAR_MIN_PCT, near_limit: int = fv.NEAR_LIMIT, planned: DataFrame | None = None,
               unknown: DataFrame | None = None) -> DataFrame:
    """A5: the counters of a run, one row: when its first batch started and its last one finished, how
    many sources were planned (`planned`: batches with source_count), and what came from sources that
    are not registered (`unknown`: source_id, offers)."""
    near = ~F.col("qualifies") & (F.col("effective_discount_pct") >= near_min)
    picks = ranked.agg(F.count_if("qualifies").alias("qualified_deals"),
                       F.least(F.count_if(near), F.lit(near_limit)).alias("near_misses"))
    parts = [status_counts(coverage), offer_counts(normalized, screened), picks]
    if {"started_at", "finished_at"} <= set(coverage.columns):
        parts.append(coverage.agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at")))
    if planned is not None:
        parts.append(planned.agg(F.coalesce(F.sum("source_count"), F.lit(0)).cast("long").alias("planned_sources")))
    if unknown is not None:
        parts.append(unknown.agg(F.countDistinct("source_id").alias("unknown_sources"), F.coalesce(F.sum("offers"), F.lit(0)).alias("unknown_offers")))
    return one_row(*parts)


PLAIN_METRICS = ["success", "partial", "browser", "blocked", "failed", "raw_offers", "normalized_offers",
                 "confirmed_size_offers", "qualified_deals", "near_misses"]


def run_metrics(report: DataFrame, coverage: DataFrame) -> DataFrame:
    """(run_date, metric, value). Step counts are NULL when any source of the run lacks
    its technical path."""
    c = F.col
    marks = {"browserRecoveredSources": "browser-success", "browserProviderLimitedSources": "browser-provider-rate-limited"}
    unknown = F.bool_or(c("technical_path").isNull())
    per_run = coverage.groupBy("run_date").agg(
        F.count_if(c("parsed_offers") > 0).alias("sourcesWithProducts"),
        *[F.when(~unknown, F.count_if(sc.has_step(c("technical_path"), m))).alias(k) for k, m in marks.items()])
    wide = report.join(per_run, "run_date", "left").withColumns({
        "attemptedSources": c("attempted_sources"),
        "reachedSources": c("success") + c("partial") + c("browser"),
        "sourcesWithProducts": F.coalesce("sourcesWithProducts", F.lit(0))})
    names = ["attemptedSources", "reachedSources", "sourcesWithProducts", *marks, *PLAIN_METRICS]
    return wide.select("run_date", *[c(n).cast("long").alias(n) for n in names]).unpivot(
        "run_date", names, "metric", "value")


def complete_runs(batches: DataFrame, n: int) -> DataFrame:
    """Run dates for which all n batches are stored."""
    return batches.groupBy("run_date").agg(F.count_distinct("batch").alias("batch_count")).where(
        F.col("batch_count") == n)


def snapshot_stats(snapshots: DataFrame, now, hours: int = fv.SNAPSHOT_MAX_AGE_HOURS) -> DataFrame:
    """Fresh snapshots, those with offers, newest time (one row)."""
    from .ranking import fresh
    return fresh(snapshots, "collected_at", now, F.expr(f"INTERVAL {hours} HOURS")).agg(
        F.count(F.lit(1)).alias("fresh_snapshots"), F.count_if(F.col("offers") > 0).alias("snapshots_with_offers"),
        F.max("collected_at").alias("latest_collected_at"))


def source_quality(coverage: DataFrame) -> DataFrame:
    """A10 (one row)."""
    return coverage.agg(
        F.count_if(F.col("priced_offers") > 0).alias("usable_sources"),
        F.count_if(F.col("verified_reference_offers") > 0).alias("verified_reference_sources"),
        F.count_if(F.col("available_size_offers") > 0).alias("confirmed_size_sources"),
        F.coalesce(F.sum("qualified_offers"), F.lit(0)).alias("qualified_deals"))


def arm_metrics(screened: DataFrame, minimum: float = 40) -> DataFrame:
    """Metrics per (arm, source) and the total per arm (source_id NULL). Distinct
    addresses are counted after a partial aggregation by address; totals add the per-source
    numbers, as the report does, so each row is read once."""
    c = F.col
    ok = c("reason").isNull()
    per_url = screened.groupBy("arm", "source_id", "url").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("eligible").alias("relevant"),
        F.count_if("price_evidence").alias("evidence"), F.count_if(ok).alias("normalized"),
        F.count_if(ok & (c("effective_discount_pct") >= minimum)).alias("discount40"),
        F.count_if(ok & (c("size_fit") == "confirmed")).alias("confirmed"),
        F.min(F.when(c("price") > 0, c("price"))).alias("min_price"),
        F.max(F.when(c("price") > 0, c("price"))).alias("max_price"))
    from .ranking import rank_models, ranked_only
    scope = ("arm", "source_id")
    qualified = rank_models(ranked_only(screened.where(ok), scope), minimum, scope) if "arm" in screened.columns else None
    qualified = qualified.groupBy("arm", "source_id").agg(F.count_if("qualifies").alias("qualified"))
    per_source = per_url.groupBy("arm", "source_id").agg(
        F.sum("raw").alias("raw_offers"), F.count("url").alias("unique_urls"), F.sum("relevant").alias("relevant_offers"),
        F.sum("evidence").alias("evidence_offers"), F.sum("normalized").alias("normalized_offers"),
        F.sum("discount40").alias("discount40_offers"), F.sum("confirmed").alias("confirmed_size_offers"),
        F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price")).join(
            qualified, ["arm", "source_id"], "left")
    sums = ["raw_offers", "unique_urls", "relevant_offers", "evidence_offers", "normalized_offers",
            "discount40_offers", "confirmed_size_offers"]
    return per_source.rollup("arm", "source_id").agg(
        *[F.sum(s).alias(s) for s in sums], F.coalesce(F.sum("qualified"), F.lit(0)).alias("qualified_offers"),
        F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
        F.grouping("arm").alias("_all")).where(F.col("_all") == 0).drop("_all")


def coverage_groups(coverage: DataFrame) -> DataFrame:
    """Every source with its report group and the size of the group. The five group
    sizes are a small aggregate joined back, so no group is gathered in one place."""
    c = F.col
    rows = coverage.withColumn("coverage_group", sc.coverage_group(
        c("status"), c("parsed_offers"), c("eligible_offers"), c("qualified_offers")))
    sizes = rows.groupBy("coverage_group").agg(F.count(F.lit(1)).alias("group_size"))
    g = fv.COVERAGE_GROUPS
    label = (F.when(c("coverage_group") == g["deals"], F.concat(c("name"), F.lit(" ("), c("qualified_offers").cast("string"), F.lit(")")))
             .when(c("coverage_group") == g["eligible"], F.concat(c("name"), F.lit(" ("), c("eligible_offers").cast("string"), F.lit(")")))
             .otherwise(c("name")))
    return rows.join(F.broadcast(sizes), "coverage_group").select("coverage_group", "group_size", "source_id", label.alias("label"))


def browser_step_counts(coverage: DataFrame) -> DataFrame:
    """Number of sources per technical step."""
    return coverage.select("source_id", F.explode(F.array_distinct("technical_path")).alias("step")).groupBy("step").agg(
        F.count_distinct("source_id").alias("sources"))


def batch_status(batches: DataFrame) -> DataFrame:
    """Stored batches of a run with their number of sources and offers."""
    return batches.groupBy("run_date", "batch").agg(
        F.count_distinct("source_id").alias("source_count"), F.count(F.lit(1)).alias("normalized_offers"))
