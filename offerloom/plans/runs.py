"""Batch run, publication, replay, current view, arm report.

Stored tables below one root folder:
  screened/  run_date, batch_bucket  every raw row with its batch, reason and normalized columns
  coverage/  run_date, batch_bucket  one row per source, with its batch and the times of that
  unknown/   run_date, batch   offers per source that is not registered, under the first batch of the call
  ranked/    run_date          one row per model, with keys and `qualifies`
  report/, deals/, near/   run_date
  history/   run_date          per offer key its prices up to this run
A result that several steps use is written once and read back, so a lost executor costs a
re-read and not the whole lineage."""
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..operators import aggregates as ag
from ..operators import history as hi
from ..operators import joins as jo
from ..operators import normalize as no
from ..operators import ranking as rk
from ..operators import sinks as sk
from ..settings import DEFAULT, Profile
from ..sources.reference import stored
from ..storage import stored as written

c = F.col


@dataclass
class Published:
    complete: bool
    missing: DataFrame
    report: DataFrame | None = None
    metrics: DataFrame | None = None
    deals: DataFrame | None = None
    near: DataFrame | None = None
    sources: DataFrame | None = None


def _screened(spark: SparkSession, root: str, run_date) -> DataFrame:
    """The stored rows of a run. Rows without a source only mark batches that sent nothing."""
    return stored(spark, f"{root}/screened", run_date).where(c("source_id").isNotNull())


def _time(at):
    """A time as a constant; now, unless one is given."""
    at = dt.datetime.now(dt.timezone.utc) if at is None else at
    return F.lit(at).cast("timestamp")


def _unknown(spark: SparkSession, root: str, run_date) -> DataFrame:
    return stored(spark, f"{root}/unknown", run_date)


def run_batch(raw: DataFrame, crawl: DataFrame, root: str, run_date, snapshots: DataFrame | None = None,
              source_brands: DataFrame | None = None, policies: DataFrame | None = None,
              rates: DataFrame | None = None, now=None, profile: Profile = DEFAULT, started_at=None, finished_at=None) -> DataFrame:
    """J4 -> J1 -> J3 -> P1/P2 -> K1, then A2/A3/F31 from the stored rows. `raw` and
    `crawl` carry `batch`. Running it again replaces the same partitions. Rows of sources that
    `crawl` does not name are counted per source and belong to no batch. The times of the batch are
    those of this call unless given. Returns coverage."""
    spark = raw.sparkSession
    started_at = _time(started_at)
    crawl = written(crawl, "crawl")  # read six times, and of a size that Catalyst knows
    sent = raw.select("source_id")
    batch_of = crawl.select("source_id", c("batch").alias("_batch"))
    if snapshots is not None:
        fresh = rk.latest_snapshot(snapshots, now).drop("collected_at")
        sent = sent.union(fresh.select("source_id"))
        raw = jo.merge_snapshot(raw, fresh)
        added = jo.snapshot_counters(raw).select("source_id", "added")
        crawl = crawl.join(added, "source_id", "left").withColumn("status", F.when(
            c("status").isin("failed", "blocked") & (c("added") > 0), F.lit("browser")).otherwise(c("status"))).drop("added")
    if source_brands is not None:
        raw = jo.enrich_source_brand(raw, source_brands)
    if policies is not None:
        raw = jo.apply_shipping(raw, policies)
    touched = crawl.select("batch").distinct()
    registered = jo.lookup_join(raw.drop("batch"), batch_of, "source_id", "url", "inner")
    screened = no.screen_offers(registered, profile, rates)
    strange = jo.anti_by_key(raw.select("source_id"), crawl, ["source_id"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("offers"))
    first = touched.agg(F.min("batch")).first()[0]
    if first is not None:
        sk.replace_one(strange, f"{root}/unknown", run_date=str(run_date), batch=first)
    # A batch whose sources sent nothing replaces its stored rows, too: with a row without a source
    silent = touched.join(jo.semi_by_key(crawl, sent, ["source_id"]).select("batch").distinct(), "batch", "left_anti")
    sk.write_batch(jo.union_all(screened.withColumnRenamed("_batch", "batch"), silent), f"{root}/screened", run_date, batches=touched)
    rows = _screened(spark, root, run_date)
    coverage = ag.source_coverage(rows.join(touched, "batch", "left_semi"), crawl, profile.min_discount)
    coverage = coverage.withColumns({"started_at": started_at, "finished_at": _time(finished_at)})
    sk.write_batch(coverage, f"{root}/coverage", run_date, batches=touched)
    return stored(spark, f"{root}/coverage", run_date)


def _selection(rows: DataFrame, hidden: DataFrame | None, profile: Profile):
    normalized = no.accepted(rows)
    kept = no.rescreen(normalized, hidden)
    return normalized, kept, rk.rank_models(kept, profile.min_discount)


def finalize_run(spark: SparkSession, root: str, run_date, expected: DataFrame, hidden: DataFrame | None = None,
                 profile: Profile = DEFAULT, snapshot_at=None) -> Published:
    """J12 -> U1 -> P3/J5 -> L1 -> A5 -> W7 -> A6/A7/J9 -> K2. Publishes nothing while a
    batch is missing."""
    coverage = stored(spark, f"{root}/coverage", run_date)
    done = coverage.groupBy("batch").agg(F.count(F.lit(1)).alias("source_count"))
    missing = jo.missing_batches(expected, done)
    if not missing.isEmpty():
        return Published(False, missing)
    saved = _saved(spark, root, run_date, snapshot_at)
    if saved is not None:
        return Published(True, missing, *saved)
    normalized, kept, ranked = _selection(_screened(spark, root, run_date), hidden, profile)
    sk.write_run({"ranked": ranked}, root, run_date)
    ranked = stored(spark, f"{root}/ranked", run_date)
    report = ag.run_report(coverage, normalized, kept, ranked, profile.near_min, profile.near_limit, expected, _unknown(spark, root, run_date))
    report = report.withColumn("batch_snapshot_at", F.coalesce(F.lit(snapshot_at).cast("timestamp"), "finished_at"))
    previous = _previous(spark, root, run_date, snapshot_at)
    report = report.withColumn("baseline_date", F.lit(previous).cast("date"))
    sk.write_run({"report": report, "deals": rk.deals_of(ranked), "near": rk.near_of(ranked, profile)}, root, run_date)
    _keep_history(spark, root, run_date)
    return Published(True, missing, *_results(spark, root, run_date, previous))


def _results(spark, root, run_date, previous):
    """What a stored run publishes: report, metrics, deals, near misses, sources."""
    coverage, report = stored(spark, f"{root}/coverage", run_date), stored(spark, f"{root}/report", run_date)
    metrics, sources = ag.run_metrics(report, coverage), coverage
    if previous is not None and str(previous) != str(run_date):
        old = stored(spark, f"{root}/coverage", previous)
        metrics = hi.compare_runs(metrics, ag.run_metrics(stored(spark, f"{root}/report", previous), old)).withColumn(
            "baseline_kind", hi.comparison_kind(F.lit(str(run_date)), F.lit(str(previous))))
        sources = hi.compare_sources(coverage, old)
    return report, metrics, stored(spark, f"{root}/deals", run_date), stored(spark, f"{root}/near", run_date), sources


def _saved(spark, root, run_date, snapshot_at):
    """The published results of a run date whose batches have not changed since: a run that is
    finalized again for the same snapshot is not computed and not written again."""
    if snapshot_at is None:
        return None
    try:
        report = stored(spark, f"{root}/report", run_date)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    row = report.where(c("batch_snapshot_at") == F.lit(snapshot_at).cast("timestamp")).select("baseline_date").first()
    return _results(spark, root, run_date, row["baseline_date"]) if row else None


def _previous(spark, root, run_date, snapshot_at):
    """The run to compare with, one small row."""
    try:
        saved = spark.read.parquet(f"{root}/report")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    row = hi.baseline_of(saved.select("run_date", "batch_snapshot_at", "baseline_date"),
                         F.lit(run_date).cast("date"), snapshot_at).first()
    return row["baseline"] if row else None


def replay_latest(spark: SparkSession, root: str, batches: int, hidden: DataFrame | None = None,
                  profile: Profile = DEFAULT) -> Published | None:
    """The report of the newest complete day, recomputed from stored rows; writes
    nothing. Hidden models stay unless `hidden` is given."""
    coverage = spark.read.parquet(f"{root}/coverage")
    day = rk.latest(ag.complete_runs(coverage.select("run_date", "batch"), batches), "run_date", 1).first()
    if day is None:
        return None
    day = day["run_date"]
    cov = stored(spark, f"{root}/coverage", day)
    normalized, kept, ranked = _selection(_screened(spark, root, day), hidden, profile)
    report = ag.run_report(cov, normalized, kept, ranked, profile.near_min, profile.near_limit).withColumn(
        "run_date", F.lit(day))
    return Published(True, cov.limit(0), report, ag.run_metrics(report, cov), rk.deals_of(ranked),
                     rk.near_of(ranked, profile), cov)


def _published(spark: SparkSession, root: str) -> DataFrame:
    return jo.union_all(spark.read.parquet(f"{root}/deals"), spark.read.parquet(f"{root}/near"))


def _days(spark: SparkSession, root: str, table: str) -> list[str]:
    """Run dates of a stored table, oldest first."""
    try:
        found = spark.read.parquet(f"{root}/{table}").select("run_date").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted(str(r[0]) for r in found.collect())


def _keep_history(spark: SparkSession, root: str, run_date) -> None:
    """The price history after this run, from the state of the run before and this run's prices.
    A run that is published again replaces its own state; states of later runs are stale then and
    are made again, each from the one before."""
    day = str(run_date)
    later = [x for x in _days(spark, root, "report") if x > day]
    known = set(_days(spark, root, "history"))
    before = [x for x in _days(spark, root, "report") if x < day]
    start = [x for x in before if x not in known] or [day]
    for now in [x for x in before if x >= start[0]] + [day] + later:
        old = max((x for x in {*before, day, *later} if x < now), default=None)
        rows = _published(spark, root).where(c("run_date") == F.lit(now).cast("date"))
        points = hi.history_points(rows)
        sk.write_run({"history": hi.merged_history(stored(spark, f"{root}/history", old).drop("run_date") if old else None, points, now)}, root, now)


def current_view(spark: SparkSession, root: str, hidden: DataFrame | None = None, profile: Profile = DEFAULT):
    """Deals and near misses of the latest run judged by the current rules, each with the
    change of its price over the stored runs. The change comes from the kept history of the latest
    run, of which only the keys that are shown are joined. Returns (deals, near)."""
    day = rk.latest(spark.read.parquet(f"{root}/report").select("run_date"), "run_date", 1).first()["run_date"]
    now = _published(spark, root).where(c("run_date") == F.lit(day))
    deals, near = rk.select_deals(no.rescreen(now.drop("qualifies", "first_seq", "model_seq", "reason"), hidden), profile)
    change = hi.change_of(stored(spark, f"{root}/history", day))
    return tuple(x.join(jo.semi_by_key(change, x, ["offer_key"]), "offer_key", "left").orderBy(F.desc("score"), F.asc("model_seq"))
                 for x in (deals, near))


def publish_by(ranked: DataFrame, scope, profile: Profile = DEFAULT) -> DataFrame:
    """Deals and near misses of many runs (or arms) at once: per scope all deals and the first
    near misses. `list` is deal or near."""
    ranked = written(ranked, "ranked")  # read twice
    near = ranked.where(~c("qualifies") & (c("effective_discount_pct") >= profile.near_min))
    near = rk.top_per_group(near, scope, [F.desc("score"), F.asc("model_seq")], profile.near_limit)
    return jo.union_all(ranked.where("qualifies").withColumn("list", F.lit("deal")), near.withColumn("list", F.lit("near")))


def ab_report(screened: DataFrame, profile: Profile = DEFAULT):
    """(metrics per arm and source, source comparison, selection per arm) of rows with `arm`."""
    rows = written(screened, "arms")  # read by the metrics and by the selection; only accepted rows need keys
    metrics = ag.arm_metrics(rows, profile.min_discount)
    picks = publish_by(rk.rank_models(no.accepted(rows), profile.min_discount, ("arm",)), ["arm"], profile)
    return metrics, hi.compare_arms(metrics), picks
