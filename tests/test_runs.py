import datetime as dt

from pyspark.sql import functions as F

from helpers import raw, values
from offerloom.operators import history as hi
from offerloom.operators import sinks as sk
from offerloom.plans import collect, runs
from offerloom.sources.reference import stored

c = F.col
DAY1, DAY2 = "2024-01-02", "2024-01-03"


def _inputs(spark, price=40.0):
    rows = [dict(source_id=f"s{i % 3}", url=f"https://s{i % 3}.example/p/{i}", name=f"Model {i} Trekking Pants", price=price + i) for i in range(12)]
    crawl = spark.createDataFrame([("s0", "Shop 0", "success", 0), ("s1", "Shop 1", "blocked", 0), ("s2", "Shop 2", "success", 1), ("s3", "Shop 3", "failed", 1)],
                                  "source_id string, name string, status string, batch int").withColumn(
        "technical_path", F.when(c("source_id") == "s0", F.array(F.lit("browser-success"))).otherwise(F.array().cast("array<string>")))
    expected = spark.createDataFrame([(0, 2), (1, 2)], "batch int, source_count long")
    return raw(spark, *rows), crawl, expected


def _files(path):
    import glob
    return sorted(glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_run_twice_changes_nothing_and_publishes(spark, tmp_path):
    root = str(tmp_path / "run")
    offers, crawl, expected = _inputs(spark)
    cols = ["source_id", "status", "parsed_offers", "priced_offers", "qualified_offers", "diagnostic_code"]
    first = sorted(map(str, values(runs.run_batch(offers, crawl, root, DAY1), *cols)))
    again = sorted(map(str, values(runs.run_batch(offers, crawl, root, DAY1), *cols)))
    assert first == again and len(first) == 4 and "parser-empty" in first[3]
    one = runs.finalize_run(spark, root, DAY1, expected)
    assert one.complete and one.deals.count() == 12 and one.near.count() == 0
    # The next day is dearer; its report is compared with the day before.
    dear, _, _ = _inputs(spark, 52.0)
    runs.run_batch(dear, crawl, root, DAY2)
    two = runs.finalize_run(spark, root, DAY2, expected, snapshot_at="2024-01-03 09:00:00")
    metrics, deals_now = sorted(values(two.metrics, "metric", "delta"), key=str), two.deals.count()
    delta = dict(metrics)
    assert delta["qualified_deals"] == deals_now - 12 and delta["raw_offers"] == 0 and delta["browserRecoveredSources"] == 0
    assert values(two.metrics.select("baseline_kind").distinct(), "baseline_kind") == [("previous-day",)]
    before = _files(f"{root}/deals")
    retry = runs.finalize_run(spark, root, DAY2, expected, snapshot_at="2024-01-03 09:00:00")
    assert _files(f"{root}/deals") == before  # the same snapshot is not written again
    assert sorted(values(retry.metrics, "metric", "delta"), key=str) == metrics
    deals, near = runs.current_view(spark, root)
    got = values(deals, "observations", "first_price", "last_price")
    assert got and all(n == 2 and last - first == 12.0 for n, first, last in got)
    replay = runs.replay_latest(spark, root, 2)
    assert replay.deals.count() == deals_now and replay.report.first()["run_date"] == dt.date(2024, 1, 3)
    assert runs.replay_latest(spark, root, 3) is None


def test_incomplete_run_is_not_published(spark, tmp_path):
    root = str(tmp_path / "run")
    offers, crawl, expected = _inputs(spark)
    runs.run_batch(offers.where("source_id <> 's2'"), crawl.where("batch = 0"), root, DAY1)
    out = runs.finalize_run(spark, root, DAY1, expected)
    assert not out.complete and values(out.missing, "batch") == [(1,)] and not _files(f"{root}/deals")


def test_a_batch_that_became_empty_replaces_its_rows(spark, tmp_path):
    root = str(tmp_path / "run")
    offers, crawl, _ = _inputs(spark)
    runs.run_batch(offers, crawl, root, DAY1)
    cov = runs.run_batch(offers.where("source_id <> 's2'"), crawl, root, DAY1)
    assert dict(values(cov, "source_id", "parsed_offers")) == {"s0": 4, "s1": 4, "s2": 0, "s3": 0}


def test_one_batch_replaces_only_its_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(20).select(c("id"), (c("id") % 2).cast("int").alias("batch"))
    sk.write_batch(df, path, DAY1)
    sk.write_batch(df.where("batch = 1").withColumn("id", c("id") + 100), path, DAY1)
    got = spark.read.parquet(path)
    assert got.count() == 20 and got.where("id >= 100").count() == 10 and got.where("batch = 0 and id < 100").count() == 10


def test_snapshot_upsert(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", "2024-01-01 05:00:00", 1), ("a", "2024-01-01 05:00:00", 2), ("b", "2024-01-01 06:00:00", 3), ("a", "2024-01-02 05:00:00", 4)],
                                 "source_id string, at string, x int").withColumn("collected_at", c("at").cast("timestamp")).drop("at")
    sk.write_snapshots(rows, path)
    sk.write_snapshots(rows.where("x = 1").withColumn("x", F.lit(9)), path)
    assert sorted(values(spark.read.parquet(path), "source_id", "x")) == [("a", 4), ("a", 9), ("b", 3)]


def test_hide_events(spark):
    hidden = spark.createDataFrame([("a", "A", "2024-01-01"), ("b", "B", "2024-01-01")], "hide_key string, label string, d string").withColumn("hidden_at", c("d").cast("timestamp"))
    ev = spark.createDataFrame([("a", "A2", "hide", "2024-01-03"), ("b", "", "unhide", "2024-01-02"), ("c", "C", "hide", "2024-01-02"), ("b", "B2" * 200, "hide", "2024-01-05")],
                               "hide_key string, label string, action string, d string").withColumn("at", c("d").cast("timestamp"))
    got = {r["hide_key"]: (r["label"], r["hidden_at"].day) for r in sk.apply_hide_events(hidden, ev).collect()}
    assert got["a"] == ("A2", 1) and got["c"] == ("C", 2) and got["b"][1] == 5 and len(got["b"][0]) == 400


def test_history_of_last_runs(spark):
    rows = [(f"k{i % 2}", f"2024-01-{d:02d}", float(d), d, "u") for d in range(1, 6) for i in range(2)]
    pub = spark.createDataFrame(rows, "offer_key string, run_date string, effective_cost_eur double, seq long, url string")
    pts = hi.history_points(pub, n=3)
    assert sorted(values(hi.price_change(pts), "offer_key", "observations", "first_price", "last_price")) == [("k0", 3, 3.0, 5.0), ("k1", 3, 3.0, 5.0)]
    assert [p["date"] for p in hi.price_history(pts).first()["points"]] == ["2024-01-03", "2024-01-04", "2024-01-05"]


def test_unknown_step_counts_stay_unknown(spark):
    now = spark.createDataFrame([("m", None), ("n", 3)], "metric string, value long")
    old = spark.createDataFrame([("m", 2), ("n", None)], "metric string, value long")
    assert sorted(values(hi.compare_runs(now, old), "metric", "current", "previous", "delta")) == [("m", 0, 2, -2), ("n", 3, None, None)]


def test_ladder(spark):
    states = spark.createDataFrame([("p", "P", 1, False, True), ("a", "A", 3, False, False), ("l", "L", 3, False, False), ("g", "G", 1, False, False), ("b", "B", 1, True, False), ("x", "X", 0, False, False)],
                                   "source_id string, name string, discovered_urls int, blocked boolean, is_post_source boolean")
    def rows(ids, **kw):
        return raw(spark, *[dict(source_id=i, url=f"https://{i}.example/{k}", **kw) for k, i in enumerate(ids)], extra={"page_id": "long"})
    bare = dict(rrp=None, rrp_source=None)
    offers, cov = collect.collect_offers(states, posts=rows(["p", "a"]), shop_api=rows(["a"]), listings=rows(["l", "g", "a"], **bare).union(rows(["l"])), json_feed=None,
                                         jsonld=rows(["g", "l", "p"]), cards=rows(["g", "b"], name="Rucksack", **bare))
    assert sorted(set(values(offers, "source_id", "rung"))) == [("a", "shop-api"), ("b", "card"), ("g", "card"), ("g", "json-ld"), ("g", "listing"), ("l", "listing"), ("p", "posts")]
    assert dict(values(cov, "source_id", "status")) == {"p": "success", "a": "success", "l": "success", "g": "partial", "b": "blocked", "x": "failed"}


def test_folders_do_not_grow_with_the_batches(spark, tmp_path):
    path = str(tmp_path / "many")
    df = spark.range(4000).select("id", (c("id") % 500).cast("int").alias("batch"))
    sk.write_batch(df, path, DAY1)
    folders = list((tmp_path / "many" / f"run_date={DAY1}").iterdir())
    assert len(folders) <= sk.BATCH_BUCKETS
    # one batch is written again: those that share its folder stay, also with the batches named
    sk.write_batch(df.where("batch = 7").withColumn("id", c("id") + 10000), path, DAY1)
    sk.write_batch(df.where("batch = 8").limit(1), path, DAY1, batches=spark.createDataFrame([(8,)], "batch int"))
    got = stored(spark, path, DAY1)
    assert got.columns == ["id", "batch", "run_date"] and got.count() == 4000 - 7
    assert got.where("batch = 7 and id >= 10000").count() == 8 and got.where("batch = 8").count() == 1
    assert stored(spark, path, before=DAY2, batches=[7, 8]).count() == 9


def test_rows_without_a_batch_are_replaced_too(spark, tmp_path):
    path = str(tmp_path / "nulls")
    df = spark.createDataFrame([(1, None), (2, None), (3, 4)], "id int, batch int")
    sk.write_batch(df, path, DAY1)
    sk.write_batch(df.where("id = 2"), path, DAY1)
    sk.write_batch(df.where("id = 1"), path, DAY2)
    assert sorted(values(spark.read.parquet(path).withColumn("d", c("run_date").cast("string")), "id", "d")) == [(1, DAY2), (2, DAY1), (3, DAY1)]
