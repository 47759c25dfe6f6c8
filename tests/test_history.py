"""Kept price history against the plain aggregation over all runs."""
import random

from pyspark.sql import functions as F

from helpers import raw
from offerloom.operators import history as hi
from offerloom.plans import runs

DAYS = ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]


def _points(spark, rows):
    return spark.createDataFrame(rows, "offer_key string, run_date string, price double").withColumns(
        {"run_date": F.to_date("run_date"), "seq": F.lit(1)})


def test_steps_and_lows(spark):
    rows = [("a", d, p) for d, p in zip(DAYS, (10.0, 8.0, 9.0, 7.0))] + [("b", DAYS[1], 5.0)]
    got = {(r.offer_key, str(r.run_date)): (r.previous_price, r.step, r.lowest_before, r.new_low) for r in hi.price_steps(_points(spark, rows)).collect()}
    assert got == {("a", DAYS[0]): (None, None, None, False), ("a", DAYS[1]): (10.0, -2.0, 10.0, True), ("a", DAYS[2]): (8.0, 1.0, 8.0, False),
                   ("a", DAYS[3]): (9.0, -2.0, 8.0, True), ("b", DAYS[1]): (None, None, None, False)}


def test_kept_state_equals_all_runs(spark):
    r = random.Random(3)
    rows = [(f"k{k}", d, float(r.randrange(5, 20))) for k in range(12) for d in DAYS if r.random() < 0.6]
    points, state = _points(spark, rows), None
    for d in DAYS:
        state = hi.merged_history(state, points.where(F.col("run_date") == d), d)
    plain = {x.offer_key: x for x in hi.price_change(points).collect()}
    got = hi.change_of(state).collect()
    assert len(got) == len(plain)
    for x in got:
        assert x.asDict() == {k: v for k, v in plain[x.offer_key].asDict().items()}
    lists = {x.offer_key: [(str(p.date), p.price) for p in x.points] for x in state.collect()}
    assert lists == {k: sorted((d, p) for q, d, p in rows if q == k) for k in {q for q, _, _ in rows}}


def _publish(spark, root, day, prices):
    offers = raw(spark, *[dict(url=f"https://s1.example/p/{k}", name=f"Model {k} Trekking Pants", price=p) for k, p in prices.items()])
    crawl = spark.createDataFrame([("s1", "Shop", "success", 0)], "source_id string, name string, status string, batch int").withColumn("technical_path", F.array().cast("array<string>"))
    runs.run_batch(offers, crawl, root, day)
    return runs.finalize_run(spark, root, day, spark.createDataFrame([(0, 1)], "batch int, source_count long"))


def _view(spark, root):
    return {x.name[6]: (x.observations, x.first_price, x.last_price, x.previous_price, x.lowest_before) for x in runs.current_view(spark, root)[0].collect()}


def test_a_run_published_again_changes_later_states(spark, tmp_path):
    root = str(tmp_path / "run")
    _publish(spark, root, DAYS[0], {1: 50.0, 2: 40.0})
    _publish(spark, root, DAYS[2], {1: 45.0, 2: 42.0})
    assert _view(spark, root) == {"1": (2, 50.0, 45.0, 50.0, 50.0), "2": (2, 40.0, 42.0, 40.0, 40.0)}
    _publish(spark, root, DAYS[1], {1: 30.0})
    assert _view(spark, root) == {"1": (3, 50.0, 45.0, 30.0, 30.0), "2": (2, 40.0, 42.0, 40.0, 40.0)}
    _publish(spark, root, DAYS[2], {1: 44.0})
    assert _view(spark, root) == {"1": (3, 50.0, 44.0, 30.0, 30.0)}


def test_the_view_reads_one_state(spark, tmp_path):
    root = str(tmp_path / "run")
    for d, p in zip(DAYS, (50.0, 49.0, 48.0)):
        _publish(spark, root, d, {1: p})
    plan = runs.current_view(spark, root)[0]._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("ReadSchema")[0] for x in plan.split("FileScan")[1:] if "observations#" in x.split("]")[0]]
    assert scans and all(f"= {DAYS[2]}" in x.split("PartitionFilters")[1] for x in scans)
