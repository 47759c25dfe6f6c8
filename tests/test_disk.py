"""What a stored run leaves on the way: no shuffle of whole rows, no columns that nobody reads."""
import glob

import pytest
from pyspark.sql import functions as F

from helpers import normalized, values
from offerloom.checks import core, history, views
from offerloom.operators import ranking as rk
from offerloom.operators import sinks as sk
from offerloom.streaming import observations as ob

c = F.col
DAY = "2024-01-03"


@pytest.fixture
def hints(spark, monkeypatch):
    """The names of all hints given."""
    frame = type(spark.range(1))
    given, hint = [], frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, name, *more: given.append(name) or hint(self, name, *more))
    return given


def test_batches_are_written_by_the_tasks_that_made_them(spark, tmp_path, hints):
    path = f"{tmp_path}/t"
    rows = spark.range(0, 400, 1, 3).select((c("id") % 40).cast("int").alias("batch"), c("id").alias("x"))
    sk.write_batch(rows, path, DAY)
    sk.write_batch(rows.where("batch < 3").withColumn("x", c("x") + 1000), path, DAY, batches=spark.range(4).select(c("id").cast("int").alias("batch")))
    assert "rebalance" not in hints
    got = spark.read.parquet(path)
    assert sorted(values(got, "batch", "x")) == sorted((i % 40, i + 1000 * (i % 40 < 3)) for i in range(400) if i % 40 != 3)
    assert len(glob.glob(f"{path}/run_date=*/{sk.BUCKET}=*")) <= sk.BATCH_BUCKETS
    for f in glob.glob(f"{path}/*/*/*.parquet"):
        found = [r[0] for r in spark.read.parquet(f).select("batch").collect()]
        assert found == sorted(found)


def test_rows_of_many_dates_are_gathered_by_folder(spark, tmp_path, hints):
    rows = spark.range(30).select((c("id") % 3).cast("int").alias("batch"), F.date_add(F.lit(DAY).cast("date"), c("id").cast("int")).alias("run_date"), "id")
    sk.write_batch(rows, f"{tmp_path}/t")
    assert "rebalance" in hints and spark.read.parquet(f"{tmp_path}/t").count() == 30


def test_best_rows_of_a_micro_batch_are_not_dealt_again(spark, tmp_path, hints):
    offers = normalized(spark, dict(score=70), dict(score=90), dict(url="https://s1.example/p/2", name="Runbold Beta Pants"))
    offers.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(offers.schema).parquet(f"{tmp_path}/in")
    ob.select_deals_stream(stream, f"{tmp_path}/best", f"{tmp_path}/checkpoint").awaitTermination()
    assert "rebalance" not in hints
    assert sorted(values(ob.stream_models(spark.read.parquet(f"{tmp_path}/best")), "score")) == [(80,), (90,)]


def test_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/lineitem.parquet"
    spark.range(5000).select(c("id").alias("l_orderkey")).coalesce(1).write.parquet(path)
    monkeypatch.setattr(views, "ROWS_PER_TASK", 100)
    sizes = views.shared(spark, str(tmp_path), "SELECT l_orderkey FROM {lineitem}").rdd.glom().map(len).collect()
    assert len(sizes) == 50 and sum(sizes) == 5000
    assert len(views.shared(spark, str(tmp_path), "SELECT l_orderkey FROM {lineitem}", 70).rdd.glom().collect()) == 70


def test_rankings_carry_what_is_shown(spark, monkeypatch):
    rows = normalized(spark, dict(), dict(score=90, effective_discount_pct=35.0, name="Runbold Beta Pants", url="https://s1.example/p/2"))
    rows = rows.withColumns({"description": F.lit("UNREAD"), "reason": F.lit(None).cast("string"), "run_date": F.lit("2024-01")})
    kept = []
    ranked = rk.rank_models
    monkeypatch.setattr(rk, "rank_models", lambda offers, *more: kept.append(offers.columns) or ranked(offers, *more))
    monkeypatch.setattr(core, "offers", lambda spark, d: rows)
    monkeypatch.setattr(history, "monthly", lambda spark, d: rows)
    monkeypatch.setattr(history, "table", lambda spark, d, name: spark.createDataFrame([("1998-01-01",)], "l_shipdate string"))
    near = core.near_misses(spark, "")
    assert values(near, "score", "effective_discount_pct") == [(90, 35.0)]
    assert sorted(values(history.price_steps(spark, ""), "run_date", "price")) == [("2024-01", 50.0), ("2024-01", 50.0)]
    assert kept and not any("description" in x or "name" in x for x in kept)
