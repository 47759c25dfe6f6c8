import datetime as dt

from pyspark.sql import functions as F

from helpers import values
from offerloom.streaming import observations as ob

c = F.col
T0 = dt.datetime(2024, 1, 1)


def _files(spark, path, parts):
    """One parquet file per micro-batch, oldest first."""
    for i, rows in enumerate(parts):
        df = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), p) for k, h, p in rows], "offer_key string, ts timestamp, price double")
        df.coalesce(1).write.mode("append").parquet(path)


def _stream(spark, tmp_path, parts):
    path = str(tmp_path / "in")
    _files(spark, path, parts)
    schema = spark.read.parquet(path).schema
    return ob.read_observations(spark, path, schema, max_files=1)


def _run(stream, tmp_path, mode="update"):
    ob.write_versions(stream, str(tmp_path / "out"), str(tmp_path / "ck"), mode).awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / "out"))


PARTS = [[("a", 1, 10.0), ("b", 2, 20.0), ("a", 3, 9.0)], [("a", 4, 8.0), ("c", 5, 5.0)], [("b", 60, 25.0), ("c", 61, 4.0)]]


def test_repeated_observation_counts_once(spark, tmp_path):
    out = _run(ob.dedupe_stream(_stream(spark, tmp_path, [PARTS[0], PARTS[1]])), tmp_path, "append")
    assert sorted(values(out, "offer_key")) == [("a",), ("b",), ("c",)]


def test_latest_state_expires(spark, tmp_path):
    keys = ["offer_key"]
    t = _run(ob.latest_offer_state(_stream(spark, tmp_path, PARTS), keys, ["price"]), tmp_path)
    assert sorted(values(ob.current_state(t, keys, "2024-01-03 14:00:00"), "offer_key", "price")) == [("b", 25.0), ("c", 4.0)]
    assert sorted(values(ob.current_state(t, keys, "2024-01-01 06:00:00"), "offer_key"))[0] == ("a",)


def test_price_drops(spark, tmp_path):
    t = _run(ob.price_moves(_stream(spark, tmp_path, PARTS), ["offer_key"]), tmp_path)
    alerts = ob.price_drop_alerts(ob.newest_versions(t, ["offer_key", "slot"]))
    assert sorted(values(alerts, "offer_key", "first_price", "last_price")) == [("a", 10.0, 8.0), ("c", 5.0, 4.0)]


def test_daily_counters_equal_batch(spark, tmp_path):
    s = _stream(spark, tmp_path, PARTS)
    t = ob.newest_versions(_run(ob.coverage_by_window(s, ["offer_key"], value="price"), tmp_path), ["run_date", "offer_key"])
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy(F.to_date("ts").alias("run_date"), "offer_key").count()
    assert sorted(values(t, "run_date", "offer_key", "parsed_offers")) == sorted(values(batch, "run_date", "offer_key", "count"))


def test_late_rows_are_marked(spark, tmp_path):
    t = _run(ob.late_rows(_stream(spark, tmp_path, PARTS), "2024-01-12 02:00:00"), tmp_path, "append")
    assert t.where("late").count() == 5 and t.count() == 7
