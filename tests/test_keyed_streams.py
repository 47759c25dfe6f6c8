"""State per key: results don't depend on the order of arrival or on the cut into micro-batches."""
import datetime as dt
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerloom.storage import ship
from offerloom.streaming import keyed as ky
from offerloom.streaming import observations as ob

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "offer_key string, ts timestamp, price double"
KEYS = ["offer_key"]


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def _table(spark, tmp_path, parts, make, name="t", **more):
    path = str(tmp_path / name)
    for rows in parts:
        spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), p) for k, h, p in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = ob.read_observations(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, max_files=1)
    with ky.keyed_store(spark):
        running = ob.write_versions(make(stream), f"{path}/out", f"{path}/ck", **more)
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _hours(ts):
    return round((ts - T0).total_seconds() / 3600, 3)


def _lives(table):
    return sorted((r.offer_key, _hours(r.first_seen), _hours(r.last_seen), r.observations, r.price, r.state) for r in ky.newest_lifetimes(table, KEYS).collect())


def test_an_offer_lives_for_a_time_after_its_own_last_observation(spark, tmp_path):
    parts = [[("a", 0, 10.0), ("b", 1, 5.0), ("a", 20, 9.0)], [("b", 40, 6.0), ("a", 49, 8.0)], [("c", 120, 1.0), ("a", 100, 7.0)]]
    t = _table(spark, tmp_path, parts, lambda s: ky.offer_lifetimes(s, KEYS, ["price"]))
    assert _lives(t) == [("a", 0, 49, 3, 8.0, "expired"), ("a", 100, 100, 1, 7.0, "live"), ("b", 1, 1, 1, 5.0, "expired"),
                         ("b", 40, 40, 1, 6.0, "expired"), ("c", 120, 120, 1, 1.0, "live")]
    ends = {(r.offer_key, _hours(r.first_seen)): _hours(r.expires_at) for r in ky.newest_lifetimes(t, KEYS).collect()}
    assert ends["a", 0] == 79 and ends["b", 1] == 31


def test_a_late_row_joins_two_lifetimes(spark, tmp_path):
    parts = [[("a", 0, 10.0), ("a", 40, 9.0)], [("a", 20, 8.0)], [("z", 41, 1.0)]]
    t = _table(spark, tmp_path, parts, lambda s: ky.offer_lifetimes(s, KEYS, ["price"]))
    assert ("a", 0, 40, 3, 9.0, "live") in _lives(t) and len(_lives(t)) == 2
    assert t.where("state = 'merged'").count() == 1


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    parts = [[("a", 0, 10.0)], [("a", 200, 9.0)], [("b", 300, 1.0)], [("a", 1, 3.0), ("b", 301, 2.0)]]
    t = _table(spark, tmp_path, parts, lambda s: ky.offer_lifetimes(s, KEYS, ["price"]))
    assert ("a", 0, 0, 1, 10.0, "expired") in _lives(t)
    drops = _table(spark, tmp_path, parts + [[("b", 500, 0.5)]], lambda s: ky.price_drops(s, KEYS), "drops")
    assert [(r.offer_key, _hours(r.ts), r.previous_price, r.price) for r in drops.collect()] == [("a", 200, 10.0, 9.0)]


def test_a_busy_offer_is_combined_before_the_shuffle():
    us = [h * 3_600_000_000 for h in (0, 5, 60, 61, 62)]
    b = pa.RecordBatch.from_pydict({"offer_key": ["a", "a", "a", "a", None], "first_us": us, "last_us": us, "observations": [1] * 5, "price": [1.0, None, 3.0, 4.0, 5.0]})
    out = next(ky._combined(KEYS, ["price"], 30 * 3_600_000_000)(iter([b]))).to_pylist()
    assert sorted((r["offer_key"] or "", r["first_us"] // us[1] * 5, r["observations"], r["price"]) for r in out) == [("", 60, 1, 5.0), ("a", 0, 2, None), ("a", 60, 2, 4.0)]


def test_any_order_and_cut_give_the_same_state(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"k{r.randrange(4)}", h + r.random(), float(r.randrange(5, 50))) for h in range(0, 240, 3)]
    shuffled = sorted(rows, key=lambda x: x[1] + r.uniform(0, 12))  # late by at most half a day
    end = [("end", 400, 1.0)]
    lives, drops = [], []
    for n, order in ((2, rows), (5, shuffled)):
        parts = [order[k * len(order) // n:(k + 1) * len(order) // n] for k in range(n)] + [end]
        lives.append(_lives(_table(spark, tmp_path, parts, lambda s: ky.offer_lifetimes(s, KEYS, ["price"]), f"l{n}")))
        found = _table(spark, tmp_path, parts, lambda s: ky.price_drops(s, KEYS), f"d{n}").collect()
        drops.append(sorted((x.offer_key, x.ts, x.previous_price, x.price, x.lowest) for x in found))
    assert lives[0] == lives[1] and drops[0] == drops[1]
    expected = []
    for k in {x[0] for x in rows}:
        prices = [p for _, _, p in sorted(x for x in rows if x[0] == k)]
        expected += [(k, a, b, min(prices[:i + 2])) for i, (a, b) in enumerate(zip(prices, prices[1:])) if b < a]
    assert sorted((k, a, b, low) for k, _, a, b, low in drops[0]) == sorted(expected)


def test_a_drop_between_two_months_is_reported_once(spark, tmp_path):
    parts = [[("a", 24 * 30 - 1, 10.0)], [("a", 24 * 30 + 1, 8.0)], [("b", 24 * 40, 1.0)]]
    t = _table(spark, tmp_path, parts, lambda s: ky.price_drops(s, KEYS))
    assert [(r.offer_key, r.previous_price, r.price) for r in t.collect()] == [("a", 10.0, 8.0)]


def _files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_files_do_not_grow_with_batches(spark, tmp_path):
    newest = lambda t: ob.newest_versions(t, KEYS)
    counts = {}
    for n in (4, 12):
        parts = [[(f"k{j % 3}", i + j / 10, float(100 * i + j)) for j in range(3)] for i in range(n)]
        t = _table(spark, tmp_path, parts, lambda s: s, f"fold{n}", mode="append", fold_every=2, newest=newest)
        assert sorted((r.offer_key, r.price) for r in newest(t).collect()) == [(f"k{j}", 100.0 * (n - 1) + j) for j in range(3)]
        counts[n] = _files(str(tmp_path / f"fold{n}/out"))
        assert t.select("batch_id").distinct().count() <= 3
    assert counts[12] <= counts[4]


def test_a_fold_that_broke_off_loses_nothing(spark, tmp_path):
    path, newest = str(tmp_path / "t"), lambda t: ob.newest_versions(t, KEYS)
    from offerloom.operators import sinks as sk
    for i in range(4):
        sk.replace_one(spark.createDataFrame([(f"k{j}", float(10 * i + j)) for j in range(i, 4)], "offer_key string, price double"), path, batch_id=i)
    want = sorted(map(tuple, newest(spark.read.parquet(path)).collect()))
    ob.fold_versions(spark, path, newest, 1)
    assert sorted(map(tuple, newest(spark.read.parquet(path)).collect())) == want
    sk.replace_one(newest(spark.read.parquet(path).where("batch_id <= 2")).drop("batch_id"), path, batch_id=ob.FOLDED + 2)  # written, nothing deleted yet
    assert sorted(map(tuple, newest(spark.read.parquet(path)).collect())) == want
    ob.fold_versions(spark, path, newest, 2)
    t = spark.read.parquet(path)
    assert sorted(map(tuple, newest(t).collect())) == want and {r[0] for r in t.select("batch_id").distinct().collect()} == {ob.FOLDED + 2, 3}
