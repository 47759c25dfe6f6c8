"""Streams with a state per key, over events that arrive in three files, some of them late."""
from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import sinks as sk
from ..streaming import keyed as ky
from ..streaming import observations as ob
from .registry import query
from .views import TASKS_PER_CORE, table

c = F.col
KEYS = ["user_id", "event_type"]
HOUR = 3_600_000_000

#: Arrival: thirds of the time go to three files. Two kinds of rows come with the last file: some of
#: the first days, which are behind the watermark by then and are dropped, and some of the last
#: hours of the second file, which still count. `last_ms` is the last watermark.
ARRIVED = f"""SELECT e.*, CASE WHEN late OR short THEN 2 WHEN us < t1 THEN 0 WHEN us < t2 THEN 1 ELSE 2 END AS file, late FROM (SELECT *,
    event_id % 20 = 0 AND us < t1 - {60 * HOUR} AS late, event_id % 20 = 1 AND us >= t2 - {12 * HOUR} AND us < t2 AS short FROM (SELECT x.*, lo + (hi - lo) {{div}} 3 AS t1, lo + (hi - lo) * 2 {{div}} 3 AS t2
    FROM (SELECT *, {{micros}} AS us, (SELECT min({{micros}}) FROM {{events}}) AS lo, (SELECT max({{micros}}) FROM {{events}}) AS hi FROM {{events}}) x) z) e"""
SEEN = f"""WITH seen AS ({ARRIVED.format(div='//', micros='epoch_us(ts)', events='events')}), kept AS (SELECT * FROM seen WHERE NOT late),
  edge AS (SELECT max(us) // 1000 - {30 * HOUR // 1000} AS last_ms FROM events_us)""".replace("events_us", "(SELECT epoch_us(ts) AS us FROM events)")


#: Rows of an arrival for every file it is written as.
ROWS_PER_FILE = 100_000


def _arrivals(spark, d, batches: int = 3, rows_per_file: int = ROWS_PER_FILE):
    """A stream of arrivals in order, one per micro-batch. All have the same number of files, which grows with
    the smallest of them, so that no arrival is read by one task; so many rows leave no file without any."""
    e = table(spark, d, "events")
    sql = ARRIVED.format(div="div", micros="unix_micros(CAST(ts AS TIMESTAMP))", events="{events}")
    rows = spark.sql(sql, events=e).drop("us", "t1", "t2", "short", "late")
    path = sk.work_folder(spark, "arrivals")
    rows.write.partitionBy("file").parquet(f"{path}/cut")
    cut = spark.read.parquet(f"{path}/cut")
    sizes = [cut.where(c("file") == k).count() for k in range(3)]
    files = max(1, min(min(sizes) // rows_per_file, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    for k in range(3):
        part = cut.where(c("file") == k).drop("file")
        part.repartition(files).write.mode("append").parquet(f"{path}/in")
    return ob.read_observations(spark, f"{path}/in", part.schema, max_files=files)


def _started(spark, stream, **more):
    path = sk.work_folder(spark, "stream")
    with ky.keyed_store(spark):
        running = ob.write_versions(stream, f"{path}/table", f"{path}/checkpoint", **more)
    running.awaitTermination()
    return spark.read.parquet(f"{path}/table")


def _text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("offer_lifetimes", f"""{SEEN}, runs AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY us, value ROWS UNBOUNDED PRECEDING) AS life FROM
    (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us, value) < {30 * HOUR} THEN 0 ELSE 1 END AS opens FROM kept))
  SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS observations,
    arg_max(value, row(us, value)) AS value, CASE WHEN (max(us) + {30 * HOUR} + 999) // 1000 <= (SELECT last_ms FROM edge) THEN 'expired' ELSE 'live' END AS state
  FROM runs GROUP BY user_id, event_type, life""")
def offer_lifetimes(spark, d):
    t = _started(spark, ky.offer_lifetimes(_arrivals(spark, d), KEYS, ["value"]))
    return ky.newest_lifetimes(t, KEYS).select(*KEYS, _text("first_seen").alias("first_seen"), _text("last_seen").alias("last_seen"), "observations", "value", "state")


@query("ordered_price_drops", f"""{SEEN}, steps AS (SELECT *, lag(value) OVER w AS previous_price, min(value) OVER (PARTITION BY user_id, event_type ORDER BY us, value ROWS UNBOUNDED PRECEDING) AS lowest
    FROM kept WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, value))
  SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, previous_price, value AS price, lowest FROM steps
  WHERE value < previous_price AND (us + 999) // 1000 <= (SELECT last_ms FROM edge)""")
def ordered_price_drops(spark, d):
    t = _started(spark, ky.price_drops(_arrivals(spark, d), KEYS, price="value"))
    return t.select(*KEYS, _text("ts").alias("ts"), "previous_price", "price", "lowest")


@query("folded_versions", """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS parsed_offers, count(*) FILTER (value > 0) AS priced_offers FROM events GROUP BY 1, 2""")
def folded_versions(spark, d):
    """T5: the daily counters, with every second micro-batch folding what was written so far."""
    keys = ["run_date", "user_id"]
    days = ob.coverage_by_window(_arrivals(spark, d), ["user_id"], delay="40 days")
    t = _started(spark, days, fold_every=2, newest=lambda rows: ob.newest_versions(rows, keys))
    return ob.newest_versions(t, keys).select("user_id", F.date_format("run_date", "yyyy-MM-dd").alias("day"), "parsed_offers", "priced_offers")
