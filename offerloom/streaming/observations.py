"""T1-T7 with Structured Streaming.

Keyed state is kept by native streaming aggregations and by the built-in deduplication:
both combine rows of a key inside each task before the shuffle, so a source or an offer that
sends a third of all rows does not load one task. State is bounded by watermarks. Results go
to versioned tables: a batch writes its own partition `batch_id`, so a batch that is repeated
after a failure replaces itself, and readers take the newest version of a key."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import sinks as sk
from ..storage import free_shuffles

c = F.col
TTL = f"{fv.SNAPSHOT_MAX_AGE_HOURS} hours"


def read_observations(spark: SparkSession, path: str, schema, ts: str = "ts", max_files: int | None = None,
                      pattern: str | None = None) -> DataFrame:
    """A stream of observation files; event time becomes a proper timestamp."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path).withColumn(ts, c(ts).cast("timestamp"))


def read_feed_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """A large TSV feed in chunks of files."""
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option(
        "maxFilesPerTrigger", max_files).csv(path)


def dedupe_stream(observations: DataFrame, key="offer_key", delay: str = TTL, ts: str = "ts") -> DataFrame:
    """An observation repeated within the delay counts once."""
    keys = [key] if isinstance(key, str) else list(key)
    return observations.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def latest_offer_state(observations: DataFrame, keys, value_cols, ttl: str = TTL, ts: str = "ts") -> DataFrame:
    """T2 (update mode): newest values per key and time slot of one lifetime. Slots older than
    the watermark leave the state, which is the expiry of a snapshot; `current_state` reads
    the newest fresh row per key."""
    latest = F.max_by(F.struct(*value_cols), F.struct(ts, *value_cols))
    return (observations.withWatermark(ts, ttl).groupBy(*keys, F.window(ts, ttl).alias("slot"))
            .agg(F.max(ts).alias(ts), latest.alias("v"))
            .select(*keys, c("slot.start").alias("slot"), ts, "v.*"))


def coverage_by_window(observations: DataFrame, keys, every: str = "1 day", delay: str = TTL, ts: str = "ts",
                       value: str = "value") -> DataFrame:
    """Counters per day (or another tumbling window) and source."""
    return (observations.withWatermark(ts, delay).groupBy(F.window(ts, every).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("parsed_offers"), F.count_if(c(value) > 0).alias("priced_offers"))
            .select(F.to_date("w.start").alias("run_date"), *keys, "parsed_offers", "priced_offers"))


def late_rows(observations: DataFrame, now, max_age: str = "10 DAYS", ts: str = "ts") -> DataFrame:
    """T4: marks rows too old to count, so that late data is counted and not lost silently."""
    now = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    return observations.withColumn("late", c(ts) < now - F.expr(f"INTERVAL {max_age}"))


def price_moves(observations: DataFrame, keys, slot: str = "30 days", delay: str = TTL, ts: str = "ts",
                price: str = "price") -> DataFrame:
    """T6 (update mode): first and last price of a key per slot; a drop is last < first."""
    first, last = F.struct(ts, price), F.struct(ts, price)
    return (observations.withWatermark(ts, delay).groupBy(*keys, F.window(ts, slot).alias("slot"))
            .agg(F.min_by(price, first).alias("first_price"), F.max_by(price, last).alias("last_price"),
                 F.count(F.lit(1)).alias("observations"))
            .select(*keys, c("slot.start").alias("slot"), "first_price", "last_price", "observations"))


def price_drop_alerts(moves: DataFrame) -> DataFrame:
    """T6."""
    return moves.where((c("observations") > 1) & (c("last_price") < c("first_price")))


def write_versions(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", trigger: dict | None = None,
                   fold_every: int | None = None, newest=None):
    """T5: each micro-batch replaces its own partition of the table (K1 keyed by batch id).
    `trigger` holds the arguments of the stream's trigger. With `fold_every`, every so many batches
    the versions so far are folded by `newest` (a function of the table, as `newest_versions`)."""
    def save(batch: DataFrame, batch_id: int):
        sk.replace_partitions(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"])
        if fold_every and (batch_id + 1) % fold_every == 0:
            fold_versions(batch.sparkSession, path, newest, batch_id)
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(save).trigger(**(trigger or {"availableNow": True})).start())


#: Folded versions count as older than every batch.
FOLDED = -(1 << 62)


def fold_versions(spark: SparkSession, path: str, newest, upto: int, files: int = 8) -> None:
    """T5: the newest versions among the batches up to `upto` and earlier folds become one partition
    of `files` files, and the partitions they came from go, oldest first: what is left at any moment
    is the fold and the newest batches, so a reader always finds the newest version of a key, and a
    fold that broke off is simply repeated. Readers that started before may miss files and have to
    read again, as with any rewritten table."""
    table = spark.read.parquet(path).where(c("batch_id") <= upto)
    if table.isEmpty():
        return
    folded = newest(table).drop("batch_id").repartition(files)
    sk.replace_one(folded, path, batch_id=FOLDED + upto)
    sk.drop_partitions(spark, path, "batch_id", lambda b: b <= upto and b != FOLDED + upto)


def newest_versions(table: DataFrame, keys) -> DataFrame:
    """The newest version of every key of a table written by `write_versions`."""
    rest = [x for x in table.columns if x not in (*keys, "batch_id")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def current_state(versions: DataFrame, keys, now, ttl_hours: int = fv.SNAPSHOT_MAX_AGE_HOURS, ts: str = "ts") -> DataFrame:
    """The newest fresh row per key."""
    now = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    rest = [x for x in versions.columns if x not in (*keys, "slot", "batch_id")]
    alive = newest_versions(versions, [*keys, "slot"]).where(c(ts) >= now - F.expr(f"INTERVAL {ttl_hours} HOURS"))
    return alive.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("r")).select(*keys, "r.*")


def select_deals_stream(offers: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """L1 on a stream: the best row of every offer of a micro-batch is stored under its batch id;
    `stream_models` ranks what all batches left, so the result does not depend on how the input
    was cut. `trigger` holds the arguments of the stream's trigger."""
    from ..operators.ranking import best_per_offer

    def save(batch: DataFrame, batch_id: int):
        # one partition, whose rows the aggregation has already dealt by offer
        sk.replace_partitions(best_per_offer(batch).withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"], rebalance=False)
        free_shuffles(batch.sparkSession)
    return (offers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_models(table: DataFrame, profile=None) -> DataFrame:
    """Ranked models of a table written by `select_deals_stream`: the best of the batches' best
    rows per offer, with the offer's first row over all batches, then one row per model."""
    from ..operators.ranking import best_per_model, best_per_offer
    from ..settings import DEFAULT
    rows = table.drop("batch_id")
    first = rows.groupBy("offer_key").agg(F.min("first_seq").alias("first_seq"))
    best = best_per_offer(rows.drop("first_seq")).drop("first_seq").join(first, "offer_key")
    return best_per_model(best, (profile or DEFAULT).min_discount)
