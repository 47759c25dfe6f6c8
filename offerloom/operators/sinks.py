"""K1-K5: idempotent partitioned tables.

Plain parquet has no MERGE. A key that is a partition is replaced with dynamic partition
overwrite; a finer key is merged into the partitions it touches."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import free_shuffles, stored, work_folder

BUCKETS = 8
#: Folders of a run date, and the column that names them.
BATCH_BUCKETS, BUCKET = 32, "batch_bucket"


def replace_partitions(df: DataFrame, path: str, partitions, order=(), rebalance: bool = True) -> None:
    """Overwrite exactly the partitions that occur in `df`. The rebalance hint lets AQE split
    a partition that holds most of the rows and join small ones before files are written; without
    it no row is shuffled and every task writes a file for each partition it meets, which suits
    few partitions of wide rows. Files are sorted by `order`, if any, so that readers can skip row groups."""
    if rebalance:
        df = df.hint("rebalance", *[F.col(p) for p in partitions])
    df = df.sortWithinPartitions(*partitions, *order) if order else df
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def bucket_of(batch):
    """The bucket of a batch. A table of batches has BATCH_BUCKETS folders per run date, however many batches it has."""
    return F.pmod(F.xxhash64(batch.cast("string")), F.lit(BATCH_BUCKETS)).cast("int")


def write_batch(df: DataFrame, path: str, run_date=None, batch=None, batches: DataFrame | None = None) -> None:
    """K1: replace the stored rows of (run_date, batch). Batches share hash buckets, which are the folders
    and are sorted by batch; other batches of a touched bucket are staged and written back with it.
    `batches` (batch) may name the batches of `df` with a run date; otherwise `df` is stored first to see them.
    Writers of one run date take turns."""
    if run_date is not None:
        df = df.withColumn("run_date", F.lit(run_date).cast("date"))
    if batch is not None:
        df = df.withColumn("batch", F.lit(batch).cast("int"))
    spark, df = df.sparkSession, df.withColumn(BUCKET, bucket_of(F.col("batch")))
    old = _existing(spark, path)
    if old is not None and run_date is not None:
        old = old.where(F.col("run_date") == F.lit(run_date).cast("date"))
    if old is not None and not old.isEmpty():
        if batches is None or run_date is None:
            df = stored(df, "batches")
            keys = df.select("run_date", BUCKET, "batch").distinct()
        else:
            keys = batches.select(F.lit(run_date).cast("date").alias("run_date"), bucket_of(F.col("batch")).alias(BUCKET), "batch").distinct()
        kept = _other_batches(old, keys)
        if kept is not None:
            df = stored(kept, "staged").unionByName(df, allowMissingColumns=True)
    if run_date is None:  # rows of several dates: every task might meet every date
        replace_partitions(df, path, ["run_date", BUCKET], ["batch"])
    else:  # into the folder of the date: a constant among the sorted columns would have the rows sorted twice
        day = spark.range(1).select(F.lit(run_date).cast("date")).first()[0]
        replace_partitions(df.drop("run_date"), f"{path}/run_date={day}", [BUCKET], ["batch"], rebalance=False)
    free_shuffles(spark)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # first write: the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _same(a: DataFrame, b: DataFrame, keys, how: str) -> DataFrame:
    """A semi or anti join by keys of which some may be null."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)


def _other_batches(old: DataFrame, keys: DataFrame) -> DataFrame | None:
    """Rows of batches that share a bucket with `keys` and are none of them; None without such batches."""
    found = _same(old.select("run_date", BUCKET, "batch").distinct(), keys, ["run_date", BUCKET], "left_semi")
    found = stored(_same(found, keys, ["run_date", "batch"], "left_anti"), "other-batches")
    return None if found.isEmpty() else _same(old, found, ["run_date", BUCKET, "batch"], "left_semi")


def replace_one(df: DataFrame, path: str, **partition) -> None:
    """Overwrite one partition. Also an empty result replaces what was stored there."""
    folder = "/".join(f"{k}={v}" for k, v in partition.items())
    df.drop(*partition).write.mode("overwrite").parquet(f"{path}/{folder}")


def drop_partitions(spark: SparkSession, path: str, partition: str, gone) -> None:
    """Delete the partitions of a table by one integer column for which `gone` holds, least first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith(f"{partition}=")]
    for value, p in sorted(((int(p.getName().split("=", 1)[1]), p) for p in found), key=lambda x: x[0]):
        if gone(value):
            fs.delete(p, True)


def write_run(tables: dict, path: str, run_date) -> None:
    """K2: replace the stored tables (report, deals, near, ...) of a run date."""
    for name, df in tables.items():
        replace_one(df, f"{path}/{name}", run_date=run_date)
    for df in list(tables.values())[:1]:
        free_shuffles(df.sparkSession)


def upsert(df: DataFrame, path: str, partitions, keys) -> None:
    """Replace rows by key inside the partitions `df` touches: kept rows of those partitions
    and the new rows are staged, then the partitions are swapped. `df` is computed once."""
    spark, df = df.sparkSession, stored(df, "upsert")
    old = _existing(spark, path)
    if old is None:
        replace_partitions(df, path, partitions)
        return
    touched = df.select(*partitions).distinct()
    kept = old.join(touched, partitions, "left_semi").join(df.select(*keys).distinct(), keys, "left_anti")
    staged = work_folder(spark, "staged")
    kept.unionByName(df, allowMissingColumns=True).write.mode("overwrite").parquet(staged)
    replace_partitions(spark.read.parquet(staged), path, partitions)


def write_snapshots(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """K3: replace the snapshot of each (source, date); sources share hash buckets, so the
    number of folders does not grow with the number of sources. A table keeps the number of
    buckets that it was first written with."""
    keyed = df.withColumns({
        "collected_date": F.to_date("collected_at"),
        "bucket": F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int")})
    upsert(keyed, path, ["collected_date", "bucket"], ["collected_date", "bucket", "source_id"])


def apply_hide_events(hidden: DataFrame, events: DataFrame) -> DataFrame:
    """K4: hidden models after hide/unhide events (hide_key, label, action, at). The latest
    event decides, a repeated hide changes the label but keeps the time of the first hide
    since the last unhide. Both steps are aggregations per key."""
    stored = hidden.select("hide_key", "label", F.lit("hide").alias("action"), F.col("hidden_at").alias("at"))
    log = stored.unionByName(events.select("hide_key", "label", "action", "at"))
    undone = log.where(F.col("action") == "unhide").groupBy("hide_key").agg(F.max("at").alias("undone_at"))
    live = log.where(F.col("action") == "hide").join(undone, "hide_key", "left").where(
        F.col("undone_at").isNull() | (F.col("at") > F.col("undone_at")))
    return live.groupBy("hide_key").agg(
        F.max_by("label", F.struct("at", "label")).alias("label"), F.min("at").alias("hidden_at"))


def write_summary(df: DataFrame, path: str) -> None:
    """K5: an aggregate as JSON."""
    df.write.mode("overwrite").json(path)
