"""Joins whose sides Catalyst sizes wrongly: what is broadcast must not grow past its size."""
from pyspark.sql import functions as F

from offerloom.llm import simhash
from offerloom.operators import joins as jo

c = F.col


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_fingerprints_are_not_broadcast(spark, tmp_path):
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fp")
    fps = spark.read.parquet(f"{tmp_path}/fp")
    assert simhash._cells(fps).count() > 20 * fps.count()
    plan = _plan(simhash.links(fps))
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_small_tables_are_broadcast_without_salts(spark, tmp_path):
    spark.range(200).select(c("id").alias("k"), F.lit("b").alias("b")).write.parquet(f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table")
    facts = spark.range(50).select((c("id") % 7).alias("k"), c("id").cast("string").alias("url"))
    twice = table.unionByName(table.where("k = 3").withColumn("b", F.lit("again")))
    for how, n in (("inner", 50), ("left", 50)):
        out = jo.lookup_join(facts, table, "k", "url", how)
        plan = _plan(out)
        assert "_salt" not in plan and "explode" not in plan and "BroadcastHashJoin" in plan
        assert out.count() == n and out.columns == ["k", "url", "b"]
    same = [sorted(map(str, jo.lookup_join(facts, twice, "k", "url").collect()))]
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = jo.lookup_join(facts, twice, "k", "url")
        assert "_salt" in _plan(out)
        same.append(sorted(map(str, out.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert same[0] == same[1] and len(same[0]) == 57


def test_offers_are_not_shuffled_for_their_rates(spark, tmp_path):
    spark.range(3000).select(F.when(c("id") % 2 == 0, "CHF").otherwise("GBP").alias("currency"), F.date_add(F.lit("2024-01-01").cast("date"), (c("id") % 900).cast("int")).alias("rate_date"),
                             (c("id") % 5 + 1).cast("double").alias("rate")).write.parquet(f"{tmp_path}/rates")
    offers = spark.createDataFrame([("a", "CHF", 10.0), ("b", "gbp", 2.0), ("c", "EUR", 1.0), ("d", None, 1.0), ("e", "SEK", 1.0)], "url string, currency string, price double")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        rates = spark.read.parquet(f"{tmp_path}/rates")
        want = sorted(map(str, jo.to_eur(offers, rates).collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")  # less than the rates' files, more than a row per currency
        assert not jo.broadcastable(jo.latest_rates(rates))
        out = jo.to_eur(offers, rates)
        assert "Exchange hashpartitioning" not in _plan(out) and sorted(map(str, out.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
