"""Offer-shaped views over the given tables.

The SQL texts here use only what Spark SQL and other SQL engines share, so the same input
rows can be derived on both sides of a comparison. `{lineitem}` etc. name the tables."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BRAND_CASE = "CASE CAST(substr(p_brand, 7) AS INT) " + " ".join(
    f"WHEN {i} THEN {quote(b)}" for i, b in enumerate(fv.BRANDS, 1)) + (
    " WHEN 23 THEN 'Stoic' WHEN 25 THEN 'Salewa' END")

RAW_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  'shop-' || CAST(l_suppkey AS STRING) AS source_id,
  s_name AS merchant,
  CASE WHEN n_nationkey % 5 = 0 THEN 'FR' ELSE 'DE' END AS merchant_country,
  CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN 'ohne Adresse'
    ELSE 'https://www.Shop' || CAST(l_suppkey AS STRING) || '.example/p/' || CAST(l_partkey AS STRING) ||
      CASE l_linenumber WHEN 2 THEN '?utm_source=feed' WHEN 3 THEN '?ref=mail&size=L' WHEN 4 THEN '?aid=7&amp;'
        WHEN 5 THEN '#top' WHEN 6 THEN '/?color=blue&gclid=1' ELSE '' END END AS url,
  CAST(NULL AS STRING) AS image_url,
  CASE WHEN l_linenumber = 5 THEN upper({_BRAND_CASE}) ELSE {_BRAND_CASE} END AS brand,
  CASE WHEN l_quantity = 50 THEN NULL ELSE
    CASE WHEN l_linenumber = 3 THEN 'bis 50% ' ELSE '' END ||
    CASE p_brand WHEN 'Brand#22' THEN 'Rab ' WHEN 'Brand#24' THEN 'Haglofs ' ELSE '' END ||
    CASE WHEN l_linenumber = 4 THEN 'Herren ' ELSE '' END || p_name || ' ' ||
    CASE p_type WHEN 'ECONOMY' THEN 'Wanderhose' WHEN 'SMALL' THEN 'Trekking Pants'
      WHEN 'MEDIUM' THEN 'Softshellhose Light' WHEN 'PROMO' THEN 'Stretch Hose'
      WHEN 'STANDARD' THEN 'Damen Hose' ELSE 'Winterhose' END ||
    CASE WHEN l_linenumber % 2 = 0 THEN ' - ' || CASE substr(p_name, 1, 3) WHEN 'blu' THEN 'Blue' WHEN 'red' THEN 'Red'
      WHEN 'col' THEN 'White' WHEN 'hot' THEN 'Black' WHEN 'new' THEN 'Navy' WHEN 'old' THEN 'Grey'
      WHEN 'lar' THEN 'Olive' ELSE 'Neon Green' END ELSE '' END ||
    CASE WHEN l_linenumber = 6 THEN ' | L' ELSE '' END END AS name,
  CASE substr(p_name, 1, 3) WHEN 'blu' THEN 'Blue' WHEN 'red' THEN 'Red' WHEN 'col' THEN 'White'
    WHEN 'hot' THEN 'Black' WHEN 'new' THEN 'Navy' WHEN 'old' THEN 'Grey' WHEN 'lar' THEN 'Olive'
    ELSE 'Neon Green' END AS color,
  split(CASE l_linenumber WHEN 1 THEN 'L' WHEN 2 THEN 'W34 L32,W36 L32' WHEN 3 THEN 'M,XL'
    WHEN 4 THEN CAST(p_size AS STRING) WHEN 5 THEN 'EU 50' WHEN 6 THEN 'One Size'
    ELSE 'W' || CAST(p_size AS STRING) END, ',') AS sizes,
  CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_suppkey % 10 = 0 THEN 'CHF'
    WHEN l_suppkey % 20 = 1 THEN 'SEK' ELSE 'EUR' END AS currency,
  CASE WHEN l_partkey % 89 = 0 THEN CAST(0 AS DOUBLE)
    ELSE floor(l_extendedprice / l_quantity * (1 - l_discount) * 100 + 0.5) / 100 END AS price,
  p_retailprice AS rrp,
  CASE WHEN l_returnflag <> 'R' THEN 'feed:rrp' END AS rrp_source,
  CASE WHEN l_linenumber IN (2, 5) THEN 30 + l_quantity END AS observed_discount_pct,
  CASE WHEN l_discount >= 0.05 THEN 'merchant:displayed-discount'
    WHEN l_discount >= 0.03 THEN 'merchant:displayed-discount-upto' END AS discount_source,
  CASE WHEN l_tax >= 0.04 THEN floor(l_tax * 100 + 0.5) - 4.0 END AS shipping,
  CASE l_linenumber WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 4 THEN CAST(4.5 AS DOUBLE) END AS return_cost,
  CASE WHEN l_linestatus = 'F' THEN 'available' ELSE 'unknown' END AS size_availability,
  CASE WHEN l_partkey % 31 = 0 THEN 'Ausverkauft' WHEN l_returnflag = 'A' THEN 'in_stock' ELSE 'unknown' END
    AS availability,
  CASE WHEN p_size = 13 THEN 'Damen Modell' WHEN p_size % 2 = 0 THEN 'Leicht und robust, regular fit'
    WHEN p_size % 3 = 0 THEN 'Heavyweight alpine' ELSE 'Trekking' END AS description,
  CAST(l_shipdate AS DATE) AS run_date,
  CASE WHEN l_linestatus = 'O' THEN 'direct' ELSE 'local' END AS arm,
  p_size, p_brand, p_type, p_name, l_quantity, l_shipdate
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey
  JOIN {{nation}} ON s_nationkey = n_nationkey
"""
SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


#: Tasks a core over which the offer rows are dealt, and the rows that a task gets at most then.
TASKS_PER_CORE, ROWS_PER_TASK = 2, 1_000_000


def dealt(df: DataFrame, least: int = 0) -> DataFrame:
    """The rows of a table over at least TASKS_PER_CORE tasks a core, and at least `least` tasks. A row group is
    read by one task, and the rules that follow cost far more than reading; a table that Spark cuts finely enough
    is left as it is. Tasks hold few enough rows for what they sort to stay in memory."""
    tasks = max(least, TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(tasks, -(-df.count() // ROWS_PER_TASK))) if df.rdd.getNumPartitions() < tasks else df


def shared(spark: SparkSession, sf_dir: str, sql: str, least: int = 0) -> DataFrame:
    """Run one of the shared SQL texts over the tables it names; offer rows come in at least `least` tasks."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if "lineitem" in used:
        used["lineitem"] = dealt(used["lineitem"], least)
    return spark.sql(sql, **used)


def raw_offers(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    """lineitem as raw offers. `seq` (the order of observation) is a struct, because no
    single column orders the rows totally; shipping and doubles keep the reference types."""
    d = shared(spark, sf_dir, RAW_SQL, least)
    return d.withColumns({"seq": F.struct(*SEQ), "shipping": F.col("shipping").cast("double"),
                          "observed_discount_pct": F.col("observed_discount_pct").cast("double")})


# Exchange rates: one row per currency and quarter of ship dates, derived from the orders.
RATES_SQL = """
SELECT CASE o_orderkey % 2 WHEN 0 THEN 'CHF' ELSE 'GBP' END AS currency,
  CAST(o_orderdate AS DATE) AS rate_date,
  min(CASE o_orderkey % 2 WHEN 0 THEN 1.0 ELSE 1.1 END + CAST(o_custkey % 7 AS DOUBLE) / 64) AS rate
FROM {orders} GROUP BY 1, 2
"""


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, RATES_SQL).withColumn("rate", F.col("rate").cast("double"))


# Shipping policies of a part of the suppliers.
POLICIES_SQL = """
SELECT 'shop-' || CAST(s_suppkey AS STRING) AS source_id, CAST(4.5 AS DOUBLE) AS fee,
  CAST(1000 + s_suppkey % 5 * 200 AS DOUBLE) AS free_from, s_suppkey % 2 = 0 AS free_returns
FROM {supplier} WHERE s_suppkey % 3 = 0
"""
