"""Product feeds and posts."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import money as mo
from ..functions import sizes as sz
from ..functions import text as tx
from ..functions import urls as ur
from ..operators.aggregates import group_variants
from ..operators.ranking import cap_per_group, first_per_key
from ..schemas import FEED_ROW, TSV_FEED
from ..settings import DEFAULT, Profile
from .common import offer_columns, with_source

c = F.col


def read_json_feed(bodies: DataFrame, sources: DataFrame, money_style: str = "decimal",
                   limit: int | None = None) -> DataFrame:
    """Feed documents (source_id, seq, body) as an array, or an object with `products` or
    `items`. `limit`, if given, is the number of rows read of one document."""
    rows = T.ArrayType(FEED_ROW)
    wrapped = T.StructType([T.StructField("products", rows), T.StructField("items", rows)])
    is_array = tx.blank(c("body")).rlike(r"^\s*\[")
    parsed = F.from_json("body", wrapped)
    listed = F.when(is_array, F.from_json("body", rows)).otherwise(F.coalesce(parsed["products"], parsed["items"]))
    d = bodies.select("source_id", c("seq").alias("_doc"), F.posexplode(listed).alias("pos", "r"))
    d = d.withColumn("seq", F.struct("_doc", "pos"))
    d = cap_per_group(d, ["source_id", "_doc"], "pos", limit)

    def text(name):
        return tx.or_null(F.trim(c("r")[name]))
    rrp = F.coalesce(text("rrp"), text("msrp"), text("listPrice"))
    d = d.select(
        "source_id", "seq", F.coalesce(text("url"), text("link")).alias("url"),
        F.coalesce(text("image"), text("imageUrl")).alias("image_url"), text("brand").alias("brand"),
        F.coalesce(text("name"), text("title")).alias("name"), text("color").alias("color"),
        F.coalesce(F.transform(c("r.sizes"), F.trim), F.array().cast("array<string>")).alias("sizes"),
        F.coalesce(text("currency"), F.lit("EUR")).alias("currency"),
        mo.parse_money(c("r.price"), money_style).alias("price"), mo.parse_money(rrp, money_style).alias("rrp"),
        F.when(text("rrp").isNotNull(), F.lit("feed:rrp")).when(text("msrp").isNotNull(), F.lit("feed:msrp")).alias("rrp_source"),
        mo.parse_money(c("r.shipping"), money_style).alias("shipping"),
        F.coalesce(text("availability"), F.lit("unknown")).alias("availability"),
        F.trim(tx.blank(c("r.description"))).alias("description"))
    return offer_columns(with_source(d.where(c("url").isNotNull() & c("name").isNotNull() & c("price").isNotNull()), sources))


def tsv_rows(lines: DataFrame, source_id: str, profile: Profile = DEFAULT) -> DataFrame:
    """S3 gates over TSV rows with the columns of `TSV_FEED`; `lines` may be a stream."""
    def col(name):
        return F.trim(F.regexp_replace(tx.blank(c(f"`{name}`")), '^"|"$', ""))
    d = lines.select(
        F.lit(source_id).alias("source_id"), tx.brand_of_field(col("Hersteller"), profile.brands).alias("brand"),
        col("Bezeichnung").alias("name"), col("Beschreibung").alias("description"), col("Kategorie").alias("category"),
        col("Geschlecht").alias("gender"), col("Stichworte").alias("tags"), mo.parse_money(col("VK"), "feed_cents").alias("price"),
        ur.canonical_url(col("Partnerlink")).alias("url"), col("Groesse").alias("size"),
        mo.parse_money(col("Versandkosten"), "feed_cents").alias("shipping"), col("Lieferstatus").alias("status"),
        col("Modellnr").alias("model"), tx.or_null(col("Bild-url")).alias("image_url"),
        F.coalesce(tx.or_null(col("Währung")), F.lit("EUR")).alias("currency"), *[x for x in ("seq",) if x in lines.columns])
    return d.where(c("brand").isNotNull() & tx.is_relevant_category(c("name"), c("category"), c("gender"), c("tags"))
                   & (c("price") != 0) & c("price").isNotNull() & (c("url") != ""))


def read_tsv_lines(spark: SparkSession, path: str) -> DataFrame:
    """The TSV file with its declared columns and the position of each row in the file."""
    d = spark.read.csv(path, sep="\t", header=True, quote="", schema=TSV_FEED)
    return d.withColumn("seq", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def group_tsv(rows: DataFrame) -> DataFrame:
    """S3 + A1: one offer per model, brand and name with all its sizes."""
    keyed = rows.withColumns({
        "_key": F.lower(F.concat_ws("|", F.coalesce(tx.or_null(c("model")), c("url")), c("brand"), c("name"))),
        "in_stock": F.lower("status").rlike(fv.FEED_IN_STOCK_PATTERN)})
    d = group_variants(keyed.drop("model", "category", "gender", "tags"), ["source_id", "_key"])
    return d.withColumn("availability", F.when(c("in_stock"), F.lit("in_stock")).otherwise(c("status")))


def read_tsv_feed(spark: SparkSession, path: str, source_id: str, sources: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """S3: a large product feed; brand, category and price gates apply before the grouping."""
    return offer_columns(with_source(group_tsv(tsv_rows(read_tsv_lines(spark, path), source_id, profile)), sources))


RSS_ITEM = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("link", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("merchant", T.StructType([T.StructField("_name", T.StringType()), T.StructField("_price", T.StringType())])),
    T.StructField("content", T.StructType([T.StructField("_url", T.StringType())]))])


def read_rss_posts(spark: SparkSession, path: str, host_prefix: str) -> DataFrame:
    """Items of RSS files; only links below `host_prefix` are posts."""
    d = (spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(RSS_ITEM).load(path))
    d = d.select(
        F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")).alias("seq"),
        tx.strip_temperature(tx.decode_entities(F.trim("title"))).alias("title"), F.trim("link").alias("link"),
        tx.or_null(c("merchant._name")).alias("merchant"), mo.parse_money(c("merchant._price"), "de_first").alias("price"),
        tx.post_text(c("description")).alias("description"), tx.or_null(F.trim("category")).alias("category"),
        tx.or_null(c("content._url")).alias("image_url"),
        F.try_to_timestamp(F.regexp_replace("pubDate", r"^\s*[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"))
    return d.where((tx.blank(c("title")) != "") & c("link").startswith(host_prefix))


def posts_to_offers(posts: DataFrame, sources: DataFrame, source_id: str, now, max_age_days: int = fv.POST_MAX_AGE_DAYS,
                    via: str = "posts") -> DataFrame:
    """Fresh, unexpired posts with a price; sizes and references as the text states them."""
    now = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    alive = c("published").isNull() | (c("published") >= now - F.expr(f"INTERVAL {max_age_days} DAYS"))
    d = posts.where(alive & ~F.lower("title").rlike(tx.whole_word(fv.EXPIRED_POST_WORDS)))
    d = tx.computed(d, {
        "price": F.coalesce("price", mo.parse_money(F.regexp_extract("description", rf"^{mo.AMOUNT}\s*€", 1), "de_first")),
        "ref": mo.post_reference(c("description")),
        "sizes": sz.expand_size_ranges(F.concat_ws(" ", "title", "description"))})
    rrp = F.when(c("ref.value") > c("price"), c("ref.value"))
    d = d.where(c("price").isNotNull()).select(
        "seq", F.lit(source_id).alias("source_id"), F.concat("merchant", F.lit(f" (via {via})")).alias("merchant"),
        c("link").alias("url"), "image_url", c("title").alias("name"), F.lit("EUR").alias("currency"), "price",
        rrp.alias("rrp"), F.when(rrp.isNotNull(), c("ref.source")).alias("rrp_source"), "sizes",
        F.when(F.size("sizes") > 0, F.lit("available")).otherwise(F.lit("unknown")).alias("size_availability"),
        F.lit("in_stock").alias("availability"), "description")
    return offer_columns(with_source(first_per_key(d, ["source_id", "url"], "seq"), sources))
