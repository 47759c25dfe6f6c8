"""Mixing sources to target weights by Pareto order sampling.

A source that is to give r times its words gives floor(r) certain whole copies of every
document. The rest is a sample without replacement: with inclusion probability p = r - floor(r)
and a uniform number u made from the document, documents are taken in the order of
(u / (1 - u)) / (p / (1 - p)); p differs by source. The sample's fixed size is counted in
words: it ends before the target would be exceeded, and two further sweeps of the same order
fill what is left with documents that still fit. As p is one number for a source, the order is
that of u; words are counted by ranges of u first, so only the range in which a source's target
lies is sorted and a source may hold most of the rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, "mix"
SWEEPS = 3
#: u has 52 bits; its upper bits name one of 4096 ranges.
_RANGE_BITS = 40


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """Every row with its size, source key (nulls last) and u."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)), 1, 13), 16, 10)
    return docs.withColumns({
        "_size": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "_u": u.cast("long"),
        "_key": F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(source_col).cast("string"), F.lit("")))})


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_key, source_size, target), one row per source. Sources that reach their cap do so in the
    order of cap by weight, so the rounds of sharing the excess are one pass in that order: the
    first source whose cap is not below its share of what is left sets the level for the rest."""
    per = sizes.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    at = F.pmod(F.row_number().over(W.orderBy("_key")) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1)).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "_key")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    whole, rest = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    per = per.withColumn("level", (share * F.sum("source_size").over(whole) - capped) / F.sum("w").over(rest))
    level = F.first(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level")), ignorenulls=True).over(whole)
    return per.withColumn("level", level).select(
        "_key", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _taken(sweeps: int):
    """Whether one of the first `sweeps` sweeps took a row."""
    return F.lit(False) if not sweeps else _taken(sweeps - 1) | ((F.col("_size") <= F.col(f"_left{sweeps}")) & (F.col("_u") <= F.col(f"_cut{sweeps}")))


def _joined(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with the state of their source. Should the state be too large to send to all tasks,
    the rows of a source are dealt over 16 reducers, each with its row of state."""
    salted = state.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return rows.withColumn("_salt", F.col("_u").bitwiseAND(F.lit(15))).join(salted, ["_key", "_salt"]).drop("_salt")


def _sweep(rows: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """Adds to `state` the greatest u that sweep k takes and the words left for the next one."""
    left, here = F.col(f"_left{k}"), f"_cut{k}"
    live = _joined(rows, state).where((F.col("_size") <= left) & (F.col("_size") > 0) & ~_taken(k - 1)).select(
        "_key", "_u", "_size", left.alias("left"), F.shiftright("_u", _RANGE_BITS).alias("range"))
    words = live.groupBy("_key", "range").agg(F.sum("_size").alias("words"), F.first("left").alias("left"))
    up_to = F.sum("words").over(W.partitionBy("_key").orderBy("range"))
    words = words.withColumn("before", up_to - F.col("words"))
    fits = F.col("before") + F.col("words") <= F.col("left")
    full = words.where(fits).groupBy("_key").agg(
        (F.shiftleft(F.max("range") + 1, _RANGE_BITS) - 1).alias("full_cut"), F.sum("words").alias("full_words"))
    edge = words.where((F.col("before") < F.col("left")) & ~fits).select("_key", "range", "before")
    inside = F.sum("_size").over(W.partitionBy("_key", "range").orderBy("_u").rangeBetween(W.unboundedPreceding, W.currentRow))
    part = live.join(edge, ["_key", "range"]).withColumn("inside", inside).where("before + inside <= left").groupBy("_key").agg(
        F.max("_u").alias("part_cut"), F.max("inside").alias("part_words"))
    none, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")
    out = state.join(full, "_key", "left").join(part, "_key", "left").withColumn(
        here, F.greatest(F.coalesce("full_cut", none), F.coalesce("part_cut", none))).withColumn(
        f"_left{k + 1}", left - F.coalesce("full_words", zero) - F.coalesce("part_words", zero))
    return out.drop("full_cut", "part_cut", "full_words", "part_words")


def _copies(docs, weights, share, most, seed, id_col, text_col, source_col) -> DataFrame:
    """Rows of `docs` with their size, their source's size and target, and `_copies`."""
    measured = _measured(docs, id_col, text_col, source_col, seed)
    rows = stored(measured.select("_key", "_size", "_u"), "mix-sizes")
    state = targets(rows, weights, share, most).withColumn(
        "_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn(
        "_left1", F.floor(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    for k in range(1, SWEEPS + 1):
        state = stored(_sweep(rows, state, k), "mix-state")
    return _joined(measured, state).withColumn("_copies", F.col("_whole") + F.when(_taken(SWEEPS) & (F.col("_left1") > 0), 1).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row; taken counts the words of all copies.
    Null texts have no words; a null source is a source of its own, the last. Equal rows are
    taken together. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    out = _copies(rows, weights, share, most, seed, "doc_id", "_text", "_source")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                      (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of `docs` as often as they are taken, in all their columns. Rows
    without words add nothing to a mix and go."""
    inner = docs.withColumnsRenamed({c: f"_c{i}" for i, c in enumerate(docs.columns)})
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    out = _copies(inner, weights, share, most, seed, at[id_col], at[text_col], at[source_col])
    return out.where("_copies > 0 and _size > 0").select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)], F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_k")).drop("_k")
