"""Connected components by alternating large-star and small-star rounds.

Every round is two joins and a distinct over the edges and is written to the shared folder,
so nothing depends on an earlier round's executors. The number of rounds grows with the
logarithm of the longest path; no edge list, node list or label list reaches the driver."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Small star: a node's smaller neighbours and the node itself move to the smallest of
    them. Large star: its larger neighbours do."""
    if small:
        near = pairs.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("o"))
    else:
        near = pairs.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(
            pairs.select(F.col("v").alias("n"), F.col("u").alias("o")))
    low = near.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
    near = near.join(low, "n")
    if small:
        moved = near.where("o <> m").select(F.col("o").alias("u"), F.col("m").alias("v")).unionByName(
            low.select(F.col("n").alias("u"), F.col("m").alias("v")))
    else:
        moved = near.where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _state(pairs: DataFrame):
    return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (u, v: long), root being the smallest node that it
    reaches. Nulls and loops are ignored; no edges give no rows."""
    pairs = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = _state(pairs)
    while before[0]:
        pairs = stored(_star(_star(pairs, small=False), small=True), "edges")
        after = _state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
