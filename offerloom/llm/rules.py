"""Quality rules: exact base counts, and robust multivariate outliers per language and source.

The counts of a text are turned into a vector of transformed statistics. For every language and
source the minimum covariance determinant is approached by concentration steps: fit location
and scatter on the share of documents with the smallest Mahalanobis distances, measure again,
repeat. A step is one aggregation: documents are summed by group and by bin of their distance
(count, sums, cross products), and the bins up to the wanted share give the next fit. So every
document counts at any size, a group may hold most rows, and only sums travel."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

WINDOW, MIN_WORDS, MOST_REPEATED = 5, 10, 20
_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"

NAMES = ["word_length", "symbols", "capitals", "digits", "variety", "repeats", "lines", "stops"]
#: Smallest standard deviation of a statistic: differences below it are never odd.
FLOORS = [0.05, 0.06, 0.08, 0.06, 0.05, 0.10, 0.12, 0.06]
SHARE, STEPS, TAIL_Z = 0.75, 4, 6.0
#: Documents a group needs for an estimate of its own; smaller ones are pooled by language, then all together.
MIN_GROUP = 300
_D = len(NAMES)
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list) -> int:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    k = len(number)
    if k ** WINDOW < 2 ** 62:
        key = a[:n].copy()
        for i in range(1, WINDOW):
            key = key * k + a[i:n + i]
    else:  # number the pairs, then the fours, so that keys stay exact
        two = np.unique(a[:-1] * k + a[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * (len(two) + 1) + two[2:], return_inverse=True)[1]
        key = four[:n] * k + a[WINDOW - 1:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    np.add.at(step, np.flatnonzero(again), 1)
    np.add.at(step, np.flatnonzero(again) + WINDOW, -1)
    return int((step.cumsum() > 0).sum())


def measure(text: str | None) -> list:
    """The base counts and the transformed statistics of one whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=128) if data else np.zeros(128, np.int64)
    upper, digit, stops = int(count[65:91].sum()), int(count[48:58].sum()), int(count[[33, 44, 46, 58, 59, 63]].sum())
    distinct = len(set(words))
    # constants added above and below keep short texts near the usual values
    root = lambda part, whole, a, b: math.asin(math.sqrt(min(1.0, (part + a) / (whole + b))))
    stats = [
        math.log((chars + 100) / (n + 20)), root(symbols, chars, 0, 200), root(upper, chars, 4, 200), root(digit, chars, 0, 200),
        math.log(distinct + 10) / math.log(n + 10), root(repeats, n, 0, 20), root(dup, lines, 0, 5), root(stops, chars, 4, 200)]
    return [n, chars, symbols, dup, repeats, stats]


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column(1)]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            x = np.array([r[-1] for r in rows]).reshape(-1, _D)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), *cols, *[pa.array(x[:, i]) for i in range(_D)]],
                ["doc_id", "lang", "source", *COUNTS, *[f"x{i}" for i in range(_D)]])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"x{i} double" for i in range(_D))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("own", F.to_json(F.struct("lang", "source")))


def _groups(rows: DataFrame) -> DataFrame:
    """(own, grp): the group whose estimate a language and source takes, one row each."""
    n = rows.groupBy("own").agg(F.first("lang").alias("lang"), F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    small = F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)
    n = n.withColumn("pool", F.sum(small).over(W.partitionBy("lang")))
    own, lang = F.concat(F.lit("g"), "own"), F.concat(F.lit("l"), F.coalesce("lang", F.lit("\0")))
    return n.select("own", F.when(F.col("n") >= MIN_GROUP, own).when(F.col("pool") >= MIN_GROUP, lang).otherwise(F.lit("all")).alias("grp"))


def _chi2(x: float, d: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def _consistency(share: float) -> float:
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, _D) < share else (lo, mid)
    return share / _chi2(lo, _D + 2)


def cutoff(z: float = TAIL_Z) -> float:
    """Quantile of the squared distance of clean documents, z normal deviations out."""
    return _D * (1 - 2 / (9 * _D) + z * math.sqrt(2 / (9 * _D))) ** 3


_MODEL = "grp string, " + ", ".join(f"m{i} double" for i in range(_D)) + ", " + ", ".join(f"w{i}_{j} double" for i, j in _PAIRS)


def _whitened(frames):
    """Location and inverse factor of the scatter for rows of summed moments, one per group."""
    floor = np.diag(np.square(FLOORS))
    scale = _consistency(SHARE)
    for f in frames:
        out = []
        for r in f.to_dict("records"):
            s = np.array([r[f"s{i}"] for i in range(_D)]) / r["n"]
            c = np.zeros((_D, _D))
            for i, j in _PAIRS:
                c[i, j] = c[j, i] = r[f"s{i}_{j}"] / r["n"] - s[i] * s[j]
            inv = np.linalg.inv(np.linalg.cholesky(scale * c + floor))
            # sums of doubles depend on their order in the last digits
            out.append([r["grp"], *np.round(s, 9), *[round(inv[i, j], 6) for i, j in _PAIRS]])
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _MODEL.split(", ")])


def _distance():
    z = [sum((F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(1, i + 1)), F.col(f"w{i}_0") * (F.col("x0") - F.col("m0")))
         for i in range(_D)]
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _start(fit: DataFrame) -> DataFrame:
    """First models: medians and quartile ranges of every statistic, read off counts of small bins."""
    long = fit.select("grp", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") * 256).cast("long").alias("bin")) for i in range(_D)])))
    n = long.groupBy("grp", "i", "bin").agg(F.count("*").alias("n"))
    up, all_ = F.sum("n").over(W.partitionBy("grp", "i").orderBy("bin")), F.sum("n").over(W.partitionBy("grp", "i"))
    n = n.withColumn("up", up).withColumn("all", all_)
    at = lambda q: F.min(F.when(F.col("up") >= q * F.col("all"), (F.col("bin") + 0.5) / 256))
    q = n.groupBy("grp", "i").agg(at(0.5).alias("mid"), (at(0.75) - at(0.25)).alias("iqr"))
    of = lambda i, c: F.max(F.when(F.col("i") == i, c))
    return q.groupBy("grp").agg(
        *[of(i, F.col("mid")).alias(f"m{i}") for i in range(_D)],
        *[(1 / of(i, F.sqrt(F.pow(F.col("iqr") / 1.349, 2) + FLOORS[i] ** 2)) if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i, j in _PAIRS])


def _step(fit: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step."""
    d2 = fit.join(models, "grp").select("grp", *[f"x{i}" for i in range(_D)], F.floor(F.log(_distance() + 1e-6) * 32).alias("bin"))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(_D)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS]
    bins = d2.groupBy("grp", "bin").agg(F.count("*").alias("n"), *sums)
    up, all_ = F.sum("n").over(W.partitionBy("grp").orderBy("bin")), F.sum("n").over(W.partitionBy("grp"))
    kept = bins.withColumn("up", up).withColumn("all", all_).where(F.col("up") - F.col("n") < SHARE * F.col("all"))
    total = kept.groupBy("grp").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(_D)], *[f"s{i}_{j}" for i, j in _PAIRS]]],
                                    F.first("all").alias("all"))
    return total.where(F.col("all") >= MIN_GROUP).drop("all").mapInPandas(_whitened, _MODEL)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row of `docs`: doc_id, the base counts, base_failed, distance (squared Mahalanobis; null
    where the group is too small for an estimate) and kept. Null texts are empty, null languages
    and sources are values of their own, repeated rows count each. Documents that fail the base
    rules take no part in estimates. An empty table gives no rows."""
    rows = stored(measured(docs, id_col, text_col, lang_col, source_col), "rules")
    groups = stored(_groups(rows), "rules-groups")
    fit = stored(rows.where(~F.col("base_failed")).join(groups, "own").select("grp", *[f"x{i}" for i in range(_D)]), "rules-fit")
    models = stored(_start(fit), "rules-model")
    for _ in range(STEPS):
        models = stored(_step(fit, models), "rules-model")
    out = rows.join(groups, "own").join(models, "grp", "left").withColumn("distance", F.round(_distance(), 4))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff())
    return out.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance")
