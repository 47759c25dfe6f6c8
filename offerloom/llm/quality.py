"""Quality scores of documents by histogram gradient-boosted trees over document statistics."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting

#: Labelled documents the trees are fitted on at most; of more, those with the smallest hashes.
SAMPLE = 20_000
HELD_OUT, FOLDS, KEEP = 2, 4, 0.7
_SYMBOLS, _STOPS = b"#*$%&<>", b".,;:"
_CHUNK = 1 << 20


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; only the text is looked at."""
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.zeros(256, np.int64)
    for i in range(0, len(data), _CHUNK):
        count += np.bincount(np.frombuffer(data, np.uint8, min(_CHUNK, len(data) - i), i), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    n, m = max(1, len(data)), max(1, len(words))
    grams = len(set(zip(words, words[1:], words[2:])))
    part = lambda chars: float(count[list(chars)].sum()) / n
    lower, upper, digit = count[97:123].sum(), count[65:91].sum(), count[48:58].sum()
    ends = sum(1 for w in words if w.endswith((b".", b"!", b"?")))
    return [
        np.log1p(len(data)), np.log1p(len(words)), (n - count[[32, *range(9, 14)]].sum()) / m, lower / n, upper / n, digit / n,
        part(b" "), count[10] / m, part(b"|"), part(_SYMBOLS), part(b"!?"), part(_STOPS), part(b"@/=_\\+~^"), part(b"\"'()[]{}-"),
        float(count[128:].sum()) / n, len(set(words)) / m, grams / max(1, len(words) - 2), len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), ends / m, np.log1p(max(map(len, words), default=0)), count[32:48].max() / n]


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], np.float32).reshape(len(texts), -1)


def held_out(id_col):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> boosting.Trees:
    """Trees that predict labels.quality. Rows of the held-out remainder are never used; of a
    document with several labels the largest counts. `sample` bounds what is collected."""
    pick = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(
        F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(pick), "doc_id")

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])
    got = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(
        run, "doc_id long, quality int, x array<float>").toPandas()
    if not len(got):
        return boosting.fit(np.empty((0, 1)), np.empty(0))
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort([*x.T[::-1], got["doc_id"].to_numpy()])
    return boosting.fit(x[order], got["quality"].to_numpy()[order])


def score(docs: DataFrame, trees: boosting.Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row."""
    def run(batches):
        for b in batches:
            p = trees.probability(_matrix(b.column(1))) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`. Null texts are empty ones and are
    scored; a null doc_id is not held out. Without labels, or with labels of one class, every
    score is the prior. An empty table gives no rows."""
    scored = score(docs, fit(docs, labels, sample, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, in all their columns, whose score is at least `keep`. Texts and scores
    stay together: the whole row passes through the same task."""
    trees = fit(docs, labels, sample, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(trees.probability(_matrix(b.column(at).cast(pa.string()))) >= keep))
    return docs.mapInArrow(run, docs.schema)
