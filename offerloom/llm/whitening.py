"""Whitening of embeddings on the components of their covariance.

Every distinct vector of integers is fitted once. Each partition keeps the spectrum of the scatter
of its vectors: a vector is one centred rank-one update, solved by the secular equation with
deflation (`spectra`). Spectra of partitions are combined in rounds of FAN, again by rank-one
updates, one for each vector of the other and one for the distance of the means; sums are exact
integers. The basis found so is refined by Rayleigh-Ritz: every partition projects its vectors,
centred by the exact means, and the small matrix of their products is solved once more. All that
reaches the driver are matrices of the vectors' width, whatever the number of rows."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .spectra import EPS, Spectrum

SCALE, COMPONENTS = 256, 4
#: Partial results that one task of a round combines.
FAN = 16
_ROWS = 4096


@dataclass
class Whitening:
    """Fitted once; small enough to travel with the tasks."""
    n: int                   # distinct vectors
    sums: np.ndarray         # their exact sums by dimension, Python integers
    components: np.ndarray   # unit eigenvectors as columns, by falling eigenvalue
    values: np.ndarray       # their eigenvalues of the covariance, divisor n; 0.0 where nothing varies
    explained: np.ndarray    # shares of the trace, NaN if nothing varies
    identity_error: float    # largest entry of the whitened covariance less the identity, NaN without components

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], float)


def integers(vec: Column) -> Column:
    """floor(256 c) of each entry as double; null where the vector is null or has an entry that is
    null or not finite. Products beyond 64 bits become the largest or smallest integer."""
    inf = F.lit(float("inf"))
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < inf))
    return F.when(vec.isNotNull() & fine, F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def quantised(rows: DataFrame, vec_col: str = "embedding", out: str = "x") -> DataFrame:
    """Rows whose vector is usable, with `out` (replaced if there). Shorter vectors than the longest
    are filled up with zeros."""
    x = rows.withColumn(out, integers(F.col(vec_col))).where(F.col(out).isNotNull())
    d = x.agg(F.max(F.size(out))).first()[0] or 0
    return x.withColumn(out, F.concat(out, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(out))))


def _matrix(a: pa.Array) -> np.ndarray:
    return a.flatten().to_numpy().reshape(len(a), -1)


def _blocks(batches):
    for b in batches:
        for k in range(0, len(b), _ROWS):
            yield _matrix(b.column(0).slice(k, _ROWS))


def _reduced(parts: DataFrame, merge, schema: str, name: str) -> list:
    """Rows (part, ...) combined in rounds, FAN partitions' rows in a task, until FAN remain."""
    parts = stored(parts.withColumn("part", F.spark_partition_id().cast("long")), name)
    while parts.count() > FAN:
        parts = stored(parts.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInPandas(
            lambda key, pdf: pd.DataFrame([(*merge(pdf.drop(columns="part").itertuples(index=False)), key[0])], columns=pdf.columns),
            f"{schema}, part long"), name)
    return merge(parts.drop("part").collect())


def _spectra(vectors: DataFrame) -> Spectrum:
    def run(batches):
        s = None
        for x in _blocks(batches):
            s = s or Spectrum(x.shape[1])
            s.add(x)
        if s:
            yield pa.RecordBatch.from_pylist([dict(zip(("n", "sums", "data"), s.row()))], pa.schema([("n", pa.int64()), ("sums", pa.string()), ("data", pa.binary())]))

    def merge(rows):
        rows = [Spectrum.of(r[0], r[1], bytes(r[2])) for r in rows]
        for other in rows[1:]:
            rows[0].combine(other)
        return rows[0].row()
    schema = "n long, sums string, data binary"
    return Spectrum.of(*_reduced(vectors.mapInArrow(run, schema), merge, schema, "spectra"))


def _products(vectors: DataFrame, project, width: int) -> np.ndarray:
    """Sums of y and of y y' over all vectors, y = project(x), as one matrix of width + 1 rows."""
    def run(batches):
        total = np.zeros((width + 1, width))
        for x in _blocks(batches):
            y = project(x)
            total += np.vstack([y.sum(axis=0), y.T @ y])
        yield pa.RecordBatch.from_pylist([{"data": total.tobytes()}], pa.schema([("data", pa.binary())]))

    def merge(rows):
        return (sum((np.frombuffer(bytes(r[0])) for r in rows), np.zeros((width + 1) * width)).tobytes(),)
    return np.frombuffer(_reduced(vectors.mapInArrow(run, "data binary"), merge, "data binary", "products")[0]).reshape(width + 1, width)


def _covariance(total: np.ndarray, n: int) -> np.ndarray:
    mean = total[0] / n
    return total[1:] / n - np.outer(mean, mean)


def fit(rows: DataFrame, x_col: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """Fit over each distinct vector of `x_col` once; None without vectors or without dimensions.
    Repeated rows change nothing. A component along which nothing varies has the value 0."""
    vectors = stored(rows.select(F.col(x_col).alias("x")).where(F.size("x") > 0).distinct(), "vectors")
    if vectors.isEmpty():
        return None
    rough = _spectra(vectors)
    n, d = rough.n, len(rough.sums)
    mean = np.array([s / n for s in rough.sums], float)
    basis = np.linalg.qr(rough.vectors)[0]
    cov = _covariance(_products(vectors, lambda x: (x - mean) @ basis, d), n)
    values, turn = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace, top = float(np.trace(cov)), basis @ turn[:, order]
    top /= np.sqrt((top * top).sum(axis=0))
    values = np.where(values[order] > d * EPS * trace, values[order], 0.0)
    model = Whitening(n, rough.sums, top, values, values / trace if trace > 0 else np.full(len(order), np.nan), float("nan"))
    some = values > 0
    if some.any():
        out = _covariance(_products(vectors, lambda x: _project(model, x)[:, some], int(some.sum())), n)
        model.identity_error = float(np.abs(out - np.eye(len(out))).max())
    return model


def _project(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Whitened rows; NaN along components without variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.values > 0, 1 / np.sqrt(model.values), np.nan)
    return ((x - model.mean) @ model.components) * scale


def deviations(model: Whitening, x: np.ndarray) -> list:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    bound = float(np.abs(x.astype(float)).max(initial=0)) * model.n + float(max(map(abs, model.sums), default=0))
    if bound ** 2 * x.shape[1] < 2.0 ** 62:
        away = model.n * x - model.sums.astype(np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = [int(s) for s in ((model.n * x.astype(object) - model.sums) ** 2).sum(axis=1)]
    return [s if s < 1 << 63 else None for s in exact]


def whitened(rows: DataFrame, model: Whitening, x_col: str = "x") -> DataFrame:
    """All rows and columns with `whitened` (array<double>, one entry a component, null where nothing
    varies) and `deviation` (null beyond 64 bits); columns of these names are replaced."""
    @F.arrow_udf("struct<whitened: array<double>, deviation: bigint>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            x = _matrix(a)
            w = _project(model, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())))
            yield pa.StructArray.from_arrays([lists, pa.array(deviations(model, x), pa.int64())], ["whitened", "deviation"])
    made = rows.withColumn("whitened", project(F.col(x_col)))
    return made.withColumns({"deviation": F.col("whitened.deviation"), "whitened": F.col("whitened.whitened")})


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable
    row of the input, repeated ones too, and each component up to `components`. Vectors that are
    null, or hold null or non-finite entries, give none; so do vectors without dimensions and an
    empty table. Where nothing varies along a component, whitened is null and explained 0; if
    nothing varies at all, explained and identity_error are null."""
    schema = rows.select(F.col(id_col).alias("vec_id")).schema.simpleString()[7:-1].replace(":", " ", 1) + \
        ", component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    usable = quantised(rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vector")), "vector").drop("vector")
    model = fit(usable, components=components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def number(v):
        return F.lit(None if np.isnan(v) else float(v)).cast("double")
    shares = F.array(*[number(v) for v in model.explained])
    return whitened(usable, model).select("vec_id", "deviation", F.posexplode_outer("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), number(model.identity_error).alias("identity_error"))
