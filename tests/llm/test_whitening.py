"""Spectra under rank-one updates and whitening, against dense solutions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import spectra, whitening
from offerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("d, n", [(1, 4), (2, 1), (5, 3), (6, 200), (40, 90)])
@pytest.mark.parametrize("kind", ["random", "flat", "repeated", "far"])
def test_updates_give_the_scatter(d, n, kind):
    r = np.random.default_rng(d * n)
    x = r.integers(-50, 50, (n, d))
    x = {"random": x, "flat": x * (np.arange(d) < d // 2), "repeated": np.repeat(x[:max(1, n // 3)], 3, axis=0), "far": x * 10 ** 5 + 10 ** 9}[kind]
    whole, first, second = spectra.Spectrum(d), spectra.Spectrum(d), spectra.Spectrum(d)
    whole.add(x)
    first.add(x[:len(x) // 3])
    second.add(x[len(x) // 3:])
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    for s in (whole, first.combine(spectra.Spectrum.of(*second.row()))):
        top = max(np.abs(scatter).max(), 1)
        assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() < 1e-11 * top
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-11
        assert s.n == len(x) and list(s.sums) == list(x.sum(axis=0)) and (np.diff(s.values) >= 0).all()


def test_roots_lie_between_old_values():
    r = np.random.default_rng(4)
    for k in (1, 2, 3, 30):
        d = np.cumsum(10.0 ** r.uniform(-9, 2, k))
        z2 = 10.0 ** r.uniform(-12, 0, k)
        z2 /= z2.sum()
        origin, t = spectra.secular_roots(d, z2, 3.0)
        got = d[origin] + t
        exact = np.linalg.eigvalsh(np.diag(d) + 3.0 * np.sqrt(np.outer(z2, z2)))
        assert np.abs(got - exact).max() < 1e-11 * exact.max()


def _expected(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(u.T, bias=True).reshape(x.shape[1], -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, :4] / np.sqrt(values[:4]), values / values.sum()


def _holds(got, ids, x):
    n, deviation, white, shares = _expected(x)
    p = got.toPandas()
    assert len(p) == len(x) * min(4, x.shape[1]) and set(p.n) == {n} and p.identity_error.max() < 1e-9
    for k, part in p.groupby("component"):
        part = part.set_index("vec_id").loc[ids]
        assert list(part.deviation) == list(deviation) and np.allclose(part.explained, shares[k - 1], rtol=1e-9)
        away = white[:, k - 1]
        assert min(np.abs(part.whitened - away).max(), np.abs(part.whitened + away).max()) < 1e-8


@pytest.mark.parametrize("fan", [2, 16])
def test_query_equals_the_dense_solution(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.array(e.embedding.tolist()).astype(float)).astype(int)
    _holds(QUERIES["op13_embedding_whitening"](spark, SF), e.vec_id, x)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, whitened int, part string").withColumn("n", F.lit("clash"))


def test_unusable_and_repeated_vectors(spark):
    r = np.random.default_rng(2)
    good = [(i, [float(v) for v in r.normal(size=6)], "c", 1, "p") for i in range(60)]
    bad = [(100, None, "c", 1, "p"), (101, [1.0] * 5 + [None], "c", 1, "p"), (102, [float("nan")] * 6, "c", 1, "p"), (103, [float("-inf")] + [0.0] * 5, "c", 1, "p")]
    x = np.floor(256 * np.array([g[1] for g in good])).astype(int)
    got = whitening.whiten(_vectors(spark, [*good, *bad]))
    _holds(got, [g[0] for g in good], x)
    n, _, _, _ = _expected(x)
    twice = whitening.whiten(_vectors(spark, [*good, *good[:30], *bad]))
    assert twice.count() == 4 * 90 and {r.n for r in twice.select("n").distinct().collect()} == {n}


def test_degenerate_tables(spark):
    none = whitening.whiten(_vectors(spark, [(1, None, "c", 1, "p")]))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(_vectors(spark, [(1, [], "c", 1, "p")])).count() == 0
    one = whitening.whiten(_vectors(spark, [(None, [0.5, 0.25], "c", 1, "p")] * 3)).collect()
    assert len(one) == 6 and all((r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (None, 1, 0, None, None, None) for r in one)
    line = whitening.whiten(_vectors(spark, [(i, [float(i), 2.0 * i, 7.0], "c", 1, "p") for i in range(5)])).collect()
    assert len(line) == 15 and all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-9
    assert {round(r.explained, 9) for r in line} == {0.0, 1.0}
    ragged = whitening.whiten(_vectors(spark, [(1, [1.0], "c", 1, "p"), (2, [1.0, 2.0], "c", 1, "p"), (3, [3.0, 0.0], "c", 1, "p"), (4, [3.0], "c", 1, "p")])).collect()
    assert len(ragged) == 8 and {r.n for r in ragged} == {3}


def test_deviation_is_exact_or_null(spark):
    big = [(i, [float(v)], "c", 1, "p") for i, v in enumerate((2.0 ** 20, -2.0 ** 21, 2.0 ** 62, 5.0))]
    exact = {r.vec_id: r.deviation for r in whitening.whiten(_vectors(spark, big[:2] + big[3:])).collect()}
    xs = {0: 1 << 28, 1: -(1 << 29), 3: 1280}
    assert exact == {i: (3 * x - sum(xs.values())) ** 2 for i, x in xs.items()}
    assert all(r.deviation is None for r in whitening.whiten(_vectors(spark, big)).collect())
