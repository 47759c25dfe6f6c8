"""Spectra of scatter matrices under rank-one updates.

U diag(values) U' + rho v v' has the eigenvalues that solve the secular equation
1 + rho sum z_i^2 / (values_i - t) = 0 with z = U'v, one between each two old ones. Places where z
is nothing, and pairs of equal values after a rotation, are deflated: they stay as they are. Roots
are kept as distances from their nearest old value, and vectors come from the z that has exactly
these roots, which keeps them orthogonal."""
from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
_ROUNDS = 100


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float):
    """(origin, distance) of the roots of 1 + rho sum z2 / (d - t), d ascending and apart, z2 > 0
    with sum one: root i lies between d[i] and the next, origin is the index of its nearest d."""
    k = len(d)
    if k == 1:
        return np.zeros(1, int), np.array([rho * z2[0]])
    upper = np.append(d[1:], d[-1] + rho)
    half = (upper - d) / 2
    gap = d[None, :] - d[:, None]
    i = np.arange(k)
    right = 1 + rho * (z2 / (gap - half[:, None])).sum(axis=1) < 0
    right[-1] = False
    origin = np.where(right, i + 1, i)
    delta = d[None, :] - d[origin][:, None]
    far = upper - d[origin]  # the last root has no old value above: the bound of the interval stands in
    near = d - d[origin]
    lo, hi = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    hi[-1] = rho
    t = (lo + hi) / 2
    below = np.tri(k, dtype=bool)
    open_ = np.ones(k, bool)
    for _ in range(_ROUNDS):
        diff = delta - t[:, None]
        term = rho * z2 / diff
        slope = term / diff
        f = 1 + term.sum(axis=1)
        lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
        open_ &= (np.abs(f) > EPS * k * (1 + np.abs(term).sum(axis=1))) & (hi - lo > 2 * EPS * np.abs(t))
        if not open_.any():
            break
        left = np.where(below, slope, 0).sum(axis=1)
        all_ = slope.sum(axis=1)
        a1, a2 = near - t, far - t
        c = f - a1 * left - a2 * (all_ - left)
        a = (a1 + a2) * f - a1 * a2 * all_
        b = a1 * a2 * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = t + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        t = np.where(open_, new, t)
    return origin, t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float):
    """Spectrum of vectors diag(values) vectors' + rho v v' with rho >= 0; values ascend."""
    z = vectors.T @ v
    norm = np.sqrt(z @ z)
    if not rho * norm * norm > 0:
        return values, vectors
    z, rho = z / norm, rho * norm * norm
    tol = 8 * EPS * max(np.abs(values).max(), rho * np.abs(z).max())
    keep = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(keep):
        return values, vectors
    a, b = keep[:-1], keep[1:]
    tau2 = z[a] ** 2 + z[b] ** 2
    if (np.abs((values[b] - values[a]) * z[a] * z[b]) <= tol * tau2).any():
        values, vectors, stay, p = values.copy(), vectors.copy(), [], keep[0]
        for q in keep[1:]:
            tau = np.hypot(z[p], z[q])
            c, s = z[q] / tau, -z[p] / tau
            if abs((values[q] - values[p]) * c * s) <= tol:
                x, y = vectors[:, p].copy(), vectors[:, q]
                vectors[:, p], vectors[:, q] = c * x + s * y, c * y - s * x
                values[p], values[q] = values[p] * c * c + values[q] * s * s, values[p] * s * s + values[q] * c * c
                z[p], z[q] = 0.0, tau
            else:
                stay.append(p)
            p = q
        keep = np.array([*stay, p])
        keep = keep[np.argsort(values[keep], kind="stable")]
    d, zk = values[keep], z[keep]
    origin, t = secular_roots(d, zk * zk / (zk @ zk), rho * (zk @ zk))
    diff = (d[None, :] - d[origin][:, None]) - t[:, None]  # old value less root, a row for each root
    gap = d[:, None] - d[None, :]
    np.fill_diagonal(gap, 1.0)
    zhat = np.copysign(np.sqrt(np.abs(np.prod(diff / gap, axis=0))), zk)
    q = zhat[:, None] / diff.T
    q /= np.sqrt((q * q).sum(axis=0))
    values, vectors = values.copy(), vectors.copy()
    values[keep] = d[origin] + t
    vectors[:, keep] = vectors[:, keep] @ q
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and spectrum of the scatter about the mean of integer vectors."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean = 0, np.zeros(d, object), np.zeros(d)
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray):
        """Rows of 64-bit integers, each a centred rank-one update."""
        self.sums = self.sums + exact_sums(x)
        for v in x.astype(float):
            self._merge(1, v)

    def _merge(self, n, mean):
        away, whole = mean - self.mean, self.n + n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * n / whole)
        self.mean = self.mean + away * (n / whole)
        self.n = whole

    def combine(self, other: Spectrum):
        """The other's vectors are added one by one, then the distance of the means."""
        if not self.n:
            self.__dict__.update(other.__dict__)
        elif other.n:
            for value, v in zip(other.values, other.vectors.T):
                if value > 0:
                    self.values, self.vectors = rank_one(self.values, self.vectors, v, value)
            self.sums = self.sums + other.sums
            self._merge(other.n, other.mean)
        return self

    def row(self):
        return self.n, ",".join(map(str, self.sums)), np.concatenate([self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def of(cls, n, sums, data):
        flat = np.frombuffer(data)
        d = int(round((len(flat) + 1) ** 0.5)) - 1  # d^2 + 2d numbers
        s = cls(d)
        s.n, s.sums = n, np.array([int(x) for x in sums.split(",")], object)
        s.mean, s.values, s.vectors = flat[:d].copy(), flat[d:2 * d].copy(), flat[2 * d:].reshape(d, d).copy()
        return s


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    if not len(x) or np.abs(x.astype(float)).max() * len(x) < 2.0 ** 62:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)
