"""Eigendecompositions kept up to date under rank-one changes (numpy, no Spark).

``Spectrum`` holds count, mean and the eigendecomposition of the scatter matrix
(sum of centred outer products) of the points seen. A new point changes the
scatter by a multiple of one outer product, so its eigenvalues are the roots of a
secular equation and its eigenvectors follow from them.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def _deflate(d: np.ndarray, z: np.ndarray, q: np.ndarray, tol: float) -> np.ndarray:
    """Turns the eigenvectors of equal eigenvalues (``d`` ascending) so that one of
    them carries all of their part of ``z``; returns which entries stay coupled.
    ``z`` and ``q`` are changed in place."""
    gaps = np.flatnonzero(np.diff(d) > tol)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps + 1, [len(d)]))
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        part = z[a:b]
        size = np.linalg.norm(part)
        if size == 0.0:
            continue
        # Householder reflection that takes part to its last coordinate.
        v = part.copy()
        v[-1] += size if v[-1] >= 0 else -size
        v /= np.linalg.norm(v)
        q[:, a:b] -= 2.0 * np.outer(q[:, a:b] @ v, v)
        z[a:b] = 0.0
        z[b - 1] = size if part[-1] == 0.0 else 0.0
        z[b - 1] = -size if v[-1] > 0 else size
    return z


def _secular_roots(d: np.ndarray, w: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum w / (d - x) = 0 for ascending distinct ``d`` and positive
    ``w``: one in every (d[i], d[i + 1]), the last beyond d[-1]. Returned as the
    index of the nearest pole and the offset from it, which keeps the
    differences to all poles exact.

    Two-pole rational steps, with bisection where a step leaves its bracket.
    """
    m = len(d)
    upper = np.append(d[1:], d[-1] + rho * w.sum())
    # Sign at the middle tells which pole is the nearer one.
    middle = (d + upper) / 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        f_mid = 1.0 / rho + (w / (d[None, :] - middle[:, None])).sum(1)
    near = np.where((f_mid < 0) & (np.arange(m) < m - 1), np.minimum(np.arange(m) + 1, m - 1), np.arange(m))
    delta = d[None, :] - d[near][:, None]
    half = (upper - d) / 2.0
    right = near > np.arange(m)
    lo = np.where(right, -half, np.where(f_mid < 0, half, 0.0))
    hi = np.where(right, 0.0, np.where(f_mid < 0, 2.0 * half, half))
    x = (lo + hi) / 2.0
    rows = np.arange(m)
    at, after = rows, np.minimum(rows + 1, m - 1)
    below = rows[None, :] <= rows[:, None]
    for _ in range(80):
        gap = delta - x[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            term = w / gap
            f = 1.0 / rho + term.sum(1)
            bound = 8.0 * m * _EPS * (1.0 / rho + np.abs(term).sum(1))
            slope = term / gap
            psi, phi = np.where(below, slope, 0.0).sum(1), np.where(below, 0.0, slope).sum(1)
            lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
            open_ = (np.abs(f) > bound) & (hi - lo > 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if not open_.any():
                break
            g0, g1 = gap[rows, at], gap[rows, after]
            last = rows == m - 1
            a = (g0 + g1) * f - g0 * g1 * (psi + phi)
            b = g0 * g1 * f
            c = f - g0 * psi - g1 * phi
            root = np.sqrt(np.maximum(a * a - 4.0 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2.0 * c), 2.0 * b / (a + root))
            # Behind the last pole: one pole and a constant.
            c0 = f - g0 * psi
            step = np.where(last, g0 + g0 * g0 * psi / np.where(c0 == 0, np.nan, c0), step)
            new = x + step
        inside = np.isfinite(new) & (new > lo) & (new < hi)
        x = np.where(open_, np.where(inside, new, (lo + hi) / 2.0), x)
    return near, x


class Spectrum:
    """Count, mean, and eigenvalues (ascending) and eigenvectors (columns) of the
    scatter matrix of the points added."""

    def __init__(self, dims: int):
        self.n = 0
        self.mean = np.zeros(dims)
        self.values = np.zeros(dims)
        self.vectors = np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        """One more point: the mean moves by (x - mean) / (n + 1) and the scatter grows
        by n / (n + 1) times the outer product of x - mean."""
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.rank_one(away, (self.n - 1) / self.n)

    def rank_one(self, v: np.ndarray, rho: float) -> None:
        """The scatter plus ``rho`` (above 0) times the outer product of ``v``."""
        d, q = self.values, self.vectors
        z = v @ q
        norm = float(z @ z)
        if norm * rho <= 0.0:
            return
        tol = 8.0 * _EPS * max(abs(d[-1]), rho * norm)
        if (np.diff(d) <= tol).any():
            z = _deflate(d, z, q, tol)
        # A coupling too small to move anything is left out.
        live = np.flatnonzero(np.abs(z) * np.sqrt(norm) * rho > tol)
        if not len(live):
            return
        dl, zl = d[live], z[live]
        near, x = _secular_roots(dl, zl * zl, rho)
        # differences[i, j] = dl[j] - root[i], from offsets, without cancellation
        differences = (dl[None, :] - dl[near][:, None]) - x[:, None]
        roots = dl[near] + x
        # The z for which these roots are exact: its eigenvectors are orthogonal.
        m = len(live)
        top = -differences
        bottom = dl[:, None] - dl[None, :]
        np.fill_diagonal(bottom, 1.0)
        ratio = top / np.where(np.eye(m, dtype=bool), 1.0, bottom)
        zz = np.sqrt(np.abs(np.prod(ratio, axis=0)))
        zz = np.where(zl < 0, -zz, zz)
        u = zz[None, :] / differences
        u /= np.linalg.norm(u, axis=1)[:, None]
        q[:, live] = q[:, live] @ u.T
        values = d.copy()
        values[live] = roots
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], q[:, order]

    def merge(self, other: Spectrum) -> None:
        """All points of ``other`` too: one change per eigenpair of its scatter and one
        for the distance of the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean = other.n, other.mean.copy()
            self.values, self.vectors = other.values.copy(), other.vectors.copy()
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.rank_one(vector, float(value))
        both = self.n + other.n
        away = other.mean - self.mean
        if away.any():
            self.rank_one(away, self.n * other.n / both)
        self.mean = self.mean + away * (other.n / both)
        self.n = both

    def scatter(self) -> np.ndarray:
        return (self.vectors * self.values) @ self.vectors.T

    def to_bytes(self) -> bytes:
        return np.concatenate(([float(self.n)], self.mean, self.values, self.vectors.ravel())).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, dims: int) -> Spectrum:
        flat = np.frombuffer(raw, np.float64)
        out = cls(dims)
        out.n, out.mean = int(flat[0]), flat[1:1 + dims].copy()
        out.values = flat[1 + dims:1 + 2 * dims].copy()
        out.vectors = flat[1 + 2 * dims:].reshape(dims, dims).copy()
        return out
