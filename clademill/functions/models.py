"""Substitution models: reversible rate matrices and gamma rate categories."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """P(t) = left @ diag(exp(values * t)) @ right, for each rate category."""

    freqs: np.ndarray
    values: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rates: np.ndarray
    invariant: float = 0.0

    def transition(self, t: float) -> np.ndarray:
        """(category, from, to)."""
        scale = np.exp(np.multiply.outer(self.rates * t, self.values))
        return np.einsum("ik,ck,kj->cij", self.left, scale, self.right)


def reversible(rates: np.ndarray, freqs: np.ndarray, alpha: float | None = None, categories: int = 4, invariant: float = 0.0, median: bool = False) -> Model:
    """rates: symmetric exchangeabilities (states, states). One expected change per unit of time; gamma rates if alpha is given."""
    freqs = np.asarray(freqs, float) / np.sum(freqs)
    q = np.asarray(rates, float) * freqs
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    q /= -(freqs * np.diag(q)).sum()
    root = np.sqrt(freqs)
    values, vectors = np.linalg.eigh(q * root[:, None] / root)
    cats = np.ones(1) if alpha is None else gamma_rates(alpha, categories, median)
    return Model(freqs, values, vectors / root[:, None], vectors.T * root, cats / (1 - invariant), invariant)


def jukes_cantor(alpha: float | None = None) -> Model:
    return reversible(np.ones((4, 4)), np.full(4, 0.25), alpha)


def gtr(exchange: list[float], freqs: list[float], alpha: float | None = None, invariant: float = 0.0) -> Model:
    """exchange: rates of AC, AG, AT, CG, CT, GT."""
    r = np.zeros((4, 4))
    r[np.triu_indices(4, 1)] = exchange
    return reversible(r + r.T, np.asarray(freqs), alpha, invariant=invariant)


def incomplete_gamma(x: float, a: float) -> float:
    """The regularised lower incomplete gamma function: a series for small x, a continued fraction for large."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h


def gamma_quantile(p: float, a: float) -> float:
    """The x at which incomplete_gamma(x, a) is p, by bisection of its logarithm."""
    low, high = -700.0, math.log(a + 50 * math.sqrt(a) + 100)
    for _ in range(200):
        mid = (low + high) / 2
        if incomplete_gamma(math.exp(mid), a) < p:
            low = mid
        else:
            high = mid
    return math.exp((low + high) / 2)


def gamma_rates(alpha: float, k: int = 4, median: bool = False) -> np.ndarray:
    """Rates of k equally likely categories of a gamma distribution of mean 1: the categories' means, or their medians scaled to mean 1."""
    if median:
        mids = np.array([gamma_quantile((2 * i + 1) / (2 * k), alpha) for i in range(k)])
        return mids / mids.mean()
    cuts = [incomplete_gamma(gamma_quantile(i / k, alpha), alpha + 1) for i in range(1, k)]
    return np.diff([0.0, *cuts, 1.0]) * k
