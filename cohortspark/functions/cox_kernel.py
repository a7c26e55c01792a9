"""Numpy kernels for Cox models of one cohort: Efron ties, many single markers at once, or several covariates."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

MAX_STEPS, TOLERANCE = 20, 1e-12
#: A fit beyond these is not estimable.
MAX_BETA, MAX_SE = 20.0, 10.0


class Batch(NamedTuple):
    """One entry per marker."""

    beta: np.ndarray
    se: np.ndarray
    n: np.ndarray
    events: np.ndarray
    loglik: np.ndarray
    score0: np.ndarray
    converged: np.ndarray


def _order(time: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by falling time, and first and last row of each distinct time."""
    order = np.argsort(-time, kind="stable")
    t = time[order]
    last = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    return order, np.concatenate([[0], last[:-1] + 1]), last


def fit_many(time: np.ndarray, status: np.ndarray, x: np.ndarray) -> Batch:
    """Newton fits of one covariate each; x is rows by markers, NaN rows of a marker weigh nothing."""
    order, first, last = _order(time)
    x, s = x[order], status[order].astype(float)
    use = np.isfinite(x)
    x = np.where(use, x, 0.0)
    mean = np.where(use.any(axis=0), x.sum(axis=0) / np.maximum(use.sum(axis=0), 1), 0)
    x = np.where(use, x - mean, 0.0)
    ev = use * s[:, None]
    d = np.add.reduceat(ev, first, axis=0)
    most = int(d.max(initial=0))
    events = ev.sum(axis=0)
    total = (ev * x).sum(axis=0)

    def evaluate(b: np.ndarray):
        eta = np.clip(x * b, -500, 500)
        r = use * np.exp(eta)
        s0, s1, s2 = (np.cumsum(v, axis=0)[last] for v in (r, r * x, r * x * x))
        t0, t1, t2 = (np.add.reduceat(v * s[:, None], first, axis=0) for v in (r, r * x, r * x * x))
        ll, u, info = (ev * eta).sum(axis=0), total.copy(), np.zeros(x.shape[1])
        for k in range(most):
            on = d > k
            f = np.where(on, k / np.maximum(d, 1), 0)
            a0 = np.where(on, s0 - f * t0, 1.0)
            a1, a2 = (np.where(on, p - f * q, 0.0) for p, q in ((s1, t1), (s2, t2)))
            m = a1 / a0
            ll -= np.log(a0).sum(axis=0)
            u -= m.sum(axis=0)
            info += (a2 / a0 - m * m).sum(axis=0)
        return ll, u, info

    b = np.zeros(x.shape[1])
    with np.errstate(all="ignore"):
        ll, u, info = evaluate(b)
        score0 = u.copy()
        done = np.zeros(len(b), dtype=bool)
        for _ in range(MAX_STEPS):
            step = np.where(done | (info <= 0), 0.0, u / info)
            new = b + step
            ll2, u2, info2 = evaluate(new)
            for _half in range(10):
                worse = ~done & ~(ll2 >= ll - 1e-12)
                if not worse.any():
                    break
                new = np.where(worse, (new + b) / 2, new)
                ll2, u2, info2 = evaluate(new)
            done |= np.abs(ll2 - ll) <= TOLERANCE * np.maximum(1.0, np.abs(ll2))
            b, ll, u, info = new, ll2, u2, info2
            if done.all():
                break
        se = 1 / np.sqrt(info)
    return Batch(b, se, use.sum(axis=0), events, ll, score0, done)


class Shared(NamedTuple):
    """One entry per marker: the marker's coefficient and error beside covariates that all markers share."""

    beta: np.ndarray
    se: np.ndarray
    converged: np.ndarray


#: Condition number of the information from which columns count as dependent.
MOST_CONDITION = 1e12


def fit_shared(time: np.ndarray, status: np.ndarray, x: np.ndarray, z: np.ndarray) -> Shared:
    """Newton fits of every marker (a column of x; NaN rows weigh nothing) with the same covariates z (rows by columns).

    The sums at risk are arrays of rows by markers for every pair of columns of (marker, z), so all markers move together and
    each has its own small system to solve.
    """
    order, first, last = _order(time)
    x, z, s = x[order], z[order], status[order].astype(float)
    use = np.isfinite(x)
    x = np.where(use, x, 0.0)
    p, wide = 1 + z.shape[1], x.shape[1]
    column = lambda i: x if i == 0 else z[:, i - 1 : i]
    ev = use * s[:, None]
    d = np.add.reduceat(ev, first, axis=0)
    most = int(d.max(initial=0))
    total = np.stack([(ev * column(i)).sum(axis=0) for i in range(p)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def evaluate(b: np.ndarray):
        eta = np.clip(x * b[0] + z @ b[1:], -500, 500)
        r = use * np.exp(eta)
        sums = {}
        for key, v in [((), r), *(((i,), r * column(i)) for i in range(p)), *(((i, j), r * column(i) * column(j)) for i, j in pairs)]:
            sums[key] = np.cumsum(v, axis=0)[last], np.add.reduceat(v * s[:, None], first, axis=0)
        ll, u, info = (ev * eta).sum(axis=0), total.copy(), np.zeros((wide, p, p))
        for k in range(most):
            on = d > k
            f = np.where(on, k / np.maximum(d, 1), 0)
            a = {key: np.where(on, a - f * t, 0.0) for key, (a, t) in sums.items()}
            a0 = np.where(on, a[()], 1.0)
            m = [a[(i,)] / a0 for i in range(p)]
            ll -= np.log(a0).sum(axis=0)
            for i in range(p):
                u[i] -= m[i].sum(axis=0)
            for i, j in pairs:
                v = (a[i, j] / a0 - m[i] * m[j]).sum(axis=0)
                info[:, i, j] += v
                info[:, j, i] = info[:, i, j]
        return ll, u, info

    b = np.zeros((p, wide))
    with np.errstate(all="ignore"):
        ll, u, info = evaluate(b)
        done, dead = np.zeros(wide, dtype=bool), np.zeros(wide, dtype=bool)
        for _ in range(MAX_STEPS):
            dead |= ~np.isfinite(info).all(axis=(1, 2))
            sound = np.where(dead[:, None, None], np.eye(p), info)
            dead |= ~(np.linalg.cond(sound) < MOST_CONDITION)
            step = np.zeros((p, wide))
            move = ~(done | dead)
            if not move.any():
                break
            step[:, move] = np.linalg.solve(info[move], u[:, move].T[:, :, None])[:, :, 0].T
            new = b + step
            ll2, u2, info2 = evaluate(new)
            for _half in range(10):
                worse = move & ~(ll2 >= ll - 1e-12)
                if not worse.any():
                    break
                new = np.where(worse, (new + b) / 2, new)
                ll2, u2, info2 = evaluate(new)
            done |= move & (np.abs(ll2 - ll) <= TOLERANCE * np.maximum(1.0, np.abs(ll2)))
            b, ll, u, info = new, ll2, u2, info2
        se = np.full(wide, np.nan)
        good = np.isfinite(info).all(axis=(1, 2)) & ~dead
        se[good] = np.sqrt(np.linalg.inv(info[good])[:, 0, 0])
    return Shared(b[0], se, done & ~dead)


def verdict(beta: float, se: float, converged: bool) -> str | None:
    """CX6: why a coefficient is not estimable, or None."""
    if not converged:
        return "did not converge"
    if not (math.isfinite(beta) and math.isfinite(se)):
        return "estimate not finite"
    if se <= 0:
        return "standard error not positive"
    if abs(beta) > MAX_BETA:
        return "coefficient beyond 20"
    if se > MAX_SE:
        return "standard error beyond 10"
    return None
