"""Cox models of one cohort as plain numpy loops, to hold the library's fits against."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from cohortspark.functions.cox_kernel import MAX_STEPS, TOLERANCE, _order
from cohortspark.functions.stats import chi2_sf


class Fit(NamedTuple):
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    converged: bool


def fit_one(time: np.ndarray, status: np.ndarray, x: np.ndarray) -> Fit:
    """Newton fit of several covariates."""
    order, first, last = _order(time)
    x = x[order] - x.mean(axis=0)
    s = status[order].astype(float)
    p = x.shape[1]
    d = np.add.reduceat(s, first)
    outer = x[:, :, None] * x[:, None, :]

    def evaluate(b):
        eta = np.clip(x @ b, -500, 500)
        r = np.exp(eta)
        s0, s1, s2 = np.cumsum(r)[last], np.cumsum(r[:, None] * x, axis=0)[last], np.cumsum(r[:, None, None] * outer, axis=0)[last]
        e = r * s
        t0, t1, t2 = np.add.reduceat(e, first), np.add.reduceat(e[:, None] * x, first, axis=0), np.add.reduceat(e[:, None, None] * outer, first, axis=0)
        ll, u, info = float((s * eta).sum()), (s[:, None] * x).sum(axis=0), np.zeros((p, p))
        for k in range(int(d.max(initial=0))):
            on = np.flatnonzero(d > k)
            f = k / d[on]
            a0, a1, a2 = s0[on] - f * t0[on], s1[on] - f[:, None] * t1[on], s2[on] - f[:, None, None] * t2[on]
            m = a1 / a0[:, None]
            ll -= float(np.log(a0).sum())
            u = u - m.sum(axis=0)
            info = info + (a2 / a0[:, None, None] - m[:, :, None] * m[:, None, :]).sum(axis=0)
        return ll, u, info

    b = np.zeros(p)
    ok = False
    with np.errstate(all="ignore"):
        ll, u, info = evaluate(b)
        for _ in range(MAX_STEPS):
            try:
                step = np.linalg.solve(info, u)
            except np.linalg.LinAlgError:
                break
            new = b + step
            ll2, u2, info2 = evaluate(new)
            for _half in range(10):
                if ll2 >= ll - 1e-12:
                    break
                new = (new + b) / 2
                ll2, u2, info2 = evaluate(new)
            ok = abs(ll2 - ll) <= TOLERANCE * max(1.0, abs(ll2))
            b, ll, u, info = new, ll2, u2, info2
            if ok:
                break
        try:
            cov = np.linalg.inv(info)
        except np.linalg.LinAlgError:
            cov = np.full((p, p), np.nan)
    return Fit(b, cov, ll, ok)


def ph_test(time: np.ndarray, status: np.ndarray, x: np.ndarray) -> list[tuple[float, float, float]]:
    """CX9: score test of each coefficient's change with Kaplan-Meier time, then of all: (chi-square, df, p)."""
    fit = fit_one(time, status, x)
    order, first, last = _order(time)
    xs, s = x[order] - x.mean(axis=0), status[order].astype(float)
    r = np.exp(np.clip(xs @ fit.beta, -500, 500))
    p = x.shape[1]
    outer = xs[:, :, None] * xs[:, None, :]
    s0, s1, s2 = np.cumsum(r)[last], np.cumsum(r[:, None] * xs, axis=0)[last], np.cumsum(r[:, None, None] * outer, axis=0)[last]
    e = r * s
    t0, t1, t2 = np.add.reduceat(e, first), np.add.reduceat(e[:, None] * xs, first, axis=0), np.add.reduceat(e[:, None, None] * outer, first, axis=0)
    d, xd = np.add.reduceat(s, first), np.add.reduceat(s[:, None] * xs, first, axis=0)
    # transform: one minus the survival just before each time (times fall along the arrays)
    n = last + 1.0
    g = 1 - np.append(np.cumprod((1 - d / n)[::-1])[:-1][::-1], 1.0) if len(d) > 1 else np.zeros(1)
    g = g - (g * d).sum() / d.sum()
    u, v11, v12, v22 = np.zeros(p), np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
    for i in range(len(d)):
        for k in range(int(d[i])):
            f = k / d[i]
            a0, a1, a2 = s0[i] - f * t0[i], s1[i] - f * t1[i], s2[i] - f * t2[i]
            m = a1 / a0
            v = a2 / a0 - np.outer(m, m)
            u += g[i] * (xd[i] / d[i] - m)
            v11, v12, v22 = v11 + v, v12 + g[i] * v, v22 + g[i] ** 2 * v
    try:
        inner = v22 - v12 @ np.linalg.inv(v11) @ v12
        out = [(float(u[j] ** 2 / inner[j, j]), 1.0) for j in range(p)]
        out.append((float(u @ np.linalg.solve(inner, u)), float(p)))
    except np.linalg.LinAlgError:
        return [(math.nan, 1.0, math.nan)] * p + [(math.nan, float(p), math.nan)]
    return [(c, df, chi2_sf(c, df)) for c, df in out]


def fine_gray(time: np.ndarray, code: np.ndarray, x: np.ndarray, cause: int) -> tuple[np.ndarray, np.ndarray]:
    """Every patient against every event: weights after competing events, Efron ties, clustered sandwich."""
    x = x - x.mean(axis=0)
    n, p = x.shape

    def censored_before(t):
        out = 1.0
        for u in np.unique(time[(time < t) & (code == 0)]):
            left = (time >= u).sum() - ((time == u) & (code != 0)).sum()
            out *= 1 - ((time == u) & (code == 0)).sum() / left if left else 1.0
        return out

    times = np.unique(time[code == cause])
    other = (code != 0) & (code != cause)
    w = np.array([[1.0 if time[i] >= t else censored_before(t) / censored_before(time[i]) if other[i] else 0.0 for t in times] for i in range(n)])
    steps = [(k, j / d) for k, t in enumerate(times) for d in [((time == t) & (code == cause)).sum()] for j in range(d)]
    b = np.zeros(p)
    for _ in range(30):
        r, u, info, means = np.exp(x @ b), np.zeros(p), np.zeros((p, p)), []
        for k, f in steps:
            mine = (time == times[k]) & (code == cause)
            v = w[:, k] * r * np.where(mine, 1 - f, 1.0)
            m = v @ x / v.sum()
            means.append((m, v.sum(), mine, f))
            u += x[mine].mean(axis=0) - m
            info += (x * v[:, None]).T @ x / v.sum() - np.outer(m, m)
        b = b + np.linalg.solve(info, u)
    res = np.zeros((n, p))
    for (k, _), (m, s0, mine, f) in zip(steps, means, strict=True):
        res[mine] += (x[mine] - m) / mine.sum()
        res -= (w[:, k] * r * np.where(mine, 1 - f, 1.0) / s0)[:, None] * (x - m)
    inv = np.linalg.inv(info)
    return b, inv @ (res.T @ res) @ inv
