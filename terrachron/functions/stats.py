"""Distributions and solvers in plain numpy: F and chi-square tails, robust fits, bounded least squares."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-30)
        c = 1 + num / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 10.0
    while gamma_inc(k / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_inc(k / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def robust_fit(x: np.ndarray, y: np.ndarray, kind: str = "bisquare", tune: float = 4.685, rounds: int = 5) -> np.ndarray:
    """Coefficients by iteratively re-weighted least squares, scale from the median absolute residual."""
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    q = np.linalg.qr(x)[0]
    leverage = np.clip((q * q).sum(axis=1), 0, 0.9999)
    for _ in range(rounds):
        r = y - x @ b
        adj = r / np.sqrt(1 - leverage) if kind == "bisquare" else r
        s = np.median(np.sort(np.abs(adj))[max(0, x.shape[1] - 1) :]) / 0.6745
        if s <= 1e-6 * max(1.0, np.abs(y).max()):
            break
        u = np.abs(adj) / (tune * s)
        w = np.where(u < 1, (1 - u * u) ** 2, 0) if kind == "bisquare" else np.where(u > 1, 1 / np.maximum(u, 1e-12), 1.0)
        sw = np.sqrt(w)
        new = np.linalg.lstsq(x * sw[:, None], y * sw, rcond=None)[0]
        if np.abs(new - b).max() <= 1e-9 * max(1.0, np.abs(b).max()):
            b = new
            break
        b = new
    return b


def lasso(x: np.ndarray, y: np.ndarray, lam: float, rounds: int = 500, tol: float = 1e-7) -> np.ndarray:
    """Intercept and coefficients of the lasso for columns x (standardised inside), by cyclic coordinate descent
    (Friedman, Hastie and Tibshirani 2010)."""
    mean, sd, ym = x.mean(axis=0), x.std(axis=0), y.mean()
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - mean) / sd
    n, p = z.shape
    b, r = np.zeros(p), y - ym
    for _ in range(rounds):
        worst = 0.0
        for j in range(p):
            rho = z[:, j] @ r / n + b[j]
            new = math.copysign(max(abs(rho) - lam, 0.0), rho) if z[:, j].any() else 0.0
            if new != b[j]:
                r -= z[:, j] * (new - b[j])
                worst = max(worst, abs(new - b[j]))
                b[j] = new
        if worst < tol * max(1.0, np.abs(y - ym).max()):
            break
    b = b / sd
    return np.r_[ym - mean @ b, b]


def robust_fits(x: np.ndarray, y: np.ndarray, ok: np.ndarray, kind: str = "bisquare", tune: float = 4.685, rounds: int = 5) -> np.ndarray:
    """robust_fit of many: x (fits, steps, terms), y and ok (fits, steps); only the steps that are ok count.

    Each fit is solved in its own orthonormal basis, where the weighted products stay well conditioned, and leaves the work
    when it has converged. Those of dependent terms, or with weights that leave too few steps, go the plain way."""
    x, y, n, p = x * ok[:, :, None], np.where(ok, y, 0.0), ok.sum(axis=1), x.shape[2]
    u, d, v = np.linalg.svd(x, full_matrices=False)
    plain = (n < p) | (d[:, -1] <= 1e-10 * d[:, 0])
    back = np.einsum("fqp,fq->fpq", v, 1 / np.where(d > 0, d, 1.0))
    leverage = np.clip((u * u).sum(axis=2), 0, 0.9999)
    first = max(0, p - 1)
    low, high = (first + (n - first - 1) // 2).clip(0), (first + (n - first) // 2).clip(0, x.shape[1] - 1)
    floor = 1e-6 * np.maximum(1.0, np.abs(y).max(axis=1, initial=0))
    c = np.einsum("fsp,fs->fp", u, y)
    b = np.einsum("fpq,fq->fp", back, c)
    live = np.flatnonzero(~plain)
    for _ in range(rounds):
        if not len(live):
            break
        ul, yl = u[live], y[live]
        r = yl - (ul @ c[live][..., None])[..., 0]
        adj = np.abs(r / np.sqrt(1 - leverage[live]) if kind == "bisquare" else r)
        order = np.sort(np.where(ok[live], adj, np.inf), axis=1)
        at = np.arange(len(live))
        s = (order[at, low[live]] + order[at, high[live]]) / 2 / 0.6745
        go = s > floor[live]
        live, ul, yl, adj, s = live[go], ul[go], yl[go], adj[go], s[go]
        a = adj / (tune * s)[:, None]
        w = np.where(a < 1, (1 - a * a) ** 2, 0) if kind == "bisquare" else np.where(a > 1, 1 / np.maximum(a, 1e-12), 1.0)
        wu = ul * w[:, :, None]
        g = wu.transpose(0, 2, 1) @ ul
        e = np.linalg.eigvalsh(g)
        bad = e[:, 0] <= 1e-8 * e[:, -1]
        plain[live[bad]] = True
        live, wu, yl, g = live[~bad], wu[~bad], yl[~bad], g[~bad]
        c[live] = np.linalg.solve(g, np.einsum("fsp,fs->fp", wu, yl)[..., None])[..., 0]
        new = np.einsum("fpq,fq->fp", back[live], c[live])
        done = np.abs(new - b[live]).max(axis=1) <= 1e-9 * np.maximum(1.0, np.abs(b[live]).max(axis=1))
        b[live] = new
        live = live[~done]
    for k in np.flatnonzero(plain):
        b[k] = robust_fit(x[k][ok[k]], y[k][ok[k]], kind, tune, rounds)
    return b


def lassos(problems: list[tuple[np.ndarray, np.ndarray]], lam: float, rounds: int = 500, tol: float = 1e-7) -> list[np.ndarray]:
    """lasso of many: problems of columns x (steps, terms) and rows y (bands, steps); (bands, 1 + terms) of each. The steps
    of the descent are made for all bands of all problems together, on the products of the columns."""
    out: list[np.ndarray] = [np.empty(0)] * len(problems)
    for p, bands in {(x.shape[1], len(y)) for x, y in problems}:
        own = [k for k, (x, y) in enumerate(problems) if (x.shape[1], len(y)) == (p, bands)]
        size = np.array([len(problems[k][0]) for k in own])
        ok, n = np.arange(size.max()) < size[:, None], size[:, None]
        z, r = np.zeros((*ok.shape, p)), np.zeros((*ok.shape, bands))
        z[ok], r[ok] = np.concatenate([problems[k][0] for k in own]), np.concatenate([problems[k][1].T for k in own])
        mean, ym = z.sum(axis=1) / n, r.sum(axis=1) / n
        z, r = (z - mean[:, None]) * ok[:, :, None], (r - ym[:, None]) * ok[:, :, None]
        sd = np.sqrt((z * z).sum(axis=1) / n)
        sd[sd == 0] = 1.0
        z /= sd[:, None]
        # a band of a problem is a column from here on
        g = np.repeat((z.transpose(0, 2, 1) @ z / n[:, :, None]).transpose(1, 2, 0), bands, axis=2)
        c = (z.transpose(0, 2, 1) @ r / n[:, :, None]).transpose(1, 0, 2).reshape(p, -1)
        stop = tol * np.maximum(1.0, np.abs(r).max(axis=1)).ravel()
        b, found, held = np.zeros(c.shape), np.zeros(c.shape), np.arange(c.shape[1])
        going = np.ones(len(held), bool)
        for _ in range(rounds):
            worst = np.zeros(len(held))
            for j in range(p):
                rho = c[j] - (g[j] * b).sum(axis=0) + b[j]
                new = np.copysign(np.maximum(np.abs(rho) - lam, 0.0), rho)
                np.maximum(worst, np.abs(new - b[j]), out=worst)
                b[j] = new
            done = going & (worst < stop)
            found[:, held[done]] = b[:, done]
            going &= ~done
            if 4 * going.sum() < 3 * len(held):
                held, g, c, stop, b = held[going], g[:, :, going], c[:, going], stop[going], b[:, going]
                going = np.ones(len(held), bool)
                if not len(held):
                    break
        found[:, held[going]] = b[:, going]
        coef = found.T.reshape(len(own), bands, p) / sd[:, None]
        first = ym - (coef @ mean[:, :, None])[..., 0]
        for k, row in zip(own, np.concatenate([first[:, :, None], coef], axis=2)):
            out[k] = row
    return out


def bounded_fits(f, t: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Levenberg-Marquardt on weighted residuals of many fits at once, parameters held in their bounds by a sine transform.

    t, y, w: (fits, steps); start, low, high: (fits, parameters). f(params, t) gets the parameters as (parameters, fits, 1).
    Each fit has a damping of its own and leaves the work when a step gains less than a millionth or none helps.
    """
    span = np.where(high > low, high - low, 1.0)
    u = np.arcsin(np.clip(2 * (np.clip(start, low, high) - low) / span - 1, -0.999999, 0.999999))
    sw, m = np.sqrt(w), u.shape[1]

    def rest(u, k):
        p = low[k] + (np.sin(u) + 1) / 2 * span[k]
        r = sw[k] * (y[k] - f(p.T[:, :, None], t[k]))
        return np.clip(np.nan_to_num(r, nan=1e6, posinf=1e6, neginf=-1e6), -1e6, 1e6)

    with np.errstate(all="ignore"):
        live = np.arange(len(u))
        r = rest(u, live)
        cost, mu = (r * r).sum(axis=1), np.full(len(u), 1e-3)
        for _ in range(rounds):
            if not len(live):
                break
            h = 1e-6
            jac = np.stack([(rest(u[live] + h * e, live) - r[live]) / h for e in np.eye(m)], axis=2)
            g, a = np.einsum("stk,st->sk", jac, r[live]), np.einsum("stk,stl->skl", jac, jac)
            scale = np.maximum(np.einsum("skk->sk", a), 1e-9)
            better, gain = np.zeros(len(live), bool), np.zeros(len(live))
            for _ in range(8):
                todo = np.flatnonzero(~better)
                if not len(todo):
                    break
                k = live[todo]
                left = a[todo] + (mu[k, None] * scale[todo] + 1e-12)[:, :, None] * np.eye(m)
                v = u[k] + np.linalg.solve(left, -g[todo][..., None])[..., 0]
                q = rest(v, k)
                c = (q * q).sum(axis=1)
                good = c < cost[k]
                won = k[good]
                gain[todo[good]] = (cost[won] - c[good]) / np.maximum(cost[won], 1e-300)
                u[won], r[won], cost[won] = v[good], q[good], c[good]
                mu[won] /= 3
                mu[k[~good]] *= 4
                better[todo[good]] = True
            live = live[better & (gain >= 1e-6)]
    return low + (np.sin(u) + 1) / 2 * span
