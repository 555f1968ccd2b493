"""Orbits: Kepler's equation and positions, vectorised over rows; the hyperbola of focus runs."""

from __future__ import annotations

import numpy as np

GAUSS = 0.01720209895  # Gauss's constant: radians a day at 1 AU


def kepler(m: np.ndarray, e: np.ndarray, steps: int = 60) -> np.ndarray:
    """Eccentric (e < 1) or hyperbolic (e > 1) anomaly of a mean anomaly, by safeguarded Newton steps."""
    m, e = np.broadcast_arrays(np.asarray(m, float), np.asarray(e, float))
    closed = e < 1
    m = np.where(closed, np.remainder(m + np.pi, 2 * np.pi) - np.pi, m)
    x = np.where(closed, m + 0.85 * e * np.sign(np.sin(m)), np.arcsinh(m / np.maximum(e, 1e-9)))
    for _ in range(steps):
        f = np.where(closed, x - e * np.sin(x) - m, e * np.sinh(np.clip(x, -50, 50)) - x - m)
        d = np.where(closed, 1 - e * np.cos(x), e * np.cosh(np.clip(x, -50, 50)) - 1)
        step = np.clip(f / np.maximum(np.abs(d), 1e-12), -1, 1)
        x = x - step
        if np.max(np.abs(step), initial=0) < 1e-14:
            break
    return x


def state(q, e, incl, node, peri, dt) -> tuple[np.ndarray, ...]:
    """Ecliptic position (AU) and velocity (AU a day) dt days after perihelion, for perihelion distance q and angles in
    radians."""
    q, e, incl, node, peri, dt = np.broadcast_arrays(*[np.asarray(v, float) for v in (q, e, incl, node, peri, dt)])
    par = np.abs(e - 1) < 1e-9
    w = 1.5 * GAUSS * dt / np.sqrt(2 * q**3)
    y = np.cbrt(w + np.sqrt(w * w + 1))
    t = y - 1 / y  # tan(nu / 2) of the parabola
    a = q / np.where(par, 1.0, np.abs(1 - e))
    x = kepler(GAUSS * dt / a**1.5, np.where(par, 0.5, e))
    ell = e < 1
    half = np.where(ell, np.sqrt((1 + e) / np.where(ell & ~par, 1 - e, 1.0)) * np.tan(np.where(ell, x, 0) / 2), np.sqrt((e + 1) / np.where(~ell & ~par, e - 1, 1.0)) * np.tanh(np.where(ell, 0, x) / 2))
    nu = 2 * np.arctan(np.where(par, t, half))
    r = q * (1 + e) / (1 + e * np.cos(nu))
    u = peri + nu
    c, s, ci, si, cn, sn = np.cos(u), np.sin(u), np.cos(incl), np.sin(incl), np.cos(node), np.sin(node)
    out = np.stack([cn * c - sn * s * ci, sn * c + cn * s * ci, s * si])  # away from the Sun
    along = np.stack([-cn * s - sn * c * ci, -sn * s + cn * c * ci, c * si])  # a quarter further on
    pace = GAUSS / np.sqrt(q * (1 + e))
    return tuple(r * out) + tuple(pace * (e * np.sin(nu) * out + (1 + e * np.cos(nu)) * along))


def position(q, e, incl, node, peri, dt) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return state(q, e, incl, node, peri, dt)[:3]


def fit_hyperbola(pos: np.ndarray, hfd: np.ndarray) -> tuple[float, float, float] | None:
    """Position of the best focus, least HFD and width of hfd = low * sqrt(1 + ((pos - at) / width)^2): hfd^2 is a
    parabola in pos, refined by Gauss-Newton steps on the relative error. None with fewer than 3 points."""
    pos, hfd = np.asarray(pos, float), np.asarray(hfd, float)
    if len(pos) < 3:
        return None
    mid, scale = pos.mean(), max(np.ptp(pos), 1e-9)
    c2, c1, c0 = np.polyfit((pos - mid) / scale, hfd**2, 2)
    if c2 <= 0:
        return None
    at, low2 = -c1 / (2 * c2), max(c0 - c1 * c1 / (4 * c2), 1e-6)
    p = np.array([at, np.sqrt(low2), np.sqrt(low2 / c2)])
    x = (pos - mid) / scale
    for _ in range(50):
        k = np.sqrt(1 + ((x - p[0]) / p[2]) ** 2)
        model = p[1] * k
        jac = np.stack([-p[1] * (x - p[0]) / (k * p[2] ** 2), k, -p[1] * (x - p[0]) ** 2 / (k * p[2] ** 3)], 1) / hfd[:, None]
        step = np.linalg.lstsq(jac, (hfd - model) / hfd, rcond=None)[0]
        if not np.isfinite(step).all():
            break
        p = p + np.clip(step, -0.5 * np.abs(p) - 0.1, 0.5 * np.abs(p) + 0.1)
        if np.abs(step).max() < 1e-12:
            break
    return float(p[0] * scale + mid), float(p[1]), float(abs(p[2]) * scale)


def vsop(terms: np.ndarray, tau: float) -> float:
    """Sum of A cos(B + C tau) tau^n over rows (n, A, B, C)."""
    n, a, b, c = np.asarray(terms, float).reshape(-1, 4).T
    return float((a * np.cos(b + c * tau) * tau**n).sum())
