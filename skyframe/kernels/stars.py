"""Star detection and measurement in one frame."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def smedian(v: np.ndarray) -> float:
    """See operators.robust.smedian; NaN if empty."""
    n = len(v)
    if not n:
        return float("nan")
    v = np.sort(v)
    h = n // 2
    return float(v[h - 1 : h + 1].mean() if n % 2 == 0 else v[h - 1 : h + 2].mean() if n >= 5 else v[h])


def background(img: np.ndarray, top: int = 65000) -> tuple[float, float]:
    """Most frequent level up to the mean (or the mean where it is 1.5 times as much), and the noise about it."""
    v = np.floor(img + 0.5).astype(np.int64).ravel()
    v = v[(v >= 1) & (v < top)]
    if not len(v):
        return 0.0, 0.0
    counts = np.bincount(v)
    mean = int(np.floor(v.sum() / (len(v) + 1) + 0.5))
    level = float(counts[: mean + 1].argmax()) if mean and counts[: mean + 1].any() else float(mean)
    level = float(mean) if mean > 1.5 * level else level
    sd, near = np.inf, img[(img < 2 * level) & (img != 0)] - level
    for _ in range(7):
        used = near[np.abs(near) <= 3 * sd] if np.isfinite(sd) else near
        new = float(np.sqrt((used * used).mean())) if len(used) else 0.0
        if np.isfinite(sd) and sd - new < 0.05 * new:
            sd = new
            break
        sd = new
    return level, sd


def _sub(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values; 0 near the edges."""
    h, w = img.shape
    xi, yi = np.floor(x).astype(int), np.floor(y).astype(int)
    ok = (xi > 0) & (xi < w - 2) & (yi > 0) & (yi < h - 2)
    xi, yi, fx, fy = np.where(ok, xi, 1), np.where(ok, yi, 1), x - np.floor(x), y - np.floor(y)
    v = img[yi, xi] * (1 - fx) * (1 - fy) + img[yi, xi + 1] * fx * (1 - fy) + img[yi + 1, xi] * (1 - fx) * fy + img[yi + 1, xi + 1] * fx * fy
    return np.where(ok, v, 0.0)


@lru_cache(maxsize=64)
def _grid(half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a square of that half width about its middle: columns, rows, distances, and the square rings' numbers."""
    j, i = np.mgrid[-half : half + 1, -half : half + 1]
    return i, j, np.sqrt(i * i + j * j), np.maximum(np.abs(i), np.abs(j))


@lru_cache(maxsize=64)
def _around(radius: int, outer: int) -> np.ndarray:
    """The pixels of a square that are further than radius from its middle, up to outer."""
    i, j, _, _ = _grid(outer)
    away = i * i + j * j
    return (away > radius * radius) & (away <= outer * outer)


#: Fixed values of a star's measurement.
LIT = 3.0  # deviations of the sky over which a pixel belongs to the star
LEAST_FLUX = 12.0  # deviations that the lit pixels of a box add up to at least
FILLED = 2 / 9  # of a box's pixels that are lit when it is no wider than its star
FADED = 0.1  # of the fullest radius: a radius with no more lit pixels than that ends the aperture
SPARSE = 0.35  # of the square inside the aperture that its lit pixels cover at least
FINE = 5  # steps a pixel within an aperture smaller than the star


def _box_sizes(radius: int) -> np.ndarray:
    """Half widths of the boxes that are tried: every second one down to 4 or 3, then each down to 2."""
    wide = [*range(radius, 4, -2)]
    return np.array([*wide, *range(wide[-1] - 2 if wide else radius, 1, -1)] or [radius])


def _box(cut: np.ndarray, sizes: np.ndarray, sd: float, near: tuple[float, float, float, float]) -> tuple[int, float, float] | None:
    """Of the boxes of those half widths, all about the cut's middle, the first that is filled: half width and centroid of
    its lit pixels. If none is, the half width is 1 and the centroid the last box's. None if a box up to there has too little
    light, a single lit pixel, or a centroid that is closer than its half width to the edge of the frame, which is `near`
    (left, right, bottom, top) from the middle.

    A box is all square rings up to its half width, so the sums of all boxes are running sums over rings."""
    middle = len(cut) // 2
    lit = cut > LIT * sd
    i, j, _, ring = (g[lit] for g in _grid(middle))
    v = cut[lit]
    light, count, right, up = (np.cumsum(np.bincount(ring, w, middle + 1))[sizes] for w in (v, None, v * i, v * j))
    enough = (light > LEAST_FLUX * sd) & (count > 1)
    x, y = right / np.where(enough, light, 1), up / np.where(enough, light, 1)
    left, far, low, high = near
    enough &= (x + left >= sizes) & (far - x >= sizes) & (y + low >= sizes) & (high - y >= sizes)
    filled = count >= FILLED * (2 * sizes + 1) ** 2
    at = int(filled.argmax()) if filled.any() else len(sizes) - 1
    return (int(sizes[at]) if filled[at] else 1, float(x[at]), float(y[at])) if enough[: at + 1].all() else None


def _aperture(radius: np.ndarray, widest: int) -> int | None:
    """The first radius at which the lit pixels, given by their radii, have faded out; None if there is none below
    `widest`, or if too few are lit inside it."""
    lit = np.bincount(radius, minlength=widest + 1)
    so_far = np.cumsum(lit)
    faded = (so_far > 0) & (lit <= FADED * np.maximum.accumulate(lit))
    r = int(faded[:widest].argmax())
    return r if faded[:widest].any() and (r <= 2 or so_far[r] >= SPARSE * (2 * r - 2) ** 2) else None


def measure(img: np.ndarray, x: int, y: int, radius: int = 14, aperture: float = 99.0) -> dict | None:
    """Half-flux diameter, width, flux, signal to noise and centre of the star at (x, y); None if there is none.

    The sky is the robust median of a ring just outside `radius`, its deviation the scaled robust median of the distances
    from it. The centre is the centroid of the lit pixels of the widest box that they fill (`_box`). About it, values are read at
    whole steps; the aperture ends where the lit ones have faded out (`_aperture`). Flux is the sum of the aperture's
    square over the sky; the half-flux diameter is twice the mean distance weighted by it; the width is that of a disc of
    as many pixels as reach half the peak. A star that reaches beyond a smaller `aperture` is read at FINE steps a pixel: its flux
    is what lies within that radius, and its diameter what the whole star's light gives over that flux."""
    h, w = img.shape
    outer = radius + (3 if aperture < 99 else 1)
    if not (outer < x < w - 1 - outer and outer < y < h - 1 - outer):
        return None
    cut = img[y - outer : y + outer + 1, x - outer : x + outer + 1]
    ring = cut[_around(radius, outer)]
    sky = smedian(ring)
    sd = max(smedian(np.abs(ring - sky)) * 1.4826, 1.0)
    box = _box(cut - sky, _box_sizes(radius), sd, (x, w - 1 - x, y, h - 1 - y))
    if box is None:
        return None
    half, xc, yc = box[0], x + box[1], y + box[2]
    widest = half + 2
    i, j, far, square = _grid(widest)
    value = _sub(img, xc + i, yc + j) - sky
    radii = np.floor(far + 0.5).astype(int)
    lit = (radii <= widest) & (value > LIT * sd)
    r = _aperture(radii[lit], widest)
    if r is None:
        return None
    peak, reach, steps = value[lit].max(initial=0.0), float(r), 1
    value, far = value[square <= r], far[square <= r]
    if r >= aperture:
        reach, steps = aperture, FINE
        at = np.arange(-r * FINE, r * FINE + 1) / FINE
        far = np.hypot(*np.meshgrid(at, at))
        value = _sub(img, *np.meshgrid(xc + at, yc + at)) - sky
    share = 1 / steps**2  # of a pixel that a value stands for
    flux = max(float(value[far <= reach].sum() if steps > 1 else value.sum()) * share, 1e-5)
    wide = int((value >= peak / 2).sum()) * share
    hfd = max(0.7, 2 * float((value * far).sum()) * share / flux)
    return {"x": xc, "y": yc, "hfd": hfd, "fwhm": 2 * np.sqrt(wide / np.pi), "flux": flux, "snr": flux / np.sqrt(flux + np.pi * (reach * sd) ** 2), "sd": sd}


def _disc(r: int) -> tuple[np.ndarray, np.ndarray]:
    i, j, far, _ = _grid(r)
    return i[far <= r], j[far <= r]


def _detected(img: np.ndarray, level: float, hfd_min: float, hfd_max: float, snr_min: float, known: dict[int, dict | None]) -> list[dict]:
    """Stars at pixels over the level, in raster order, each of which takes the disc of 1.5 HFD about it for itself. `known`
    keeps what was measured at a pixel, which is the same at each level."""
    h, w = img.shape
    free = np.ones((h, w), bool)
    out = []
    bright = np.flatnonzero(img > level)
    while len(bright):
        at, bright = int(bright[0]), bright[1:]
        if at not in known:
            known[at] = measure(img, at % w, at // w)
        star = known[at]
        if star is None or not hfd_min < star["hfd"] <= hfd_max or star["snr"] <= snr_min:
            continue
        cx, cy, r = (int(np.floor(v + 0.5)) for v in (star["x"], star["y"], 1.5 * star["hfd"]))
        if not free[cy, cx]:
            continue
        i, j = _disc(r)
        on = (cx + i >= 0) & (cx + i < w) & (cy + j >= 0) & (cy + j < h)
        free[(cy + j)[on], (cx + i)[on]] = False
        out.append(star)
        bright = bright[free.ravel()[bright]]
    return out


def find(img: np.ndarray, least: int = 500, hfd_min: float = 0.8, hfd_max: float = 10.0, levels: tuple[float, ...] = (30, 7, 3), snr_min: float = 10.0) -> list[dict]:
    """Stars in raster order, at the highest of the levels (in deviations of the noise over the sky) that gives `least`
    stars, or else at the lowest."""
    sky, noise = background(img)
    found: list[dict] = []
    known: dict[int, dict | None] = {}
    for k in levels:
        found = _detected(img, sky + k * noise, hfd_min, hfd_max, snr_min, known)
        if len(found) >= least:
            break
    return found


#: Fixed values of an analysis: skies that can be analysed, and pixels for each star wanted at the first two levels.
DARKEST, LIGHTEST = 8, 60000
PIXELS_PER_STAR = (6, 24)


def _star_levels(img: np.ndarray, sky: float, noise: float, least: int, top: int = 65000) -> list[float]:
    """Over the sky, the levels at which PIXELS_PER_STAR times `least` pixels are as bright, and 3.5 deviations if there is none."""
    v = np.floor(img + 0.5).astype(np.int64).ravel()
    as_bright = np.bincount(v[(v >= 1) & (v < top)], minlength=top)[::-1].cumsum()[::-1]
    out, below = [], top
    for k in PIXELS_PER_STAR:
        there = np.flatnonzero(as_bright[int(sky) + 1 : below] >= k * least)
        below = int(sky) + 1 + int(there[-1]) if len(there) else 0
        out.append(max(3.5 * noise, 1.0, below - sky - 1))
    return out


def analysed(img: np.ndarray, least: int = 500, hfd_min: float = 0.8, hfd_max: float = 10.0, snr_min: float = 30.0) -> list[dict]:
    """The stars over snr_min from which a frame's median HFD is taken, in raster order: at the levels of its brightest pixels
    where they are over 30 deviations of the noise, then at 30, then at 7, until `least` are found. None on a sky that is too
    dark or light."""
    sky, noise = background(img)
    found: list[dict] = []
    known: dict[int, dict | None] = {}
    if DARKEST < sky < LIGHTEST:
        for level in [*(v for v in _star_levels(img, sky, noise, least) if v > 30 * noise), 30 * noise, 7 * noise]:
            found = _detected(img, sky + level, hfd_min, hfd_max, snr_min, known)
            if len(found) >= least:
                break
    return found


def local_deviation(img: np.ndarray) -> tuple[float, float]:
    """Mean and deviation, values over 3 deviations off left out, until the deviation moves by less than 3 per cent."""
    v = img.ravel()
    mean, sd = float(v.mean()), float(v.std())
    for _ in range(7):
        used = v[np.abs(v - mean) <= 3 * sd]
        new_mean, new = float(used.mean()), float(used.std())
        done = abs(sd - new) < 0.03 * max(new, 1e-12)
        mean, sd = new_mean, new
        if done:
            break
    return mean, sd


def neighbour_medians(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each star's value replaced by the median of its own and its two nearest stars' (as they were)."""
    out = v.astype(float).copy()
    if len(v) < 3:
        return out
    for i in range(len(v)):
        d = (x - x[i]) ** 2 + (y - y[i]) ** 2
        d[i] = np.inf
        out[i] = np.median([v[i], *v[np.argsort(d, kind="stable")[:2]]])
    return out


def elongation(img: np.ndarray, x: float, y: float, radius: int = 14) -> float | None:
    """Longest over shortest extent of the star over half its peak, over 180 directions; None without 4 pixels or over 5."""
    x0, y0 = int(round(x)), int(round(y))
    cut = img[max(0, y0 - radius) : y0 + radius + 1, max(0, x0 - radius) : x0 + radius + 1]
    sky = smedian(cut.ravel())
    j, i = np.nonzero(cut - sky > (cut.max() - sky) / 2)
    if len(i) < 4:
        return None
    a = np.deg2rad(np.arange(180))
    along = np.abs(np.outer(np.cos(a), i - i.mean()) + np.outer(np.sin(a), j - j.mean())).mean(1)
    ratio = float(along.max() / max(along.min(), 1e-9))
    return ratio if ratio <= 5 else None
