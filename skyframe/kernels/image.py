"""Image filters, demosaicing and geometry of one frame."""

from __future__ import annotations

import numpy as np


def gaussian_kernel(radius: float) -> np.ndarray:
    """Normalised; trimmed where what is left out is under 1/510, at most 100 on a side."""
    half = np.arange(-100, 101)
    k = np.exp(-(half**2) / (2 * radius * radius))
    k /= k.sum()
    keep = 100
    while keep > 0 and k[:101 - keep].sum() * 2 < 1 / 510 and k[100 - keep : 101 + keep].sum() > 1 - 1 / 510:
        keep -= 1
    k = k[100 - keep - 1 : 101 + keep + 1] if keep < 100 else k
    return k / k.sum()


def gaussian_blur(img: np.ndarray, radius: float) -> np.ndarray:
    """Separable, edges clamped."""
    k = gaussian_kernel(radius)
    h = len(k) // 2
    for axis in (0, 1):
        padded = np.pad(img, [(h, h) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        img = sum(c * np.take(padded, np.arange(i, i + img.shape[axis]), axis=axis) for i, c in enumerate(k))
    return img


def box_mean(img: np.ndarray, before: int, after: int) -> np.ndarray:
    """Mean of the values other than 0 in the box from -before to +after."""
    total, n = np.zeros(img.shape), np.zeros(img.shape)
    h, w = img.shape
    for dy in range(-before, after + 1):
        for dx in range(-before, after + 1):
            ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
            v = img[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
            total[ys, xs] += v
            n[ys, xs] += v != 0
    return np.where(n > 0, total / np.maximum(n, 1), 0.0)


def fill_black_spots(img: np.ndarray) -> np.ndarray:
    """Pixels of 0 within the data's bounds take the mean of the first ring (radius 1 to 9) that has values."""
    out = img.copy()
    ys, xs = np.nonzero(img)
    if not len(ys):
        return out
    for y, x in zip(*np.nonzero(img[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] == 0), strict=True):
        y, x = y + ys.min(), x + xs.min()
        for r in range(1, 10):
            box = img[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
            if (v := box[box != 0]).size:
                out[y, x] = v.mean()
                break
    return out


def block_mode(img: np.ndarray, size: int) -> np.ndarray:
    """Each block takes its most frequent level (of several, the lowest)."""
    out = img.copy()
    for y in range(0, img.shape[0], size):
        for x in range(0, img.shape[1], size):
            levels, n = np.unique(np.floor(img[y : y + size, x : x + size] + 0.5), return_counts=True)
            out[y : y + size, x : x + size] = levels[n.argmax()]
    return out


def without_gradient(img: np.ndarray, dark: tuple[float, float], bright: tuple[float, float], half: int = 20) -> np.ndarray:
    """Subtracts the linear gradient from the dark to the bright place (x, y), by the modes of boxes around them."""
    def mode(p):
        x, y = map(int, p)
        levels, n = np.unique(np.floor(img[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1] + 0.5), return_counts=True)
        return levels[n.argmax()]

    dx, dy = bright[0] - dark[0], bright[1] - dark[1]
    y, x = np.mgrid[: img.shape[0], : img.shape[1]]
    t = ((x - dark[0]) * dx + (y - dark[1]) * dy) / (dx * dx + dy * dy)
    return img - (mode(bright) - mode(dark)) * t


def rotate(img: np.ndarray, degrees: float, samples: int = 8) -> np.ndarray:
    """Rotated about its centre (anticlockwise with y up) on a canvas that holds all of it; each pixel is the mean of
    what its area covers. Quarter turns are exact."""
    turns = degrees / 90
    if turns == int(turns):
        return np.rot90(img, -int(turns) % 4)
    a = np.deg2rad(degrees)
    c, s = np.cos(a), np.sin(a)
    h, w = img.shape
    nw, nh = int(np.ceil(abs(w * c) + abs(h * s) - 1e-9)), int(np.ceil(abs(w * s) + abs(h * c) - 1e-9))
    total, n = np.zeros((nh, nw)), 0
    off = (np.arange(samples) + 0.5) / samples - 0.5
    y, x = np.mgrid[:nh, :nw].astype(float)
    for oy in off:
        for ox in off:
            u, v = x + ox - (nw - 1) / 2, y + oy - (nh - 1) / 2
            sx, sy = np.floor(c * u + s * v + (w - 1) / 2 + 0.5).astype(int), np.floor(-s * u + c * v + (h - 1) / 2 + 0.5).astype(int)
            ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
            total += np.where(ok, img[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0.0)
            n += 1
    return total / n


def resize(img: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear."""
    h, w = int(img.shape[0] * factor + 0.5), int(img.shape[1] * factor + 0.5)
    y, x = np.clip((np.arange(h) + 0.5) / factor - 0.5, 0, img.shape[0] - 1), np.clip((np.arange(w) + 0.5) / factor - 0.5, 0, img.shape[1] - 1)
    yi, xi = np.minimum(y.astype(int), max(0, img.shape[0] - 2)), np.minimum(x.astype(int), max(0, img.shape[1] - 2))
    fy, fx = (y - yi)[:, None], (x - xi)[None, :]
    at = lambda dy, dx: img[np.ix_(np.minimum(yi + dy, img.shape[0] - 1), np.minimum(xi + dx, img.shape[1] - 1))]
    return at(0, 0) * (1 - fy) * (1 - fx) + at(0, 1) * (1 - fy) * fx + at(1, 0) * fy * (1 - fx) + at(1, 1) * fy * fx


def _masks(shape: tuple[int, int], pattern: str) -> dict[str, np.ndarray]:
    y, x = np.mgrid[: shape[0], : shape[1]]
    at = np.array(list(pattern))[(y % 2) * 2 + x % 2]
    return {c: at == c for c in "RGB"}


def _near(v: np.ndarray, places: list[tuple[int, int]]) -> np.ndarray:
    p = np.pad(v, 1)
    return sum(p[1 + dy : 1 + dy + v.shape[0], 1 + dx : 1 + dx + v.shape[1]] for dx, dy in places)


ALL = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
CROSS = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def demosaic(img: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """Bilinear, (3, h, w); the border of one pixel stays 0."""
    out = np.zeros((3, *img.shape))
    for k, (c, m) in enumerate(_masks(img.shape, pattern).items()):
        places = CROSS if c == "G" else ALL
        n = _near(m.astype(float), places)
        out[k] = np.where(m, img, _near(np.where(m, img, 0.0), places) / np.maximum(n, 1))
    out[:, [0, -1], :] = 0
    out[:, :, [0, -1]] = 0
    return out


def demosaic_spread(img: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """Each raw pixel spread to the 2 x 2 that begin at it, colours averaged where they meet."""
    out = np.zeros((3, *img.shape))
    for k, m in enumerate(_masks(img.shape, pattern).values()):
        places = [(0, 0), (-1, 0), (0, -1), (-1, -1)]
        n = _near(m.astype(float), places)
        out[k] = _near(np.where(m, img, 0.0), places) / np.maximum(n, 1)
    return out


def demosaic_star_colours(img: np.ndarray, pattern: str = "RGGB", sky: float = 0.0, saturated: float = 60000.0, radius: int = 5) -> np.ndarray:
    """Bilinear; a pixel with a saturated neighbour takes the colour of the unsaturated light in a disc around it."""
    out = demosaic(img, pattern)
    bad = _near((img >= saturated).astype(float), ALL) > 0
    j, i = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    disc = list(zip(i[i * i + j * j <= radius * radius], j[i * i + j * j <= radius * radius], strict=True))
    for y, x in zip(*np.nonzero(bad), strict=True):
        at = [(y + dy, x + dx) for dx, dy in disc if 0 <= y + dy < img.shape[0] and 0 <= x + dx < img.shape[1] and not bad[y + dy, x + dx]]
        light = np.array([max(0.0, np.mean([out[k][p] for p in at]) - sky) for k in range(3)]) if at else np.ones(3)
        light[1] = max(light[1], min(light[0], light[2]))
        out[:, y, x] = saturated * (light / light.max() if light.max() > 0 else np.ones(3))
    return out


def pattern_of(pattern: str, x_offset: int = 0, y_offset: int = 0, bottom_up: bool = False) -> str:
    """The pattern as it is after offsets, and with rows from the bottom."""
    rows = [pattern[:2], pattern[2:]]
    if x_offset % 2:
        rows = [r[::-1] for r in rows]
    if (y_offset + bottom_up) % 2:
        rows = rows[::-1]
    return "".join(rows)


def mosaic(frames: list[tuple[np.ndarray, int, int]], cap: float) -> np.ndarray:
    """Frames with the place of their corner, in order: each is levelled to what is there by the mean of the capped
    differences, and fades in by its distance from its own border."""
    h, w = max(y + f.shape[0] for f, _, y in frames), max(x + f.shape[1] for f, x, _ in frames)
    out, weight = np.zeros((h, w)), np.zeros((h, w))
    for f, x, y in frames:
        at = (slice(y, y + f.shape[0]), slice(x, x + f.shape[1]))
        j, i = np.mgrid[: f.shape[0], : f.shape[1]]
        own = np.minimum.reduce([i, j, f.shape[1] - 1 - i, f.shape[0] - 1 - j]) + 1.0
        both = weight[at] > 0
        level = np.clip(out[at] - f, -cap, cap)[both].mean() if both.any() else 0.0
        total = weight[at] + own
        out[at] = (out[at] * weight[at] + (f + level) * own) / total
        weight[at] = total
    return out
