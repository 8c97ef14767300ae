"""Preparing scans for reading: noise, contrast, slant, threshold, crops, previews. Plain numpy; images are BGR uint8. Parity with other libraries'
filters is not claimed, their purpose is."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

from .raster import bgr, binarised, components, grey, otsu, resized

LEAST_ANGLE, MOST_ANGLE = 0.3, 30.0


def _neighbours(g: np.ndarray, r: int) -> np.ndarray:
    """The (2r + 1)^2 shifted copies of a grey image, its border repeated."""
    wide = np.pad(g, r, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(wide, (2 * r + 1, 2 * r + 1)).reshape(*g.shape, -1)


def denoised(image: np.ndarray) -> np.ndarray:
    """IMG3: the median of three by three pixels, in each channel."""
    return np.stack([np.median(_neighbours(c, 1), axis=-1) for c in np.moveaxis(image, 2, 0)], 2).astype(np.uint8)


def equalised(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """IMG4: contrast-limited adaptive equalisation of the brightness: a clipped histogram for each tile, and between tiles' centres the mean of their
    curves by distance. Colours are scaled along with the brightness."""
    g = grey(image)
    h, w = g.shape
    ys, xs = (np.linspace(0, n, tiles + 1).astype(int) for n in (h, w))
    curves = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = g[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * part.size / 256)
            over = np.maximum(n - most, 0).sum()
            curves[i, j] = np.cumsum(np.minimum(n, most) + over / 256) * 255 / part.size

    def place(n: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.interp(np.arange(n) + 0.5, (edges[:-1] + edges[1:]) / 2, np.arange(tiles))
        low = np.minimum(at.astype(int), tiles - 2) if tiles > 1 else np.zeros(n, int)
        return low, np.minimum(low + 1, tiles - 1), at - low

    (t, b, fy), (l, r, fx) = place(h, ys), place(w, xs)
    fy, fx = fy[:, None], fx[None, :]
    look = lambda rows, columns: curves[rows[:, None], columns[None, :], g]
    new = (1 - fy) * ((1 - fx) * look(t, l) + fx * look(t, r)) + fy * ((1 - fx) * look(b, l) + fx * look(b, r))
    scale = new / np.maximum(g, 1)
    return np.clip(np.round(image * scale[:, :, None] if image.ndim == 3 else new), 0, 255).astype(np.uint8)


def slant(image: np.ndarray, most: float = MOST_ANGLE, side: int = 400) -> float:
    """IMG5: degrees by which lines of ink fall to the right; found where the rows' sums of the sheared ink differ most, first coarsely."""
    g = resized(grey(image)[:, :, None], side)[:, :, 0]
    ys, xs = np.nonzero(g <= otsu(g)) if (g <= otsu(g)).mean() < 0.5 else np.nonzero(g > otsu(g))
    if len(ys) < 50:
        return 0.0

    def sharp(angle: float) -> float:
        rows = np.round(ys * np.cos(np.radians(angle)) - xs * np.sin(np.radians(angle))).astype(int)
        n = np.bincount(rows - rows.min()).astype(float)
        return float((n * n).sum())

    best = max(np.arange(-most, most + 0.1, 1.0), key=lambda a: (sharp(a), -abs(a)))
    return float(max(np.arange(best - 1, best + 1.01, 0.1), key=lambda a: (sharp(a), -abs(a))))


def rotated(image: np.ndarray, angle: float) -> np.ndarray:
    """IMG5: turned by the angle on a canvas that holds all of it, its border repeated, between pixels by distance."""
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    width, height = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    y, x = np.mgrid[0:height, 0:width].astype(float)
    y, x = y - (height - 1) / 2, x - (width - 1) / 2
    sx, sy = np.clip(c * x - s * y + (w - 1) / 2, 0, w - 1), np.clip(s * x + c * y + (h - 1) / 2, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), max(0, w - 2)), np.minimum(sy.astype(int), max(0, h - 2))
    fx, fy = (sx - x0)[:, :, None], (sy - y0)[:, :, None]
    px = image if image.ndim == 3 else image[:, :, None]
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    out = (1 - fy) * ((1 - fx) * px[y0, x0] + fx * px[y0, x1]) + fy * ((1 - fx) * px[y1, x0] + fx * px[y1, x1])
    return np.clip(np.round(out), 0, 255).astype(np.uint8).reshape(height, width, *image.shape[2:])


def deskewed(image: np.ndarray) -> tuple[np.ndarray, float]:
    """IMG5: (upright image, angle); angles below LEAST_ANGLE are left."""
    angle = slant(image)
    return (image, 0.0) if abs(angle) < LEAST_ANGLE else (rotated(image, angle), angle)


def blurred(g: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian mean, rows and then columns, the border repeated."""
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = g.astype(float)
    for axis in (0, 1):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(wide, np.arange(i, i + n), axis) for i, w in enumerate(k))
    return out


def thresholded(image: np.ndarray, block: int = 19, less: float = 8.0) -> np.ndarray:
    """IMG6: black where a pixel is darker by `less` than the mean around it; dark on light, whichever it was."""
    g = grey(image)
    out = np.where(g > blurred(g, 0.3 * ((max(3, block | 1) - 1) * 0.5 - 1) + 0.8) - less, 255, 0).astype(np.uint8)
    return 255 - out if out.mean() < 127 else out


def handwriting(image: np.ndarray) -> np.ndarray:
    """IMG7: pale writing on a stained ground: the ground, a wide mean, is taken off, contrast is raised, and the threshold is local."""
    image = bgr(image)
    ground = np.stack([blurred(c, 25.0) for c in np.moveaxis(image, 2, 0)], 2)
    flat = np.clip(np.round(np.maximum(ground - image, 0) + 128), 0, 255).astype(np.uint8)
    return bgr(thresholded(equalised(flat, clip=3.0)))


def prepared(image: np.ndarray, longest: int | None = None, noise: bool = False, contrast: bool = True, upright: bool = True, threshold: bool = True) -> tuple[np.ndarray, dict]:
    """IMG8: the steps in their order, and what was done."""
    image = bgr(image)
    size = image.shape[1], image.shape[0]
    image = resized(image, longest) if longest else image
    done = {"size": size, "scale": max(image.shape[:2]) / max(size), "denoised": noise, "clahe": contrast, "binarized": threshold, "deskew_angle": 0.0}
    image = denoised(image) if noise else image
    image = equalised(image) if contrast else image
    if upright:
        image, done["deskew_angle"] = deskewed(image)
    return (bgr(binarised(image)) if threshold else image), done


def dots(image: np.ndarray, side: int = 700) -> np.ndarray:
    """IMG12: a mask of the dotted line: spots of 3 to 26 pixels' height and 3 to 90 pixels' width, two pixels wider."""
    h, w = image.shape[:2]
    if h < 4 or w < 4:
        return np.zeros((h, w), bool)
    small = resized(grey(image)[:, :, None], side)[:, :, 0]
    found = np.zeros(small.shape, bool)
    for x0, y0, x1, y1, _ in components(small <= otsu(small)):
        if 3 <= y1 - y0 <= 26 and 3 <= x1 - x0 <= 90:
            found[y0:y1, x0:x1] = True
    rows, columns = (np.minimum(np.arange(n) * m // n, m - 1) for n, m in zip((h, w), small.shape))
    return _neighbours(found[rows][:, columns], 2).any(-1)


def row_crop(image: np.ndarray, y0: int, y1: int, pad: int, share: float = 0.95) -> np.ndarray:
    """IMG12: a whole row of a form, without the margin on the right."""
    return image[max(0, y0 - pad) : y1 + pad, : int(image.shape[1] * share)]


def label_crop(image: np.ndarray, y0: int, y1: int, dots_x0: int, pad: int, share: float = 0.62) -> np.ndarray:
    """IMG12: what stands left of the dots."""
    return image[max(0, y0 - pad) : y1 + pad, : min(max(10, dots_x0 + 20), int(image.shape[1] * share))]


def value_crop(image: np.ndarray, y0: int, y1: int, dots_x0: int, pad: int) -> np.ndarray:
    """IMG12: what stands on the dots, which are painted white."""
    crop = row_crop(image, y0, y1, pad)[:, max(0, dots_x0 - 10) :].copy()
    if crop.size:
        crop[dots(crop)] = 255
    return crop


def ink_crop(image: np.ndarray, pad: int = 12, dark: int = 200) -> np.ndarray:
    """IMG12: the image around its ink."""
    ys, xs = np.nonzero(grey(image) < dark)
    return image[max(0, ys.min() - pad) : ys.max() + pad + 1, max(0, xs.min() - pad) : xs.max() + pad + 1] if len(ys) else image


def png(image: np.ndarray) -> bytes:
    """IMG14, SNK9: a PNG file of a BGR image."""
    image = bgr(image)[:, :, ::-1]
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def preview(image: np.ndarray, longest: int = 1000) -> str:
    """IMG14: a data address of the scaled-down page."""
    return "data:image/png;base64," + base64.b64encode(png(resized(bgr(image), longest))).decode()
