"""Raster operators in numpy over binary columns. Images are BGR or grey uint8 arrays. Parity with other libraries' resampling is not claimed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

DARK, LEAST_INK = 128, 0.0015


def bgr(image: np.ndarray) -> np.ndarray:
    """IMG1: grey, with alpha, 16-bit or 1-bit to three bytes a pixel."""
    if image.dtype == np.uint16:
        image = (image >> 8).astype(np.uint8)
    elif image.dtype == bool:
        image = image.astype(np.uint8) * 255
    if image.ndim == 2:
        image = image[:, :, None]
    return np.repeat(image[:, :, :1], 3, 2) if image.shape[2] < 3 else np.ascontiguousarray(image[:, :, :3])


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.round(image[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def resized(image: np.ndarray, longest: int) -> np.ndarray:
    """IMG2: scaled down by area so that the longest side is at most `longest`."""
    h, w = image.shape[:2]
    scale = longest / max(h, w)
    if scale >= 1:
        return image
    new = max(1, round(h * scale)), max(1, round(w * scale))
    flat = image.astype(np.float64)
    for axis, (old, size) in enumerate(zip((h, w), new)):
        edges = np.linspace(0, old, size + 1)
        sums = np.concatenate([np.zeros_like(np.take(flat, [0], axis)), np.cumsum(flat, axis)], axis)
        whole = np.floor(edges).astype(int)
        part = (edges - whole).reshape([-1 if k == axis else 1 for k in range(flat.ndim)])
        at = np.take(sums, whole, axis) + part * (np.take(sums, np.minimum(whole + 1, old), axis) - np.take(sums, whole, axis))
        flat = np.diff(at, axis=axis) / (old / size)
    return np.clip(np.round(flat), 0, 255).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """IMG6: the threshold of greatest variance between the two classes."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where((below > 0) & (below < total), between, np.nan))) if ((below > 0) & (below < total)).any() else 127


def binarised(image: np.ndarray) -> np.ndarray:
    """IMG6: 0 for ink and 255 for paper, whichever was the darker."""
    g = grey(image)
    out = np.where(g > otsu(g), 255, 0).astype(np.uint8)
    return 255 - out if out.mean() < 127 else out


def dark_ratio(image: np.ndarray) -> float:
    """FLT7."""
    return float((grey(image) < DARK).mean()) if image.size else 0.0


def ink_rows(image: np.ndarray, least: float = 0.10, gap: int = 3, extent: float = 0.30) -> list[tuple[int, int, int, int]]:
    """IMG11: (y0, y1, x0, x1) of bands of rows with at least `least` ink over at least `extent` of the width; gaps up to `gap` don't part a band."""
    dark = grey(image) < DARK
    rows = np.flatnonzero(dark.mean(1) >= least)
    out = []
    for part in np.split(rows, np.flatnonzero(np.diff(rows) > gap + 1) + 1) if len(rows) else []:
        columns = np.flatnonzero(dark[part[0] : part[-1] + 1].any(0))
        if columns[-1] - columns[0] + 1 >= extent * dark.shape[1]:
            out.append((int(part[0]), int(part[-1]) + 1, int(columns[0]), int(columns[-1]) + 1))
    return out


def text_lines(image: np.ndarray, least: int = 8, most: int | None = None) -> list[tuple[int, int]]:
    """IMG13, SRT7: runs of rows with ink, at least `least` high; with `most`, the first so many of them."""
    rows = np.flatnonzero((grey(image) < DARK).any(1))
    parts = np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1) if len(rows) else []
    return [(int(p[0]), int(p[-1]) + 1) for p in parts if len(p) >= least][:most]


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, pixels) of 4-connected areas, by union of row runs."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            k = len(parent)
            parent.append(k)
            boxes.append([a, y, b, y + 1, b - a])
            for c, d, j in before:
                if c < b and a < d and (r := find(j)) != (q := find(k)):
                    parent[q] = r
                    x, z = boxes[r], boxes[q]
                    boxes[r] = [min(x[0], z[0]), min(x[1], z[1]), max(x[2], z[2]), max(x[3], z[3]), x[4] + z[4]]
            now.append((a, b, k))
        before = now
    return [tuple(boxes[k]) for k in range(len(parent)) if parent[k] == k]


def digit_grids(image: np.ndarray, least: int = 60, most: int = 260, row: int = 20) -> list[dict]:
    """IMG10: rows of squarish drawn cells; 3, 6 or 8 of them are a series, an identifier or a national number."""
    ink = grey(image) < DARK
    cells = [c for c in components(~ink) if least <= c[2] - c[0] <= most and least <= c[3] - c[1] <= most and c[4] >= 0.55 * (c[2] - c[0]) * (c[3] - c[1])]
    lines: list[list] = []
    for c in sorted(cells, key=lambda c: (c[1], c[0])):
        if lines and abs(lines[-1][0][1] - c[1]) <= row:
            lines[-1].append(c)
        else:
            lines.append([c])
    key = {3: "serie", 6: "identifiant", 8: "cin"}
    return [{"key": key[len(x)], "cells": [c[:4] for c in sorted(x)]} for x in lines if len(x) in key]


def has_form_structure(image: np.ndarray) -> bool:
    """FLT9."""
    return bool(digit_grids(image)) or len(ink_rows(image)) >= 3


def stacked(images: list[np.ndarray], gap: int = 48) -> tuple[np.ndarray, list[int]]:
    """IMG15: rows under one another on white, and where each begins."""
    width, tops, y = max(i.shape[1] for i in images), [], 0
    for i in images:
        tops.append(y)
        y += i.shape[0] + gap
    out = np.full((y - gap, width, 3), 255, np.uint8)
    for i, top in zip(images, tops):
        out[top : top + i.shape[0], : i.shape[1]] = bgr(i)
    return out, tops


def signature_ink(image: np.ndarray, box: tuple[float, float, float, float]) -> float | None:
    """VAL13: share of dark pixels in the zone under a signature label; None if the zone is too small."""
    x0, y0, x1, y1 = box
    g = grey(image)
    zone = g[int(y1) : int(min(g.shape[0], y1 + max(90.0, 2.5 * (y1 - y0)))), max(0, int(x0) - 60) : int(min(g.shape[1], x1 + 120))]
    return float((zone < DARK).mean()) if min(zone.shape) >= 10 else None


def tensor(image: np.ndarray, side: int = 28) -> np.ndarray:
    """IMG16: a cell as a square of floats, ink high."""
    g = resized(grey(image), side).astype(np.float32)
    out = np.zeros((side, side), np.float32)
    top, left = (side - g.shape[0]) // 2, (side - g.shape[1]) // 2
    out[top : top + g.shape[0], left : left + g.shape[1]] = 1 - g / 255
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def image_column(function, kind: T.DataType):
    """A function of an image as a column function of (pixels, width, height)."""

    @F.udf(kind, useArrow=True)
    def of(pixels, width, height):
        return None if pixels is None else function(np.frombuffer(pixels, np.uint8).reshape(height, width, -1))

    return of
