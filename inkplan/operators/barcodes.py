"""IMG9: EAN-13, UPC-A and EAN-8 codes that stand upright on a page, read along rows; two-dimensional codes need a detector of the caller's."""

from __future__ import annotations

import time

import numpy as np

from .raster import grey, otsu

# Widths of the four bars and gaps of each digit, and by the first digit which of the next six are written mirrored.
WIDTHS = ["3211", "2221", "2122", "1411", "1132", "1231", "1114", "1312", "1213", "3112"]
MIRRORED = ["000000", "001011", "001101", "001110", "010011", "011001", "011100", "010101", "010110", "011010"]
PLAIN = {tuple(map(int, w)): str(d) for d, w in enumerate(WIDTHS)}
BACK = {k[::-1]: v for k, v in PLAIN.items()}


def check_ok(digits: str) -> bool:
    """The weighted sum of a code is a multiple of ten."""
    return sum(int(c) * (3 if k % 2 else 1) for k, c in enumerate(reversed(digits))) % 10 == 0


def _digit(runs: np.ndarray) -> tuple[str, bool] | None:
    """(digit, mirrored) of four run lengths."""
    modules = runs * 7 / runs.sum()
    whole = np.maximum(1, np.round(modules).astype(int))
    if whole.sum() != 7:  # the run that was rounded worst gives way
        k = int(np.argmax((modules - whole) * np.sign(7 - whole.sum())))
        whole[k] += 7 - whole.sum()
    key = tuple(whole.tolist())
    return (PLAIN[key], False) if key in PLAIN else (BACK[key], True) if key in BACK else None


def _code(runs: np.ndarray, half: int) -> str | None:
    """The digits of a code of 2 * half digits from its runs: guards of three, five and three around the halves."""
    unit = runs[:3].mean()
    guards = np.concatenate([runs[:3], runs[3 + 4 * half : 8 + 4 * half], runs[-3:]])
    if (np.abs(guards - unit) > 0.6 * unit).any():
        return None
    left = [_digit(runs[3 + 4 * k : 7 + 4 * k]) for k in range(half)]
    right = [_digit(runs[8 + 4 * half + 4 * k : 12 + 4 * half + 4 * k]) for k in range(half)]
    if None in left or None in right or any(m for _, m in right):
        return None
    which = "".join("1" if m else "0" for _, m in left)
    first = "" if half == 4 and which == "0000" else str(MIRRORED.index(which)) if half == 6 and which in MIRRORED else None
    if first is None:
        return None
    digits = first + "".join(d for d, _ in left + right)
    return digits if check_ok(digits) else None


def scan(image: np.ndarray, step: int = 4, budget_s: float | None = None) -> list[tuple[str, str, tuple[int, int, int, int]]]:
    """(digits, type, box) of the codes of a page: every step-th row is read, and rows that show the same code make its box. budget_s: how long the
    search may take, for previews; without it the whole page is read."""
    g, found, began = grey(image), {}, time.perf_counter()
    dark = g <= otsu(g)
    for y in range(0, len(g), step):
        if budget_s is not None and time.perf_counter() - began > budget_s:
            break
        edges = np.flatnonzero(np.diff(dark[y].astype(np.int8))) + 1
        runs = np.diff(edges).astype(float)
        for half in (6, 4):
            n = 8 * half + 11
            for k in range(len(runs) - n + 1):
                if dark[y, edges[k]] and np.ptp(runs[k : k + 3]) <= 0.6 * runs[k : k + 3].mean() and (digits := _code(runs[k : k + n], half)):
                    kind = "EAN_8" if half == 4 else "UPC_A" if digits[0] == "0" else "EAN_13"
                    x0, y0, x1, y1 = found.get((digits, kind), (edges[k], y, edges[k + n], y))
                    found[digits, kind] = min(x0, edges[k]), y0, max(x1, edges[k + n]), y
    return [(d[1:] if kind == "UPC_A" else d, kind, (int(b[0]), int(b[1]), int(b[2]), int(b[3]) + 1)) for (d, kind), b in found.items()]


def masked(image: np.ndarray, boxes: list[tuple[int, int, int, int]], pad: int = 4) -> np.ndarray:
    """The page with its codes painted white, so that they aren't read as text."""
    out = image.copy()
    for x0, y0, x1, y1 in boxes:
        out[max(0, y0 - pad) : y1 + pad, max(0, x0 - pad) : x1 + pad] = 255
    return out
