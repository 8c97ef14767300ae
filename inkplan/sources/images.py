"""Image files to BGR arrays without further libraries: PNG and TIFF, all pages. Other formats need a splitter of the caller's."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

from ..operators.raster import bgr

# The TIFF tags that are read, and the bytes of the types of their values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 320
TYPES = {1: "B", 3: "H", 4: "I"}


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: runs of literal and of repeated bytes."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the widths as TIFF changes them."""
    out, table, last = bytearray(), [], b""
    value = bits = at = 0
    width = 9
    while True:
        while bits < width and at < len(data):
            value, bits, at = (value << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        if bits < width:
            return bytes(out)
        code = value >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table):
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


UNPACK = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}


#: Gives so many bytes from an offset on.
Cut = Callable[[int, int], bytes]


def directory(cut: Cut) -> Iterator[tuple[str, dict[int, tuple]]]:
    """SRC4: (byte order, tags) of each page of a TIFF file; only the pages' heads are read."""
    head = cut(0, 8)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    at, seen = struct.unpack_from(order + "I", head, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n, tags = struct.unpack(order + "H", cut(at, 2))[0], {}
        body = cut(at + 2, 12 * n + 4)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", body, 12 * k)
            if kind in TYPES:
                form = f"{order}{count}{TYPES[kind]}"
                size = struct.calcsize(form)
                place = cut(struct.unpack_from(order + "I", body, 12 * k + 8)[0], size) if size > 4 else body[12 * k + 8 : 12 * k + 12]
                tags[tag] = struct.unpack_from(form, place)
        yield order, tags
        at = struct.unpack_from(order + "I", body, 12 * n)[0]


def tiff(content: bytes) -> Iterator[np.ndarray]:
    """SRC4: each page of a TIFF file of strips: 1, 8 or 16 bits, grey, RGB, palette or CMYK."""
    cut = lambda at, n: content[at : at + n]
    for order, tags in directory(cut):
        yield page(cut, tags, order)


def page(cut: Cut, tags: dict[int, tuple], order: str) -> np.ndarray:
    """One page, by its tags from directory()."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, bits, samples, kind = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(SAMPLES, 1), one(PHOTOMETRIC, 0)
    unpack = UNPACK.get(one(COMPRESSION, 1))
    if unpack is None or bits not in (1, 8, 16):
        raise ValueError("a TIFF of another compression or depth")
    raw = b"".join(unpack(cut(o, c)) for o, c in zip(tags[OFFSETS], tags[COUNTS]))
    if bits == 1:
        line = (w * samples + 7) // 8
        px = np.unpackbits(np.frombuffer(raw, np.uint8, line * h).reshape(h, line), axis=1)[:, : w * samples].reshape(h, w, samples) * 255
    else:
        px = np.frombuffer(raw, f"{order}u{bits // 8}", w * h * samples).reshape(h, w, samples)
        if one(PREDICTOR, 1) == 2:
            px = np.cumsum(px, axis=1, dtype=px.dtype.newbyteorder("="))
        px = (px >> 8 if bits == 16 and kind != 3 else px).astype(np.uint8)
    if kind == 3:
        table = np.array(tags[PALETTE], np.uint32).reshape(3, -1) >> 8
        return table[::-1, px[:, :, 0]].transpose(1, 2, 0).astype(np.uint8)
    if kind == 5:
        ink = 255 - px[:, :, :4].astype(int)
        return (ink[:, :, 2::-1] * ink[:, :, 3:] // 255).astype(np.uint8)
    if kind == 0:
        px = 255 - px
    return bgr(px if samples < 3 else px[:, :, 2::-1])


def png(content: bytes) -> np.ndarray:
    """SRC3: a PNG file without interlacing, of 8 or 16 bits."""
    at, data, head, table = 8, [], b"", None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        head = body if kind == b"IHDR" else head
        table = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" else table
        data += [body] if kind == b"IDAT" else []
        at += 12 + size
    w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if interlaced or bits not in (8, 16):
        raise ValueError("a PNG with interlacing or of another depth")
    step = samples * bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w * step), np.uint8)
    for y in range(h):
        out[y + 1] = _filtered(int(rows[y, 0]), rows[y, 1:], out[y], step)
    px = out[1:].reshape(h, w, step)[:, :, :: bits // 8]
    if colour == 3:
        return table[px[:, :, 0]][:, :, ::-1]
    return bgr(px[:, :, :1] if samples < 3 else px[:, :, 2::-1])


def _filtered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out, up = line.astype(int).tolist(), above.tolist()
    for k in range(len(out)):
        a, b, c = (out[k - step], up[k], up[k - step]) if k >= step else (0, up[k], 0)
        if kind == 3:
            near = (a + b) // 2
        else:
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (out[k] + near) & 255
    return np.array(out, np.uint8)


def split(content: bytes, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """SRC3, SRC4, SRC6: (page, image) of a file, by what it begins with."""
    content = bytes(content)
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        yield 0, png(content)
    elif content[:4] in (b"II*\0", b"MM\0*"):
        yield from enumerate(tiff(content))
    else:
        raise ValueError("neither PNG nor TIFF")
