"""Telephony audio columns: mu-law, A-law and IMA ADPCM containers, decoded and resampled.

store() writes each payload as a WAV file whose samples are the payload's bytes (8-bit mu-law or
A-law codes, or 4-bit ADPCM codes two a byte, in blocks with a header each), so that the payload
comes back bit for bit. read() takes such files, gives the payload and the expanded PCM, and the
16 kHz PCM file resampled from it.

Defined cases: a null or empty text is the 192-byte payload of spaces; equal texts give equal
files; a null doc_id stays null; other columns are dropped; a file that isn't one of these three
kinds, or is cut short, or whose blocks have another size, has null payload and feature.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows

UNIT = 192  # bytes of payload in a block
MULAW, ALAW, ADPCM = 7, 6, 17  # WAV format tags
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}

# The ADPCM step sizes and index moves of the IMA recommendation.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * step index + code: the change of the predictor, and 16 * the next step index."""
    step, code = np.repeat(STEPS, 16), np.tile(np.arange(16, dtype=np.int32), len(STEPS))
    change = (step >> 3) + (code >> 2 & 1) * step + (code >> 1 & 1) * (step >> 1) + (code & 1) * (step >> 2)
    moved = np.clip(np.repeat(np.arange(len(STEPS)), 16) + MOVES[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32), (moved * 16).astype(np.int32)


EXPAND = {MULAW: mulaw_table(), ALAW: alaw_table()}
CHANGE, NEXT = adpcm_tables()


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wav(tag: int, rate: int, data: bytes, bits: int, align: int, extra: bytes = b"", samples: int = 0) -> bytes:
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * align if tag != ADPCM else rate * align // 385, align, bits, len(extra)) + extra
    fact = b"" if tag == 1 else struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body) + len(data) % 2) + body + b"\0" * (len(data) % 2)


def pack(payload: bytes) -> bytes:
    """The stored file. Its kind follows from the payload alone."""
    tag = (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]
    if tag != ADPCM:
        return wav(tag, 8000, payload, 8, 1, samples=len(payload))
    blocks = np.zeros((len(payload) // UNIT, 4 + UNIT), np.uint8)  # each block starts from predictor 0, step index 0
    blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    per = 2 * UNIT + 1
    return wav(ADPCM, 8000, blocks.tobytes(), 4, 4 + UNIT, struct.pack("<H", per), len(blocks) * per)


def unpack(media: bytes) -> tuple[int, bytes]:
    """(format tag, sample data) of a WAV file of one channel and one of the three kinds."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, align = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            tag, channels, _, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if tag not in NAMES or channels != 1 or align != (4 + UNIT if tag == ADPCM else 1):
                raise ValueError("another format")
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
            if not tag or len(data) < size or size % align:
                raise ValueError("no whole blocks")
            return tag, data
        at += 8 + size + size % 2
    raise ValueError("no data")


def payload_in(tag: int, data: bytes) -> bytes:
    return data if tag != ADPCM else np.frombuffer(data, np.uint8).reshape(-1, 4 + UNIT)[:, 4:].tobytes()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 196) bytes to (n, 385) samples: one step for each code, over all the blocks at once."""
    head = blocks[:, :4].copy()
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(head[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.empty((2 * UNIT, len(blocks)), np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((2 * UNIT + 1, len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * UNIT):
        state += codes[k]
        value += CHANGE[state]
        np.clip(value, -32768, 32767, out=value)
        state = NEXT[state]
        out[k + 1] = value
    return out.T


def doubled(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: the samples, and between them the four-tap half-band mean (-1, 9, 9, -1) / 16."""
    x = np.empty(len(pcm) + 3, np.int32)
    x[1:-2], x[0], x[-2:] = pcm, pcm[0], pcm[-1]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def measures(tag: int, pcm: np.ndarray) -> str:
    level = int(np.sqrt(np.mean(np.square(pcm, dtype=np.float64))))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{NAMES[tag]};samples={len(pcm)};peak={int(np.abs(pcm.astype(np.int32)).max())};rms={level};turns={turns}"


def decode_all(parts: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """PCM of each (tag, data); the ADPCM blocks of all of them are decoded together."""
    blocks = [np.frombuffer(d, np.uint8).reshape(-1, 4 + UNIT) for t, d in parts if t == ADPCM]
    flat = decode_adpcm(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for tag, data in parts:
        if tag == ADPCM:
            n = len(data) // (4 + UNIT)
            out.append(flat[at : at + n].ravel())
            at += n
        else:
            out.append(EXPAND[tag][np.frombuffer(data, np.uint8)])
    return out


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the text's bytes as a telephony WAV file."""

    def make():
        def each(batch):
            payloads = [payload_of(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "n_bytes": batch.column(2), "media": [pack(p) for p in payloads]}

        return each

    docs = id_text(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return map_rows(docs, make, "doc_id long, n_bytes long, media binary", by=1)


def read(df: DataFrame, media_col: str = "media", pcm: bool = True) -> DataFrame:
    """df's doc_id, n_bytes and file, with what reading the file back gives: the payload's digests, the
    features of the decoded sound and the resampled 16 kHz file (pcm=False: only its digest)."""

    def make():
        def each(batch):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256", "pcm")}
            files, parts = batch.column(2).to_pylist(), []
            for media in files:
                try:
                    parts.append(unpack(media))
                except (ValueError, TypeError, struct.error):
                    parts.append(None)
            sounds = iter(decode_all([p for p in parts if p]))
            for part, media in zip(parts, files):
                out["media_bytes"].append(None if media is None else len(media))
                out["media_sha256"].append(None if media is None else hashlib.sha256(media).hexdigest())
                if not part:
                    for k in ("payload_bytes", "payload_sha256", "tail_crc32", "feature", "pcm_bytes", "pcm_sha256", "pcm"):
                        out[k].append(None)
                    continue
                back, sound = payload_in(*part), next(sounds)
                wide = doubled(sound) if len(sound) else sound
                file = wav(1, 16000, wide.astype("<i2").tobytes(), 16, 2)
                for k, v in (
                    ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-16:])),
                    ("feature", measures(part[0], wide) if len(wide) else f"{NAMES[part[0]]};samples=0"),
                    ("pcm_bytes", len(file)), ("pcm_sha256", hashlib.sha256(file).hexdigest()), ("pcm", file if pcm else None),
                ):
                    out[k].append(v)
            return {"doc_id": batch.column(0), "n_bytes": batch.column(1), **out}

        return each

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return map_rows(df.select("doc_id", "n_bytes", df[media_col].alias("media")), make, schema + (", pcm binary" if pcm else ""), by=2)
