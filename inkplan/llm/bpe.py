"""Byte-level BPE with the tokenizers library, over Arrow batches.

A vocabulary file gives a tokenizers BPE model over the 256 characters that stand for bytes. A text is cut by the pattern,
each cut piece is mapped from bytes to those characters and tokenised by the model, and its ids are kept for the next time
the piece turns up. Pieces between white space are independent of what surrounds them, so whole space-delimited units are
kept too; texts with runs of white space are cut by the pattern from end to end. Decoding turns each id into its characters
and those back into bytes; characters split over ids are whole again once their bytes are joined.

Defined cases: a null or empty text has no ids and decodes to nothing; strings of a JSON file's added tokens become those tokens, as
in the library, and with a file of ranks all text is ordinary; lone surrogates are encoded as three bytes each; null doc_ids stay; repeated rows get equal results.
"""

from __future__ import annotations

import base64
import json
from array import array

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from .common import HELD, id_text, map_rows

#: Units and pieces whose ids a worker keeps; beyond that it forgets all and starts again.
MOST_KEPT = 300_000
PATTERN = regex.compile(public_tokenizers.PATTERN)
TAIL = frozenset(".,;:!?|")


def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


CHARACTERS = byte_characters()
TO_CHARACTER = dict(enumerate(CHARACTERS))
TO_BYTE = {c: b for b, c in enumerate(CHARACTERS)}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_CHARACTER)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def model_of(path: str) -> models.BPE:
    """A BPE model from a tokenizers JSON file, or from a file of ranks: there any two neighbours whose
    union has a rank may merge, in order of that rank, and a piece that has a rank is one token."""
    if path.endswith(".json"):
        return Tokenizer.from_file(path).model
    ranks = ranks_of(path)
    merges = [
        (mapped(t[:k]), mapped(t[k:])) for t in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
    ]
    return models.BPE(vocab={mapped(t): k for t, k in ranks.items()}, merges=merges, ignore_merges=True)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers JSON file that stand for their plain strings."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens that look at their neighbours aren't supported")
    return {t["content"]: t["id"] for t in found}


_tables: dict[str, dict[int, bytes]] = {}


def bytes_of(path: str) -> dict[int, bytes]:
    """The bytes of each id: all that decoding needs, by way of the characters' bytes. One for each file and worker."""
    if path not in _tables:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                vocab = json.load(f)["model"]["vocab"]
            own = {k: t.encode() for t, k in added_tokens(path).items()}
        else:
            vocab, own = {mapped(t): k for t, k in ranks_of(path).items()}, {}
        _tables[path] = {k: bytes(TO_BYTE[c] for c in t) for t, k in vocab.items() if all(c in TO_BYTE for c in t)} | own
    return _tables[path]


def decode(table: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Spaces(Exception):
    """White space that a unit's neighbours decide about."""


class Bpe:
    """encode() gives ids as little-endian 32-bit integers."""

    _open: dict[str, "Bpe"] = {}

    def __init__(self, path: str):
        self.path, self.model = path, model_of(path)
        self.added = added_tokens(path)
        self.added_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Bpe":
        """One for each file and worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def tokens(self, piece: str) -> list:
        return self.model.tokenize(mapped(piece.encode("utf-8", "surrogatepass")))

    def piece(self, piece: str) -> bytes:
        if (got := self.pieces.get(piece)) is None:
            got = array("I", [t.id for t in self.tokens(piece)]).tobytes()
            if len(self.pieces) >= MOST_KEPT:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def _unit(self, unit: str, lead: str, kept: dict[str, bytes]) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Spaces
        if unit.isalpha() and unit.isascii():  # a piece of its own, kept once, as a unit
            got = array("I", [t.id for t in self.model.tokenize("\u0120" + unit if lead else unit)]).tobytes()
        elif unit[-1] in TAIL and unit[:-1].isalpha() and unit.isascii():
            got = (kept.get(unit[:-1]) or self._unit(unit[:-1], lead, kept)) + self.piece(unit[-1])
        else:
            got = b"".join(map(self.piece, PATTERN.findall(lead + unit)))
        if len(kept) >= MOST_KEPT:
            kept.clear()
        kept[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.added_cut and any(t in text for t in self.added):
            parts = self.added_cut.split(text)
            return b"".join(self.ordinary(x) if k % 2 == 0 else self.added[x].to_bytes(4, "little") for k, x in enumerate(parts))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        """As encode(), without added tokens."""
        if not text:
            return b""
        out, line_end = [], self.piece("\n")
        after, start = self.after_space, self.at_start
        try:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(start.get(first) or self._unit(first, "", start))
                got = list(map(after.get, rest))
                if None in got:
                    got = [g or self._unit(u, " ", after) for g, u in zip(got, rest)]
                out += got
                out.append(line_end)
            out.pop()
            return b"".join(out)
        except _Spaces:
            return b"".join(map(self.piece, PATTERN.findall(text)))

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first character, end) of each token; tokens that share a split character share its place."""
        out, at = [], 0
        parts = self.added_cut.split(text) if self.added_cut else [text]
        for whole, piece in ((k % 2, x) for k, part in enumerate(parts) for x in ([part] if k % 2 else PATTERN.findall(part))):
            if whole:
                out.append((self.added[piece], at, at + len(piece)))
                at += len(piece)
                continue
            place = np.repeat(np.arange(at, at + len(piece)), [len(c.encode("utf-8", "surrogatepass")) for c in piece])
            for t in self.tokens(piece):
                first, end = t.offsets  # the library counts in the characters it was given: by UTF-8 bytes of the mapped piece
                lead = mapped(piece.encode("utf-8", "surrogatepass")).encode()
                a, b = len(lead[:first].decode()), len(lead[:end].decode())
                out.append((t.id, int(place[a]), int(place[b - 1]) + 1))
            at += len(piece)
        return out

    def decode(self, ids: bytes) -> bytes:
        return decode(bytes_of(self.path), ids)


def encoded(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary): the ids of each text as little-endian 32-bit integers."""

    def make():
        bpe = Bpe.of(path)
        return lambda batch: {"doc_id": batch.column(0), "ids": [bpe.encode(t) for t in batch.column(1).to_pylist()]}

    return map_rows(id_text(df), make, "doc_id long, ids binary", "bpe", by=1)


def decoded(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, raw binary): the bytes that the ids stand for."""

    def make():
        table = bytes_of(path)

        def each(batch):
            ids = batch.column(1).to_pylist()
            return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": batch.column(1), "raw": [decode(table, x) for x in ids]}

        return each

    return map_rows(df.select("doc_id", "ids"), make, "doc_id long, n_tokens long, ids binary, raw binary", "bpe", by=1)


def with_offsets(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends): each token's id and the characters it comes from."""

    def make():
        bpe = Bpe.of(path)

        def each(batch):
            rows = [bpe.offsets(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), **{k: [[t[i] for t in r] for r in rows] for i, k in enumerate(("ids", "starts", "ends"))}}

        return each

    return map_rows(id_text(df), make, "doc_id long, ids array<long>, starts array<long>, ends array<long>", "bpe", by=1)


def _drop() -> None:
    Bpe._open.clear()
    _tables.clear()


HELD["bpe"] = _drop
