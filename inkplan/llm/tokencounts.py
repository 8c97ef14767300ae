"""Token counts by the whole-token shortcut: pre-tokens that a vocabulary is proved to encode as one token are counted by a look-up, and only the
others are merged.

What is proved, from the vocabulary file alone and once for each worker:

- A .model file (sentencepiece BPE) has no pre-tokens of its own, but a merge makes a piece of the vocabulary or nothing. Where no piece has
  another character before the space sign, no merge goes over that place, so a text falls apart before each run of spaces, and its parts are
  encoded on their own. whole: the pieces "space sign + string" whose string the library encodes, alone, as that one piece.
- A .json file (tokenizers BPE) brings its normaliser and its pre-tokenizer. whole: the vocabulary's strings that the model encodes as one token.

A slice of texts is cut by Arrow, its different pre-tokens are looked up in the proved set all at once, and those that remain are merged by the
library, each once in a slice or not at all where a worker still knows its number; sums over the texts' pre-tokens are the counts. No shuffle;
memory is that of a slice and of MOST_KEPT numbers.

Defined cases: a null or empty text has no tokens and no bytes; runs of spaces, and spaces at either end, are pre-tokens or parts of them, as in
the library; the space sign (U+2581) in a text counts as a space, as in the library; characters outside the vocabulary count by their bytes where
the file has byte pieces; strings of control tokens are plain text for a .model file, and added tokens for a .json file, the libraries' defaults;
null doc_ids stay, repeated rows get equal results, other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import added_tokens
from .common import HELD, id_text, map_rows

#: sentencepiece's sign for a space.
SIGN = "▁"
#: Merged pre-tokens, of at most so many characters, whose numbers of tokens a worker keeps; beyond that it forgets all and starts again.
MOST_KEPT, LONGEST_KEPT = 300_000, 64
#: Tokens that a text may have before over_limit is true.
LIMIT = 4096


class Pieces:
    """Of a sentencepiece BPE model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        kinds, form = proto.ModelProto.SentencePiece, spec.normalizer_spec
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("only BPE models without user-defined and unused pieces are supported")
        if form.precompiled_charsmap or form.remove_extra_whitespaces or not (form.add_dummy_prefix and form.escape_whitespaces) or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that take texts as they are, with a space before them, are supported")
        strings = [p.piece for p in spec.pieces if p.type == kinds.NORMAL]
        if across := next((s for s in strings if re.search(f"[^{SIGN}]{SIGN}", s)), None):
            raise ValueError(f"the piece {across!r} goes over the start of a word")
        tried = [s[1:] for s in strings if len(s) > 1 and s[0] == SIGN and SIGN not in s[1:]]
        whole = [s for s, ids in zip(tried, self.library.encode(tried)) if [self.library.id_to_piece(i) for i in ids] == [SIGN + s]]
        self.whole = pa.array(whole, pa.string())
        self.alone = int(SIGN in strings) or len(SIGN.encode())  # what a space of its own counts
        self.kept: dict[str, int] = {}

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of all texts, each without the space sign that it begins with, and where each text's begin and the last ends."""
        texts = pc.replace_substring(texts, SIGN, " ")
        odd = pc.or_(pc.match_substring_regex(texts, "^ | $|  "), pc.equal(texts, ""))
        if pc.any(odd).as_py():  # runs of spaces stay with what follows them
            rows = [re.findall(" *[^ ]+| +", " " + t) if o and t else [] if o else (" " + t).split(" ")[1:] for t, o in zip(texts.to_pylist(), odd.to_pylist())]
            rows = [[u[1:] for u in r] if o else r for r, o in zip(rows, odd.to_pylist())]
            return pa.array([u for r in rows for u in r], pa.string()), np.cumsum([0, *map(len, rows)])
        parts = pc.split_pattern(texts, " ")
        return parts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])

    def merged(self, units: list[str]) -> list[int]:
        return [len(x) if u else self.alone for u, x in zip(units, self.library.encode(units, num_threads=1))]


class Model:
    """Of a tokenizers file with a BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.normal, self.pre = self.library.model, self.library.normalizer, self.library.pre_tokenizer
        end = getattr(self.model, "end_of_word_suffix", None) or ""
        tried = [s.removesuffix(end) for s in self.library.get_vocab(with_added_tokens=False) if s.endswith(end)]
        self.whole = pa.array(sorted(s for s in tried if s and len(self.model.tokenize(s)) == 1), pa.string())
        self.added = added_tokens(path)
        self.kept: dict[str, int] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ordinary(self, text: str) -> list[str]:
        text = self.normal.normalize_str(text) if self.normal else text
        return [u for u, _ in self.pre.pre_tokenize_str(text)] if self.pre else [text] * bool(text)

    def units(self, text: str) -> list[str | None]:
        """None stands for an added token."""
        if self.split is None or not self.split.search(text):
            return self.ordinary(text)
        return [u for k, part in enumerate(self.split.split(text)) for u in ([None] if k % 2 else self.ordinary(part))]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        rows = [self.units(t) for t in texts.to_pylist()]
        return pa.array([u for r in rows for u in r], pa.string()), np.cumsum([0, *map(len, rows)])

    def merged(self, units: list[str | None]) -> list[int]:
        return [1 if u is None else len(self.model.tokenize(u)) for u in units]


_open: dict[str, Pieces | Model] = {}
HELD["tokencounts"] = _open.clear


def vocabulary(path: str) -> Pieces | Model:
    """One for each file and worker."""
    if path not in _open:
        _open[path] = Model(path) if path.endswith(".json") else Pieces(path)
    return _open[path]


def looked_up(vocab: Pieces | Model, units: list[str | None]) -> list[int]:
    """As merged(), from what the worker has kept where it can."""
    found = list(map(vocab.kept.get, units))
    new = [u for u, n in zip(units, found) if n is None]
    known = dict(zip(new, vocab.merged(new)))
    if len(vocab.kept) + len(new) > MOST_KEPT:
        vocab.kept.clear()
    vocab.kept.update((u, n) for u, n in known.items() if u is None or len(u) <= LONGEST_KEPT)
    return [known[u] if n is None else n for u, n in zip(units, found)]


def count(vocab: Pieces | Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of tokens of each text, and of its pre-tokens that were whole tokens."""
    units, ends = vocab.cut(texts)
    coded = units.dictionary_encode(null_encoding="encode")
    different = coded.dictionary
    direct = pc.is_in(different, value_set=vocab.whole).to_numpy(zero_copy_only=False)
    tokens = np.ones(len(different), np.int64)
    tokens[~direct] = looked_up(vocab, different.filter(pa.array(~direct)).to_pylist())
    at = coded.indices.to_numpy(zero_copy_only=False)
    sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (tokens, direct.astype(np.int64))]
    return tuple(s[ends[1:]] - s[ends[:-1]] for s in sums)


def counts(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_whole): n_whole is the number of pre-tokens that were counted without merging."""

    def make():
        vocab = vocabulary(path)

        def each(batch):
            tokens, whole = count(vocab, batch.column(1))
            return {
                "doc_id": batch.column(0), "n_bytes": pc.binary_length(batch.column(1)).cast(pa.int64()), "n_tokens": pa.array(tokens),
                "over_limit": pa.array(tokens > limit), "n_whole": pa.array(whole),
            }

        return each

    return map_rows(id_text(df), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long", "tokencounts", by=1)
