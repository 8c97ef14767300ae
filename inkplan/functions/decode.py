"""Functions that have no column form: the character decoder, string similarity, digit windows, and a unigram tokenizer.
Each is a plain Python function with an Arrow function beside it."""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a character may have been, in order of preference.
AS_TEXT = {
    "0": ["O", "o"], "1": ["i", "I", "l"], "5": ["S", "s"], "8": ["B", "b"], "&": ["E", "e"], "4": ["A", "a"], "7": ["T", "t"], "6": ["G", "g"],
    "2": ["Z", "z"],
}
AS_DIGITS = {
    "O": ["0"], "o": ["0"], "Q": ["0"], "I": ["1"], "l": ["1"], "L": ["1"], "i": ["1"], "S": ["5"], "s": ["5"], "B": ["8"], "b": ["8"],
    "&": ["2", "8"], "@": ["2"], "Z": ["2"], "z": ["2"],
}
# Frequent letter sequences; those of three letters only weigh in the sums.
FREQUENT = [
    "th", "en", "an", "er", "ou", "on", "st", "la", "le", "de", "ch", "re", "qu", "ai", "es", "in", "ss", "ll", "rr", "ee", "oo", "nn", "dd", "bb",
    "mm", "ay", "ia", "ie", "io", "iou", "ion", "eau", "eur", "ain", "ois",
]
# Fixed values of the model: the weight of a character as read, alone and beside alternatives; the prior's power; the weight of single letters in
# it; what a share has at least; the count that each letter starts from.
ALONE, AS_READ, PRIOR, SINGLE, TINY, START = 0.99, 0.1, 0.5, 1.6, 1e-9, 0.5
# Fixed values of the model: the characters that it counts as letters, and what parts the words of a reading.
LETTERS = "abcdefghijklmnopqrstuvwxyz" "ABCDEFGHIJKLMNOPQRSTUVWXYZ" "àâäéèêëîïôöùûüçœ" "ÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ" "' -"
SEPARATOR = re.compile(r"([^A-Za-zÀ-ÖØ-öø-ÿ0-9&@\-'']+)")
MANY_BLANKS = re.compile(r"\s{2,}")


class Decoder:
    """TXT13, SRT6: the most likely intended characters of a reading.

    A reading is a hidden chain: each intended character was read as it stands or as a character that it is confused with, and follows the one
    before by a prior over letter pairs. The prior only looks back one character, so the best chain is found exactly, for all words of a length
    at once: scores[word, alternative] after each position, the predecessors kept, and the best chain read back from its end. Of equally
    good chains the one whose alternatives come first is taken. longest: cuts readings to so many characters before they are decoded."""

    def __init__(self, longest: int | None = None, pairs: dict[str, float] | None = None, confusions: dict | None = None, letters: dict | None = None):
        self.longest = longest
        self.alternatives = {kind: dict(table) for kind, table in (("text", AS_TEXT), ("digit", AS_DIGITS))}
        for kind, table in (confusions or {}).items():
            self.alternatives.setdefault(kind, {}).update({c: list(others) for c, others in table.items()})
        pairs = dict(pairs) if pairs else dict.fromkeys(FREQUENT, 1.0)
        count = dict.fromkeys(LETTERS + "0123456789", START)
        for c, weight in [(c, w) for p, w in pairs.items() if len(p) == 2 for c in p.lower()] + [(c, max(0.0, w)) for c, w in (letters or {}).items() if c in count]:
            count[c] = count.get(c, 0.0) + weight
        total = sum(count.values())
        # A letter's number is its row and column in the table of transitions; 0 stands for all that the model doesn't know.
        known = sorted({c for c in count if c == c.lower()} | {c for p in pairs if len(p) == 2 for c in p.lower()})
        self.number = {c: k for k, c in enumerate(known, 1)}
        weight = np.zeros((len(known) + 1, len(known) + 1))
        weight[:, 1:] = [SINGLE * count.get(c, 0.0) / total for c in known]
        for p, w in pairs.items():
            if len(p) == 2 and p == p.lower():
                weight[self.number[p[0]], self.number[p[1]]] += w
        norm = sum(x / total for x in count.values()) + sum(pairs.values()) + TINY
        self.follows = PRIOR * np.log(np.maximum((weight + TINY) / norm, TINY))

    def chains(self, words: list[str], kind: str) -> list[str]:
        """The best chains of words of one length."""
        table = self.alternatives.get(kind, {})
        options = {c: [c, *table.get(c, [])] for c in set("".join(words))}
        most = max(map(len, options.values()))
        codes = {c: k for k, c in enumerate(options)}
        number = np.zeros((len(codes), most), np.int64)
        read = np.full((len(codes), most), -np.inf)
        for c, k in codes.items():
            n = len(options[c])
            number[k, :n] = [self.number.get(o.lower(), 0) for o in options[c]]
            read[k, :n] = math.log(ALONE) if n == 1 else [math.log(AS_READ)] + [math.log((1 - AS_READ) / (n - 1))] * (n - 1)
        text = np.array([[codes[c] for c in w] for w in words])
        score, came = read[text[:, 0]], []
        for at in range(1, text.shape[1]):
            step = self.follows[number[text[:, at - 1]][:, :, None], number[text[:, at]][:, None, :]]
            reached = score[:, :, None] + read[text[:, at]][:, None, :] + step
            came.append(reached.argmax(1))
            score = reached.max(1)
        best = score.argmax(1)
        picked = [best]
        for back in reversed(came):
            best = back[np.arange(len(words)), best]
            picked.append(best)
        names = list(options.values())
        return ["".join(names[c][o] for c, o in zip(row, chosen)) for row, chosen in zip(text, np.array(picked[::-1]).T)]

    def decode_all(self, texts: list[str | None], kind: str = "text") -> list[tuple[str, float, bool]]:
        """(value, confidence, changed) of each text."""
        plain = [(t or "").strip()[: self.longest] for t in texts]
        parts = [SEPARATOR.split(p) for p in plain]
        by_length: dict[int, set[str]] = {}
        unsure = self.alternatives.get(kind, {}).keys()
        for word in {w for p in parts for w in p if w[:1].isalnum() and not unsure.isdisjoint(w)}:
            by_length.setdefault(len(word), set()).add(word)
        best: dict[str, str] = {}
        for some in map(sorted, by_length.values()):
            best.update(zip(some, self.chains(some, kind)))
        out = []
        for p, words in zip(plain, parts):
            value = "".join(best.get(w, w) for w in words)
            known = sum(c.isdigit() or c in LETTERS for c in value)
            ragged = len(MANY_BLANKS.findall(value))
            sure = min(1.0, known / len(value) * (0.85 + 0.15 * math.exp(-ragged / 2))) if value else 0.0
            out.append((value, round(sure, 4), value != p))
        return out

    def decode(self, text: str | None, kind: str = "text") -> tuple[str, float, bool]:
        return self.decode_all([text], kind)[0]


DECODER = Decoder()


def decoder_column(kind: str = "text", decoder: Decoder = DECODER):
    @F.pandas_udf("struct<value:string,confidence:double,changed:boolean>")
    def decoded(texts: pd.Series) -> pd.DataFrame:
        different = list(texts.unique())  # each different reading once
        known = dict(zip(different, decoder.decode_all(different, kind)))
        return pd.DataFrame([known[t] for t in texts], columns=["value", "confidence", "changed"])

    return decoded


def ratio(a: str, b: str) -> float:
    """TXT17: the Ratcliff-Obershelp ratio; not symmetric."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def ratio_column(a: pd.Series, b: pd.Series) -> pd.Series:
    known = {p: ratio(p[0] or "", p[1] or "") for p in set(zip(a, b))}  # each different pair once
    return pd.Series([known[p] for p in zip(a, b)])


def digit_windows(text: str, length: int, slack: int = 1) -> list[tuple[str, int]]:
    """TXT10: windows of `length` digits over runs that only blanks and light separators part, each with a penalty of one for an end off
    a run's border (two such ends rule it out), and whole runs within `slack` of the length at no penalty."""
    out = []
    for group in re.finditer(r"[0-9]+(?:[ \t./|,\-]+[0-9]+)*", text):
        runs = re.findall("[0-9]+", group[0])
        whole, borders = "".join(runs), [0]
        for r in runs:
            borders.append(borders[-1] + len(r))
        for a in range(len(whole) - length + 1):
            penalty = (a not in borders[:-1]) + (a + length not in borders[1:])
            if penalty < 2:
                out.append((whole[a : a + length], penalty))
        out += [(r, 0) for r in runs if abs(len(r) - length) <= slack]
    return out


def digit_windows_column(text: Column, length: int, slack: int = 1) -> Column:
    """digit_windows() as an expression: array<struct<window, penalty>>."""

    def of(g: Column) -> Column:
        runs, whole, ends = g["runs"], F.array_join(g["runs"], ""), g["ends"]
        last = F.length(whole) - length
        starts = F.array_insert(F.slice(ends, 1, F.size(ends) - 1), 1, F.lit(0))
        at = F.transform(
            F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
            lambda a: F.struct(
                F.substring(whole, a + 1, F.lit(length)).alias("window"),
                ((~F.array_contains(starts, a)).cast("int") + (~F.array_contains(ends, a + length)).cast("int")).alias("penalty"),
            ),
        )
        alone = F.transform(F.filter(runs, lambda r: F.abs(F.length(r) - length) <= slack), lambda r: F.struct(r.alias("window"), F.lit(0).alias("penalty")))
        return F.concat(F.filter(at, lambda w: w["penalty"] < 2), alone)

    def measured(g: Column) -> Column:
        runs = F.regexp_extract_all(g, F.lit("[0-9]+"), F.lit(0))
        ends = F.transform(runs, lambda _, k: F.aggregate(F.slice(runs, F.lit(1), k + 1), F.lit(0), lambda s, r: s + F.length(r)))
        return F.struct(runs.alias("runs"), ends.alias("ends"))

    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:[ \t./|,\-]+[0-9]+)*"), F.lit(0))
    return F.flatten(F.transform(F.transform(groups, measured), of))


def nearest(value: str, names: list[str], least: float) -> str | None:
    """JN13: the first of the names most like the value, if like enough."""
    probe = "".join(c for c in value.upper() if c.isalnum())
    if len(probe) < 2:
        return None
    best = max(names, key=lambda n: ratio(probe, n))
    return best if ratio(probe, best) >= least else None


def nearest_column(names: list[str], least: float):
    @F.pandas_udf(T.StringType())
    def near(values: pd.Series) -> pd.Series:
        known = {v: nearest(v or "", list(names), least) for v in values.unique()}
        return pd.Series([known[v] for v in values], dtype=object)

    return near


class UnigramTokenizer:
    """TXT15: the pieces of a vocabulary with log-probabilities whose sum is greatest; spaces are marked, unknown characters cost `unknown`."""

    def __init__(self, scores: dict[str, float], unknown: float = -20.0, mark: str = "▁"):
        self.scores, self.unknown, self.mark = scores, unknown, mark
        self.number = {p: k for k, p in enumerate(scores)}
        self.longest = max(map(len, scores), default=1)

    def pieces(self, text: str) -> list[str]:
        s = self.mark + text.replace(" ", self.mark)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(s)
        for end in range(1, len(s) + 1):
            for start in range(max(0, end - self.longest), end):
                p = s[start:end]
                score = self.scores.get(p, self.unknown if end - start == 1 else None)
                if score is not None and best[start][0] + score > best[end][0]:
                    best[end] = (best[start][0] + score, start)
        out, end = [], len(s)
        while end:
            out.append(s[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def encode(self, text: str, unknown_id: int = -1) -> list[int]:
        return [self.number.get(p, unknown_id) for p in self.pieces(text)]

    def decode(self, ids: list[int]) -> str:
        names = list(self.scores)
        return "".join(names[i] for i in ids if 0 <= i < len(names)).replace(self.mark, " ").strip()
