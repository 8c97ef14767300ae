"""Quality rules: an ordered list of threshold conjunctions learned from labelled statistics.

measure() gives the statistics of each text, learn() fits a decision list to labelled ones by
sequential covering (grow a conjunction on two thirds of the rows, prune it on the rest, move a threshold or go on growing
it where it still takes good rows, remove what it covers and repeat; a rule must shorten the description of rules and
exceptions), and condition() turns the list into one Spark CASE expression.

Defined cases: a null or empty text has no words and all counts 0; a label that is null or
contradicted by another row of the same doc_id is not used; without labels of both kinds the list is
empty and every document is kept; ties between thresholds go to the first statistic and the lower
threshold; repeated rows get equal results; columns that clash with ours are not read.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text, let_go, map_rows

#: The most labelled documents that learn() uses, those with the least hash of their id.
MAX_LABELLED = 20_000
WINDOW = 3
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?.,;:\"'()[]{}=+-_/\\@~^`"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_marks long"
#: Statistics that a rule may test: name and SQL over the counts.
RATIOS = {
    "length": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
}


def without(raw: bytes, drop: bytes) -> int:
    return len(raw) - len(raw.translate(None, drop))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(ids) - window + 1
    if n < 2:
        return 0
    keys, span = ids[:n], len(known)
    for k in range(1, window):
        if span > 2**62 // len(known):  # keep the keys within 63 bits
            keys, span = np.unique(keys, return_inverse=True)[1], n
        keys, span = keys * len(known) + ids[k : n + k], span * len(known)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(np.count_nonzero(covered))


def counts(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = repeated_words(words)
    return (
        len(words), len(raw.translate(None, SPACES + CONTINUED)), without(raw, SYMBOLS), len(lines) - len(set(lines)), repeat,
        len(lines), without(raw, UPPER), without(raw, DIGITS), without(raw, MARKS),
    )


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts of COUNTS) for each row."""

    def make():
        names = [part.split()[0] for part in COUNTS.split(",")]

        def each(batch):
            rows = [counts(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), **dict(zip(names, zip(*rows)))}

        return each

    return map_rows(id_text(df, id_col, text_col), make, f"doc_id long, {COUNTS}", by=1)


def labelled(df: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """The statistics of at most `most` labelled documents, with `good` 0 or 1."""
    sample = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("good")).dropna()
        .groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("most"))
        .where("good = most").drop("most")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # The sample's size is bounded by `most`, so it may be broadcast.
    docs = id_text(df).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")  # of several texts with one doc_id, always the same
    docs = docs.groupBy("doc_id").agg(first).select("doc_id", "first.text")
    return measure(docs).join(F.broadcast(sample), "doc_id")


Rule = list[tuple[str, str, float]]  # (statistic, "<" or ">=", threshold), all of which must hold


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, sign, at in rule:
        out &= x[name] < at if sign == "<" else x[name] >= at
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, rule: Rule | None = None) -> Rule:
    """Adds the condition of greatest information gain until only bad rows are covered."""
    rule = list(rule or [])
    inside = _holds(rule, x, len(bad))
    while len(rule) < most and inside.any() and not bad[inside].all():
        p0, best = bad[inside].mean(), (0.0, None)
        if p0 == 0:
            return []
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
            if not len(cuts):
                continue
            below_bad, below = np.cumsum(b)[cuts - 1], cuts
            for sign, got_bad, got in (("<", below_bad, below), (">=", b.sum() - below_bad, len(b) - below)):
                gain = got_bad * (np.log2(np.maximum(got_bad, 1e-9) / got) - np.log2(p0))
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], (name, sign, float((v[cuts[k]] + v[cuts[k] - 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(rule[-1:], x, len(bad))
    return rule


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The conditions of the rule whose (bad - good) / (bad + good) on these rows is greatest; of equals those that cover more, then the fewest."""
    held = [_holds([c], x, len(bad)) for c in rule]
    best = None
    for keep in itertools.chain.from_iterable(itertools.combinations(range(len(rule)), k) for k in range(1, len(rule) + 1)):
        inside = np.logical_and.reduce([held[k] for k in keep])
        n, wrong = int(inside.sum()), int((inside & ~bad).sum())
        worth = ((n - 2 * wrong) / n if n else -1.0, n, -len(keep))
        if best is None or worth > best[0]:
            best = (worth, keep)
    return [rule[k] for k in best[1]]


def _moved(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, precision: float, least: int) -> Rule | None:
    """The rule with one threshold moved so that it covers the most rows of which `precision` are bad, and at least `least`; None: none does."""
    best = (least - 1, None)
    for k, (name, sign, _) in enumerate(rule):
        inside = _holds(rule[:k] + rule[k + 1 :], x, len(bad))
        v, b = x[name][inside], bad[inside]
        order = np.argsort(v if sign == "<" else -v, kind="stable")
        v, n = v[order], np.arange(1, len(order) + 1)
        ends = np.append(v[1:] != v[:-1], True) & (np.cumsum(b[order]) >= precision * n) if len(v) else np.zeros(0, bool)
        if ends.any() and n[ends][-1] > best[0]:
            last = int(np.flatnonzero(ends)[-1])
            beyond = v[last + 1] if last + 1 < len(v) else v[last] + (1 if sign == "<" else -1)
            best = (n[last], [*rule[:k], (name, sign, float((v[last] + beyond) / 2)), *rule[k + 1 :]])
    return best[1]


def _merged(rule: Rule) -> Rule:
    """Of conditions on the same side of a statistic, the narrowest."""
    out: dict[tuple[str, str], float] = {}
    for name, sign, at in rule:
        out[name, sign] = at if (name, sign) not in out else (min if sign == "<" else max)(out[name, sign], at)
    return [(name, sign, at) for (name, sign), at in out.items()]


def _bits(n: int, k: int) -> float:
    """What it takes to say how many and which k of n rows are exceptions."""
    return math.log2(n + 1) + (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2)


def _length(rules: list[Rule], x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    """The description length of the rules and of the rows that they get wrong."""
    covered = np.zeros(len(bad), bool)
    for r in rules:
        covered |= _holds(r, x, len(bad))
    condition = math.log2(len(x)) + 1 + math.log2(max(2, len(bad)))
    return sum(1 + len(r) * condition for r in rules) + _bits(int(covered.sum()), int((covered & ~bad).sum())) + _bits(int((~covered).sum()), int((~covered & bad).sum()))


def fit(x: dict[str, np.ndarray], good: np.ndarray, precision: float = 0.99, least: int = 5, rules: int = 12, conditions: int = 4) -> list[Rule]:
    """Rules for bad documents, in order. Of the rows that a rule takes from those left by the rules before, at least `precision` are bad, and it
    takes at least `least`; so clean documents stay. Of a rule that isn't as pure a threshold is moved, or it is grown further on the rows it takes; if
    neither helps, or if the rule takes more to describe than the rows that it settles, its rows are set aside, and the rest is covered."""
    bad = np.asarray(good) == 0
    fold = np.random.default_rng(7).permutation(len(bad)) % 3
    left, aside, found = np.ones(len(bad), bool), np.zeros(len(bad), bool), []
    shortest = _length([], x, bad)
    for _ in range(4 * rules):
        open_ = left & ~aside
        if len(found) == rules or not bad[open_].any():
            break
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        rule = _grow(*part(open_ & (fold != 2)), conditions)
        if not rule:
            break
        rule = _pruned(rule, *part(open_ & (fold == 2))) if bad[open_ & (fold == 2)].any() else rule
        broad, taken = rule, lambda r: _holds(r, x, len(bad)) & left
        pure = lambda r: (rows := taken(r)).sum() >= least and bad[rows].mean() >= precision
        if not pure(rule):
            rule = _moved(rule, *part(left), precision, least) or rule
        if not pure(rule):
            rule = _grow(*part(open_), 2 * conditions, rule) or rule
        if not pure(rule) or (length := _length([*found, _merged(rule)], x, bad)) >= shortest:
            aside |= taken(broad) if (taken(broad) & open_ & bad).any() else open_ & bad
            continue
        found.append(_merged(rule))
        left &= ~_holds(rule, x, len(bad))
        shortest = length
    return found


def learn(df: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    """The decision list. At most `most` rows of statistics reach the driver."""
    rows = labelled(df, labels, most).selectExpr("good", *[f"cast({sql} as double) as {name}" for name, sql in RATIOS.items()], "doc_id").toPandas()
    rows = rows.sort_values("doc_id")
    if rows.good.nunique() < 2:
        return []
    return fit({n: rows[n].to_numpy(float) for n in RATIOS}, rows.good.to_numpy())


def condition(rules: list[Rule], within: str | None = None) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does. within: a struct column that has the counts."""
    names = "|".join(part.split()[0] for part in COUNTS.split(","))
    case = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, at in rule:
            value = F.expr(re.sub(rf"\b({names})\b", rf"`{within}`.\1", RATIOS[name]) if within else RATIOS[name])
            test = test & (value < at if sign == "<" else value >= at)
        case = F.when(test, k) if case is None else case.when(test, k)
    return F.lit(0) if case is None else case.otherwise(0)


def judge(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The counts with `rule` (of condition()) for each document."""
    return measure(df).withColumn("rule", condition(rules).cast("int"))


def accepted(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of df that no rule rejects, with all their columns."""

    @F.pandas_udf(COUNTS)
    def stats(texts: pd.Series) -> pd.DataFrame:
        let_go()
        return pd.DataFrame([counts(t) for t in texts], columns=[part.split()[0] for part in COUNTS.split(",")])

    held = fresh(df, "stats")
    measured = df.withColumn(held, stats(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    return measured.where(condition(rules, held) == 0).drop(held)
