"""Operators 11 to 13 against brute force and the libraries, odd cases included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkplan.llm import periods, registry, spelling, tokencounts

from .test_operators import LONG, SCHEMA, raw, texts


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), True, "x", 1, 2, "r") for i, t in rows], SCHEMA).repartition(3)


def plain_runs(s: list, least: int, times: int) -> list[tuple]:
    """(start, length, period), by the definition: stretches whose words q apart are equal, for each q, each with its smallest q."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i >= q and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, e - a, q) for (a, e), q in found.items())


def plain_words(doc_id, text: str | None, change: bool) -> list[bytes]:
    words = raw(text).split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if change and words and h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_collapse(words: list[bytes], found: list[tuple]) -> bytes:
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (3, 3), (1, 2), (9, 5)])
def test_runs_of_many_texts_at_once(least, times):
    rng = random.Random(least * times)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            letters = rng.choice([1, 2, 3, 5])
            d = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
            docs.append(d + (unit * 12)[: rng.choice([0, rng.randint(1, 60)])])
        ids, doc = np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        at = np.cumsum([0, *map(len, docs)]).tolist()
        want = [(a + o, a + o + n, q) for d, o in zip(docs, at) for a, n, q in plain_runs(d, least, times)]
        assert list(zip(*(x.tolist() for x in periods.runs(ids, doc, least, times)))) == want


def test_runs_in_long_texts():
    one, fib = np.zeros(200_000, np.int64), ["0", "01"]
    assert [x.tolist() for x in periods.runs(one, one)] == [[0], [200_000], [1]]
    while len(fib[1]) < 3000:
        fib = [fib[1], fib[1] + fib[0]]
    ids = np.frombuffer(fib[1].encode(), np.uint8).astype(np.int64)
    for least, times in ((2, 2), (2, 3), (6, 4)):
        want = plain_runs(ids.tolist(), least, times)
        assert [(a, e - a, q) for a, e, q in zip(*(x.tolist() for x in periods.runs(ids, np.zeros(len(ids), np.int64), least, times)))] == want


def test_periods_odd_cases(spark):
    rows = [(k + 10, t) for k, t in texts()] + [(None, "null id " * 40), (None, None), (3, "a b " * 9), (3, "a b " * 9), (4, "x\x0by\x1cz " * 12), (5, "w" * 100_000 + " w" * 20)]
    got = periods.collapsed(table(spark, rows), change=True).collect()
    by = Counter((r.doc_id, r.text.encode(), tuple(zip(r.starts, r.lengths, r.periods))) for r in got)
    want = Counter()
    for i, t in rows:
        words = plain_words(i, t, True)
        found = plain_runs(words, 6, 4)
        want[(i, plain_collapse(words, found), tuple(found))] += 1
    assert by == want and any(r.starts for r in got)
    assert periods.digests(table(spark, rows).limit(0)).collect() == []


def test_period_query(spark, sf_dir):
    got = {r.doc_id: r for r in registry.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = plain_words(d.doc_id, d.text, True)
        found, r = plain_runs(words, 6, 4), got[d.doc_id]
        assert r.n_runs == len(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (best[2] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(words, found)).hexdigest()


def plain_forms(rows: list[tuple]) -> dict:
    """All words against all words, by deleting each character of each."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            run = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    near, cut = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            cut[i, w[:i] + w[i + 1 :]].append(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in cut.values():
        for w in group:
            near[w] |= {v for v in group if v != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def as_forms(df) -> dict:
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("most", [2, 8, 256])
def test_spelling_blocks_divided(spark, most):
    rng, words = random.Random(most), set()
    for _ in range(25):
        w = "".join(rng.choice("abéÉ") for _ in range(rng.randint(7, 10)))
        words |= {w} | {w[:i] + c + w[i + rng.randint(0, 1) :] for i in range(len(w)) for c in ("", "a", "b")}
    words |= {"z" * 80 + c for c in ("", "a", "b", "ab")} | {"y" * 7, "y" * 8, "y" * 9}
    rows = [(i, " ".join(w.upper() if k % 7 == 0 and w.isascii() else w for k, w in enumerate(sorted(words)) for _ in range(rng.choice([1, 1, 3, 40])))) for i in range(6)]
    rows += [(None, " ".join(sorted(words))), (None, None), (7, ""), (7, "1 2 _ abc"), (7, " ".join(["x" * 2000, "x" * 2000, "x" * 2001, "x" * 2001])), (8, "qwqwqwq " * 3 + "qwqwqwqe " * 40 + "qwqwqwqer " * 500)]
    got, want = as_forms(spelling.forms(spark, table(spark, rows), most=most)), plain_forms(rows)
    assert got == want
    assert any(f for f, *_ in want.values()) and any(root not in (w, f) for w, (f, root, *_) in want.items())
    assert as_forms(spelling.forms(spark, table(spark, rows).limit(0), most=most)) == {}


def test_spelling_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert as_forms(registry.QUERIES["op12_spelling"](spark, sf_dir)) == plain_forms(docs)


MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", " ", "▁", "a", "b", "th", "ing", ".", ",", "\n", "\t", "é", "漢", "\U0001f642", "<s>", "</s>", "\x00", "  ", "123", "1", "The", "﻿", "ﬁ", "<|endoftext|>", "'s", " ", "<0x41>"]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(n)
    return ["", " ", "  ", "▁", "▁ ", *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n))]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_equal_the_libraries(name):
    path, some = public_tokenizers.path(name), odd_texts(4000)
    vocab = tokencounts.vocabulary(path)
    got, whole = tokencounts.count(vocab, pa.array(some))
    if name.endswith(".json"):
        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    else:
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(some)]
    assert got.tolist() == want and 0 < whole.sum() < got.sum()


def test_token_count_proof():
    """Each string that is counted by look-up is one token of its library, in the middle of a text too."""
    library, whole = sentencepiece.SentencePieceProcessor(model_file=MODEL), tokencounts.vocabulary(MODEL).whole.to_pylist()
    assert len(whole) > 10_000
    assert all(len(x) == 1 for x in library.encode(whole)) and len(library.encode(" ".join(whole))) == len(whole)


def test_token_counts_odd_cases(spark):
    rows = [(k, t) for k, t in texts()] + [(None, "null id"), (None, None), (3, "a b"), (3, "a b"), (9, "x" * LONG), (10, "word " * 5000), (11, " ".join(["a"] * 4096)), (12, " ".join(["a"] * 4097))]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter(tuple(r)[:4] for r in tokencounts.counts(table(spark, rows), MODEL).collect())
    assert got == Counter((i, len(raw(t)), n := len(library.encode(t or "")), n > 4096) for i, t in rows)
    assert tokencounts.counts(table(spark, rows).limit(0), MODEL).collect() == []


def test_token_count_query(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.QUERIES["op13_token_counts"](spark, sf_dir).collect()}
    assert got == {d.doc_id: (len(raw(d.text)), n := len(library.encode(d.text or "")), n > 4096) for d in docs}
