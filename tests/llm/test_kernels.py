"""Kernels against brute force, without Spark."""

import base64
import random
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkplan.llm import bpe, licences, lm, neardup, packing, quality, shingles, suffixes, superkmers, telephony

WORDS = ["a", "b", "cc", "by", "all", "rights", "reserved", "general", "public", "license", "x1"]


def test_codec_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert mu[0xFF] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256


@given(st.binary(max_size=700))
@settings(max_examples=60, deadline=None)
def test_telephony_round_trip(raw):
    payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
    tag, data = telephony.unpack(telephony.pack(payload))
    assert telephony.payload_in(tag, data) == payload
    assert len(telephony.decode_all([(tag, data)])[0]) == (len(payload) if tag != telephony.ADPCM else len(payload) // 192 * 385)


def test_adpcm_against_scalar():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 196), dtype=np.uint8)
    blocks[:, 2] %= 89
    for block, got in zip(blocks, telephony.decode_adpcm(blocks)):
        value, index = struct.unpack("<h", block[:2].tobytes())[0], int(block[2])
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                want.append(value)
        assert got.tolist() == want


@given(st.lists(st.sampled_from(WORDS), max_size=40))
@settings(deadline=None)
def test_licence_places(words):
    a = licences.Automaton(licences.known(), licences.PHRASES, licences.NAMES)
    raw = [w.encode() for w in words]
    places, _, _ = a.scan(raw)
    want = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    assert sorted(places) == sorted(want)


def test_matching_statistics_and_spans():
    a = licences.Automaton(licences.known(), licences.PHRASES, licences.NAMES)
    sequences = [licences.words_of(t) for t in [*(t for _, t in licences.known()), *licences.PHRASES, *licences.NAMES]]
    rng = random.Random(1)
    for _ in range(30):
        s = rng.choice(sequences)
        k = rng.randrange(len(s))
        words = [b"zz", *s[k : k + 9], b"the", b"license", *rng.choice(sequences)[:4]]
        got = {i: n for i, _, n in a.statistics(words)}
        for i in range(len(words)):
            best = max((n for n in range(i + 2) if any(words[i - n + 1 : i + 1] == t[j : j + n] for t in sequences for j in range(len(t) - n + 1))), default=0)
            assert got.get(i, 0) == best
    words = licences.words_of("Text. Permission is hereby granted, free of charge, to any person obtaining a copy of this software. End")
    assert {s[:3] for s in a.scan(words)[1]} == {("mit", 1, 17)}  # of the notice and of the whole licence


def labels(text: str) -> set[str]:
    a = licences.Automaton(licences.known(), licences.PHRASES, licences.NAMES)
    places, spans, _ = a.scan(licences.words_of(text))
    return {x for _, x in places} | {s[0] for s in spans if s[4]}


def test_licence_labels():
    assert labels("under CC BY 4.0 Creative Commons Attribution licence") == {"cc-by"}
    assert labels("This work is licensed under CC BY-NC 4.0 Creative Commons Attribution NonCommercial") == {"cc-by", "cc-by-nc"}
    assert labels("it is free software: you can redistribute it and/or modify it under the terms of the") == set()  # in three notices alike
    for name, text in licences.TEMPLATES.items():
        assert name in labels("some words before " + text + " and after") and licences.Automaton(licences.known(), {}).scan(licences.words_of(text))[2] == 1.0


@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=5, max_size=12), min_size=1, max_size=3), st.lists(st.sampled_from("abcde"), max_size=30))
@settings(max_examples=150, deadline=None)
def test_licence_scan_against_all_places(templates, text):
    """Score, spans and labels from matches found by trying every place of every template."""
    text = [w.encode() for w in text]
    a = licences.Automaton([(str(k), " ".join(t)) for k, t in enumerate(templates)], {})
    every = [[w.encode() for w in t] for t in templates]

    def ends(i: int, n: int) -> list:
        return [(k, j + n - 1) for k, t in enumerate(every) for j in range(len(t) - n + 1) if t[j : j + n] == text[i - n + 1 : i + 1]]

    longest = [max((n for n in range(i + 2) if n and ends(i, n)), default=0) for i in range(len(text))] + [0]
    score, chains, open_ = 0.0, [], {}
    for i, n in enumerate(longest[:-1]):
        if n < 2 or longest[i + 1] > n:
            continue
        found = ends(i, n)
        score = max(score, max(n / len(every[k]) for k, _ in found))
        for k, at in found if n >= licences.LEAST_MATCH else []:
            c = open_.get(k)
            if c and i - n + 1 - c["end"] <= licences.GAP and at > c["at"]:
                if i + 1 > c["end"]:
                    c.update(got=c["got"] + min(n, at - c["at"], i + 1 - c["end"]), end=i + 1, at=at)
            elif not c or i + 1 > c["end"]:
                open_[k] = {"k": k, "first": i - n + 1, "end": i + 1, "at": at, "got": n}
                chains.append(open_[k])
    chains = [c | {"part": min(1.0, c["got"] / len(every[c["k"]]))} for c in chains if c["got"] >= licences.LEAST_CHAIN]

    def best(c) -> bool:
        over = [d for d in chains if d["k"] != c["k"] and d["first"] < c["end"] and d["end"] > c["first"]]
        return c["part"] >= licences.ENOUGH and all((d["part"], d["got"]) < (c["part"], c["got"]) for d in over)

    want = [(str(c["k"]), c["first"], c["end"], c["got"], best(c)) for c in chains]
    _, spans, got = a.scan(text)
    assert sorted(spans) == sorted(want) and abs(got - max([min(1.0, score), *(c["part"] for c in chains)])) < 1e-9


@pytest.mark.parametrize("text", [
    "licensed under the apache license version 1.1", "unless required by applicable law or agreed to in writing the seller pays the tax",
    "it is provided as is without any express or implied warranty of the vendor", "for any purpose with or without fee is hereby granted",
    "permission is hereby granted free of charge to any person who asks at the desk", "in no event will the authors be held liable for any damages to the hall",
    "redistribution and use in source and binary forms was discussed", "the software is provided as is", "the mozilla public license version 1.1 was older", "either express or implied warranties of any kind",
    "you can redistribute it and or modify it as you like", "under the terms of the eclipse contract", "creative commons attribution is a habit",
])
def test_sentences_of_licences_give_no_label(text):
    assert labels("Some words before. " + text + ". Some words after.") == set()


@pytest.mark.parametrize("text, want", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}), ("Released under the MIT License.", {"mit"}), ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl"}), ("GNU Affero General Public License", {"agpl", "gpl"}), ("under the GNU Lesser General Public License", {"lgpl", "gpl"}),
    (licences.WHOLE["mit"], {"mit"}), (licences.WHOLE["bsd"], {"bsd"}), (licences.MIT_END, {"mit"}), (licences.TEMPLATES["agpl"], {"agpl", "gpl"}), (licences.TEMPLATES["lgpl"], {"lgpl", "gpl"}),
    (licences.TEMPLATES["bsl-1.0"] + " " + licences.TEMPLATES["isc"], {"bsl-1.0", "isc"}), ("All rights reserved", {"reserved"}), ("Eclipse Public License 2.0", {"epl-2.0"}), ("Mozilla Public License v. 2.0", {"mpl-2.0"}),
])
def test_licences_and_names_give_their_labels(text, want):
    assert labels("Some words before. " + text + " Some words after.") == want


@pytest.fixture(scope="module")
def vocabularies():
    return bpe.Bpe.of(public_tokenizers.path("byte_bpe_50k.json")), bpe.Bpe.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_against_libraries(vocabularies):
    own, multi = vocabularies
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["", " ", "\n\n", "a\n", "x  y", " a", "a ", "<|endoftext|>", "it's we'll", " x ", "é"]
    texts += ["".join(rng.choice("abé 漢🙂\n\t'1٣\xa0.,|") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice(["aaaa", "abab", "the", " ", "ing", "tion"]) for _ in range(12)) for _ in range(500)]
    for x in texts:
        assert np.frombuffer(own.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
        ids = multi.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(x)
        assert multi.decode(ids) == x.encode()


def test_bpe_offsets(vocabularies):
    text = "naïve 漢字🙂 x"
    got = vocabularies[0].offsets(text)
    assert [g[0] for g in got] == np.frombuffer(vocabularies[0].encode(text), "<u4").tolist()
    assert got[0][1] == 0 and got[-1][2] == len(text) and all(a <= b for _, a, b in got)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=25))
@settings(max_examples=40, deadline=None)
def test_plan_uses_every_piece_once(counts):
    h = np.zeros(65, np.int64)
    for k, v in counts.items():
        h[k] = v
    found = packing.plan(h)
    used = np.zeros(65, np.int64)
    for lengths, times in found.items():
        assert sum(lengths) <= 64
        for v in lengths:
            used[v] += times
    assert (used == h).all()
    assert sum(found.values()) <= sum(packing.best_fit(h).values())


def test_plan_near_the_bound():
    h = np.bincount(np.random.default_rng(0).integers(1, 1025, 20_000), minlength=1025)
    bound = -(-int((h * np.arange(1025)).sum()) // 1024)
    assert sum(packing.plan(h).values()) <= bound * 1.02


@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(letters):
    words = [c.encode() for c in letters]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    assert quality.repeated_words(words) == len(covered)


def test_decision_list_separates():
    rng = np.random.default_rng(1)
    x = {"u": rng.random(3000), "v": rng.random(3000)}
    bad = ((x["u"] > 0.8) & (x["v"] < 0.5)) | (x["u"] < 0.05)
    rules = quality.fit(x, (~bad).astype(int))
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._holds(r, x, 3000)
    assert rules and (hit & ~bad).sum() <= 0.02 * hit.sum() and (hit & bad).sum() > 0.9 * bad.sum()
    assert quality.fit(x, np.ones(3000, int)) == []


@given(st.integers(1, 400), st.integers(0, 30))
@settings(max_examples=40, deadline=None)
def test_signature_of_like_sets(n, changed):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**63, min(changed, len(a)), dtype=np.uint64)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    if j >= 0.85 and len(b):
        x, y = neardup.signature(a), neardup.signature(b)
        assert set(neardup.bands(x)) & set(neardup.bands(y))
        assert (x == y).sum() >= neardup.least_shared(85, np.array([min(len(a), len(b))]))[0]


@given(st.lists(st.binary(min_size=6, max_size=14).map(lambda b: bytes(97 + c % 2 for c in b)), min_size=1, max_size=8), st.randoms())
@settings(deadline=None)
def test_later_windows(strings, rnd):
    n = np.array([len(s) - 5 for s in strings])
    order = np.array(rnd.sample(range(len(strings)), len(strings)))
    old = suffixes.V, suffixes.COVER
    try:
        suffixes.V, suffixes.COVER = 8, suffixes.difference_cover(8)
        # windows of more than V bytes, as in production
        n = np.array([max(1, len(s) - 9) for s in strings])
        some = [s for s in strings if len(s) >= 10]
        if not some:
            return
        keep = [i for i, s in enumerate(strings) if len(s) >= 10]
        n, order = n[keep], order[keep]
        got = suffixes.later(some, n, order, 10)
    finally:
        suffixes.V, suffixes.COVER = old
    windows = [(order[i], j, s[j : j + 10]) for i, s in enumerate(some) for j in range(n[i])]
    want = [any(w == c and (o, j) < (q, k) for o, j, w in windows) for q, k, c in windows]
    assert got.tolist() == want


def test_difference_cover():
    d = np.flatnonzero(suffixes.COVER)
    assert {(a - b) % suffixes.V for a in d for b in d} == set(range(suffixes.V)) and len(d) <= 9


@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), min_size=4, max_size=8), min_size=1, max_size=6))
@settings(deadline=None)
def test_repeated_windows(rows):
    n = np.array([len(r) - 2 for r in rows])
    got = superkmers.repeated([b" ".join(r) for r in rows], n, np.zeros(len(rows), bool), 3)
    windows = [tuple(r[j : j + 3]) for r in rows for j in range(len(r) - 2)]
    assert got.tolist() == [windows.count(w) > 1 for w in windows]


def test_language_model_gradient():
    rng = np.random.default_rng(5)
    model = lm.Model(np.ones(lm.VOCABULARY))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, 20, (4, 3)), rng.integers(0, 20, (4, 3))
    y[0, 0], go_on = lm.OTHER, np.ones((4, 3, 1))
    go_on[2, 1] = 0
    h = np.zeros((3, lm.HIDDEN))

    def loss() -> float:
        out, _, _ = model.gates(x, go_on, h, False)
        return -model.output(out.reshape(-1, lm.HIDDEN), y.ravel())[0].astype(np.float64).sum()

    grad = {k: np.zeros_like(v) for k, v in model.p.items()}
    out, _, held = model.gates(x, go_on, h, True)
    _, ds = model.output(out.reshape(-1, lm.HIDDEN), y.ravel(), grad)
    model.backward(x, go_on, held, ds.reshape(out.shape), grad)
    for k in grad:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-2
        up = loss()
        model.p[k][at] = old - 1e-2
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-2 * max(1, abs(grad[k][at])), k


def test_language_model_sums_to_one_and_carries_state():
    model = lm.Model(np.arange(lm.VOCABULARY, dtype=float))
    s = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    logp, _ = model.output(np.repeat(s, lm.VOCABULARY, 0), np.arange(lm.VOCABULARY))
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4
    doc = np.random.default_rng(1).integers(0, 50, 100).astype(np.int16)
    one = lm.likelihoods(model, [doc])[0]
    with_others = lm.likelihoods(model, [doc[:3], doc, np.repeat(doc, 2)])[1]
    assert abs(one - with_others) < 1e-2
    x = np.concatenate([[lm.END], doc[:-1]])[:, None]
    out, _, _ = model.gates(x, np.ones((len(x), 1, 1), np.float32), np.zeros((1, lm.HIDDEN), np.float32), False)
    assert abs(model.output(out[:, 0], doc.astype(int))[0].sum() - one) < 1e-2


def test_language_model_words_and_symbols():
    """Words split, counted and ranked by column, against one text at a time."""
    texts = ["", " ", "\t a\x0bB\x0c\r\n", "É é İ ß K\x1c\x1f x\x85y z\xa0w \x00 q", "  ABC  abc ", "a" * 5000, *("x%sY b" % chr(i) for i in range(0x2100))]
    words, text = lm.words_of(pa.array(["left out", *texts]).slice(1))
    want = [shingles.lower_words(t) for t in texts]
    assert [(w, k) for k, some in enumerate(want) for w in some] == list(zip(words.to_pylist(), text.tolist()))
    known = [b"b", b"abc", b"a"]
    got = lm.to_symbols(lm.ranked(words, pa.array(known, pa.binary())), text, len(texts))
    assert [g.tolist() for g in got] == [[known.index(w) + 1 if w in known else lm.OTHER for w in some] + [lm.END] for some in want]
    assert [g.tolist() for g in lm.to_symbols(np.zeros(0, np.int32), np.zeros(0, np.int64), 2)] == [[lm.END], [lm.END]]


def test_shingle_sets():
    assert len(shingles.shingle_set([])) == 0 and len(shingles.shingle_set([b"a", b"b"])) == 1
    assert len(shingles.shingle_set([b"a"] * 9)) == 1 and len(shingles.shingle_set([b"%d" % i for i in range(9)])) == 5
