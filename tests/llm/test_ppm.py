"""PPM against a model that follows the definition byte by byte."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quiltgraph.llm import ppm

SCHEMA = "doc_id long, text string, score string"


def slow_grams(texts):
    out = Counter()
    for t in texts:
        for i in range(len(t)):
            for k in range(4):
                if i >= k:
                    out[t[i - k : i + 1]] += 1
    return out


def slow_log(grams, context, byte):
    excluded, reach = set(), 1.0
    for k in range(min(3, len(context)), -1, -1):
        c = context[len(context) - k :]
        here = {g[-1]: n for g, n in grams.items() if len(g) == k + 1 and g[:-1] == c and g[-1] not in excluded}
        if not here:
            continue
        whole = sum(here.values()) + len(here)
        if byte in here:
            return math.log10(reach * here[byte] / whole)
        reach *= len(here) / whole
        excluded |= set(here)
    return math.log10(reach / (256 - len(excluded)))


def some_rows():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))).title()) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "zzz unseen \x00"), (None, "abc abc"), (7, rows[7][1])]


def test_matches_the_definition(spark):
    rows = some_rows()
    train = [(t or "").encode() for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    tokens = Counter(x for t in train for x in [*t.lower().split(), "end"])
    n, v = sum(tokens.values()), len(tokens)
    grams = slow_grams(train)
    expected = []
    for d, text in rows:
        data = (text or "").encode()
        own = [*data.lower().split(), "end"]
        base = sum(math.log10((tokens[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        score = sum(slow_log(grams, data[max(0, i - 3) : i], b) for i, b in enumerate(data))
        out = d is not None and zlib.crc32(str(d).encode()) % 10 == 0
        expected.append((-1 if d is None else d, out, len(own), sum(x in tokens for x in own), n, base, score))
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.scored(df).collect()]
    for a, b in zip(sorted(got), sorted(expected), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_rare_tokens_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(d, t) for d, t in some_rows()], "doc_id long, text string")
    before = sorted((str(r.doc_id), r.n_known, round(r.base_score, 9)) for r in ppm.scored(df).collect())
    monkeypatch.setattr(ppm, "MAX_FREQUENT", 20)
    monkeypatch.setattr(ppm, "KEPT_TOKENS", 5)
    monkeypatch.setattr(ppm, "CHUNK", 50)
    assert sorted((str(r.doc_id), r.n_known, round(r.base_score, 9)) for r in ppm.scored(df).collect()) == before


def test_counts_and_chances():
    texts = [b"abracadabra", b"", b"\x00\xff", b"ab"]
    codes, counts = ppm.gram_counts(texts)
    got = {int(c & (1 << 40) - 1).to_bytes(int(c) >> 40, "big"): int(n) for c, n in zip(codes, counts, strict=True)}
    assert got == dict(slow_grams(texts))
    trie = ppm.Trie(got)
    assert np.allclose((10.0**trie.logs).sum(axis=1), 1, atol=1e-4)


def test_empty_table(spark):
    assert ppm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_context_counts(spark, monkeypatch):
    """A context seen once in 200,000 bytes has its own statistics, broadcast or joined."""
    rare = ["世界和", "жук"]
    texts = [(1, "ab" * 100_000), (3, rare[0]), (4, rare[1]), (5, rare[0] + rare[1]), (6, "abba"), (None, "世")]
    outside = [d for d in range(10, 200) if ppm.held_out(d)][:3]
    texts += [(outside[0], rare[0]), (outside[1], "界世 new"), (outside[2], "")]
    grams = slow_grams([t.encode() for d, t in texts if not ppm.held_out(d)])
    checked = texts[1:]
    expected = [sum(slow_log(grams, t.encode()[max(0, i - 3) : i], b) for i, b in enumerate(t.encode())) for _, t in checked]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    scores = lambda: {r.doc_id: r.score for r in ppm.scored(df).collect()}
    got = scores()
    assert [got[d] for d, _ in checked] == pytest.approx(expected, rel=1e-5)
    for most in (6, 0):
        monkeypatch.setattr(ppm, "MAX_GRAMS", most)
        got = scores()
        assert [got[d] for d, _ in checked] == pytest.approx(expected, rel=1e-5)
