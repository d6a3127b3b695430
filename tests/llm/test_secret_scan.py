"""Base spans against Python's re; the models against held-out strings."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from quiltgraph.llm import secret_scan as S

SCHEMA = "doc_id long, text string, spans string"


def slow_base(text):
    text = text or ""
    assign = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


TEXTS = [
    None, "", "nothing here", "token=token: abcdefgh", "password = 'hunter22' PASSWD:\"abc\" Api_Key=x-y.z/w+=", "😀 secret=abcdef 😀 ſecret=abcdef",
    "AKIA" + "Q" * 16 + " AKIA12 AKIAAKIA" + "Z9" * 8, "x" * 40000 + " token=abcdefghi", "0123456789abcdef01234567 0123456789abcdef0123456", "apikey:abcdef\napi_key :  tok.en=1",
    "password==abcde secret='''x", "deadbeef" * 5 + "g" + "0" * 24,
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, "the quick brown foxes of reading thentionder and Anotherhouse_number willing") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    return S.trained(S.random_samples(spark).unionByName(S.ordinary_samples(docs, labels)))


def test_base_spans(spark, model):
    rng = random.Random(4)
    parts = ["token", "=", ":", " ", "'", "AKIA", "SECRET", "abc", "0a1b2c", "é", "passwd", "api_key", "\n", "_", "Z" * 16, "f" * 12]
    texts = TEXTS + ["".join(rng.choices(parts, k=30)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, None, "again")], SCHEMA).repartition(4)
    for r in S.spans(df, model).collect():
        got = [(s.start, s.kind, s.end) for s in r.spans]
        assert [x for x in got if x[1] < 3] == slow_base(texts[r.row.doc_id])
        assert got == sorted(got)
        assert all((texts[r.row.doc_id] or "")[s.start : s.end] == s.text for s in r.spans)


def slow_score(sample, table):
    """Mean step weight of a string: start, then each character after the one before."""
    codes = [0, *[S.ALPHABET.find("_" if c in "+/" else c) + 1 or S.WIDTH - 1 for c in sample]]
    return sum(table[a * S.WIDTH + b] for a, b in zip(codes, codes[1:], strict=False)) / len(sample)


def test_added_spans_against_a_slow_scorer(spark, model):
    rng = random.Random(12)
    kinds = ["abcdefghijklmnop", "ABCDEFGHabcdefgh0123456789+/", "thequickbrownreading_", "0123456789-"]
    texts = [" ".join("".join(rng.choices(rng.choice(kinds), k=rng.randint(5, 45))) for _ in range(6)) for _ in range(150)]
    texts += ["token=" + "aB3" * 12, "x" * 19, "q7" * 10, "/" + "Zx9" * 8 + " é" + "k2J" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in S.spans(df, model).collect():
        text = texts[r.row.doc_id]
        base = slow_base(text)
        runs = [m for m in re.finditer(S.RUN, text) if slow_score(m[0], model) > S.THRESHOLD * S.SCALE]
        added = [(m.start(), 3, m.end()) for m in runs if not any(a <= m.start() and e >= m.end() for a, _, e in base)]
        assert [(s.start, s.kind, s.end) for s in r.spans] == sorted(base + added)


def test_weights_count_as_repeated_samples(spark):
    schema = "sample string, random int, weight long"
    once = spark.createDataFrame([("abc", 0, 3), ("x1Y", 1, 1), (None, 0, 2)], schema)
    again = spark.createDataFrame([("abc", 0), ("abc", 0), ("abc", 0), ("x1Y", 1)], "sample string, random int")
    assert S.trained(once) == S.trained(again)


def test_models_tell_held_out_strings_apart(spark, model):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    random_ones = ["".join(rng.choices(letters, k=32)) for _ in range(200)] + [hashlib.md5(str(i).encode()).hexdigest()[:23] + "Z" for i in range(50)]
    ordinary = ["_".join(rng.choices(["the", "quick", "reading", "number", "and", "house", "willing"], k=5)) for _ in range(200)] + ["4785380592391139478538"]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(random_ones + ordinary)], "doc_id long, text string")
    flagged = {r.row.doc_id for r in S.spans(df, model).collect() if any(s.kind == 3 for s in r.spans)}
    assert len(flagged & set(range(250))) >= 240
    assert len(flagged - set(range(250))) <= 4


def test_untrained_and_empty(spark):
    table = S.trained(spark.createDataFrame([], "sample string, random int"))
    assert set(table) == {0}
    assert S.spans(spark.createDataFrame([], "doc_id long, text string"), table).count() == 0
