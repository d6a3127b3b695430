"""Quality rules against loops over words, and on held-out labels."""

from __future__ import annotations

import random
import re

import pytest

from quiltgraph.llm import quality as Q

SCHEMA = "doc_id long, text string, kept int, hashes string"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places: dict = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_measures(spark):
    rng = random.Random(31)
    texts = [None, "", " \n\t", "a b", "a b c", "a a a a", "a a a", "x y z x y z", "é😀 #*$%&|<>\n\n \n#\n#", "w " * 30000, "\x0b\x0cone\x1ctwo\x85three"]
    texts += [rng.choice([" ", "\n"]).join(rng.choices(["a", "b", "c#", "dé", "long|er"], k=rng.randint(1, 120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)] + [(0, None, 1, "again")], SCHEMA).repartition(3)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.verdicts(df, none).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(texts[r.row.doc_id])
        assert r.score == 0 and r.kept == (not r.base_failed)


def test_held_out_labels(spark):
    rng = random.Random(32)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    good = [" ".join(rng.choices(vocab, k=80)) for _ in range(120)]
    bad = [" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in rng.choices(vocab, k=80)) for _ in range(40)]
    rows = list(enumerate(good + bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(i, 0) for i in range(120, 130)] + [(7, 1), (None, 1), (9999, 1)], "doc_id long, quality int")
    kept = {r.row.doc_id for r in Q.verdicts(docs, labels).where("kept").collect()}
    assert kept == set(range(120))


def test_model_is_the_smoothed_ratio():
    got = Q.weights({0: (10, 4), 1: (5, 0)}, 3)
    from math import log

    assert got == [round(1000 * log((t + 1) / 7 * 18 / (r + 1))) for r, t in ((10, 4), (5, 0), (0, 0))]
    assert Q.weights({}, 4) == [0] * 4


@pytest.mark.parametrize("n", [0, 1])
def test_empty_table(spark, n):
    docs = spark.createDataFrame([(1, "a")] * n, "doc_id long, text string")
    assert Q.verdicts(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == n
