"""The FM-index against scanning every window."""

from __future__ import annotations

import random
import re

import numpy as np

from quiltgraph.llm import decontaminate as D

DOCS = "doc_id long, text string, n_words int"
ITEMS = "item_id long, text string, spans int"


def slow(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        words, hit, found = cut(text), set(), set()
        for item, phrase in items:
            p = cut(phrase)
            size = min(len(p), window)
            wanted = {tuple(p[k : k + size]) for k in range(len(p) - size + 1)} if p else set()
            for k in range(len(words) - size + 1 if size else 0):
                if tuple(words[k : k + size]) in wanted:
                    hit.update(range(k, k + size))
                    found.add(str(item))
        out.append((doc_id, len(words), sorted(hit), sorted(found)))
    return out


def cases():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(12)] + ["é", "x1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(2, 14)] + [(20, ""), (21, None), (22, "..."), (2, "zz yy")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "only other words here"), (4, "ZZ-yy; zz  YY")]
    for i in range(40):
        words = rng.choices(vocab, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = (items[rng.randrange(12)][1]).upper().split()
        docs.append((10 + i // 2, ", ".join(words)))
    docs.append((99, "w " * 30000 + items[5][1]))
    return docs, items


def as_rows(df):
    return [(r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], list(r.items)) for r in df.collect()]


def test_matches_scanning(spark):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], DOCS).repartition(3)
    got = as_rows(D.occurrences(df, spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)))
    assert sorted(got) == sorted(slow(docs, items))


def test_blocks_of_phrases_and_small_shards(spark, monkeypatch):
    docs, items = cases()
    docs = list({d: (d, t) for d, t in docs}.values())
    monkeypatch.setattr(D, "BLOCK_PHRASES", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = as_rows(D.occurrences(df, spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(got) == sorted(slow(docs, items))


def test_blocks_keep_repeated_and_null_ids(spark, monkeypatch):
    docs, items = cases()
    docs += [(None, docs[8][1]), (None, docs[9][1]), (None, None)]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    monkeypatch.setattr(D, "BLOCK_PHRASES", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = as_rows(D.occurrences(df, spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(got, key=key) == sorted(slow(docs, items), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert as_rows(D.occurrences(docs, items.limit(0))) == [(1, 2, [], [])]
    assert as_rows(D.occurrences(docs.limit(0), items)) == []


def test_index_locates_every_occurrence():
    rng = np.random.default_rng(0)
    symbols = rng.integers(1, 4, 300)
    starts = np.array([0, 5, 100, 101, 250])
    index = D.FMIndex(symbols, starts, 4)
    cuts = set(starts.tolist())
    for size in (1, 2, 3, 5):
        for _ in range(30):
            phrase = rng.integers(1, 4, size)
            low, high = index.search(phrase[None, ::-1], np.array([size]))
            expected = [k for k in range(300 - size + 1) if (symbols[k : k + size] == phrase).all() and not cuts & set(range(k + 1, k + size))]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == expected
