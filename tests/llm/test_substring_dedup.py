"""Substring dedup against a table of every window."""

from __future__ import annotations

import random

import xxhash

from quiltgraph.llm import substring_dedup as S


def owner(doc, text):
    if doc is not None:
        return (1, doc)
    hashed = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return (0, hashed - (hashed >> 63 << 64))


def slow(rows):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - 19):
            window, place = tuple(words[i : i + 20]), (owner(doc, text), i)
            first[window] = min(first.get(window, place), place)
    out = []
    for doc, text in rows:
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - 19):
            if first[tuple(words[i : i + 20])] != (owner(doc, text), i):
                gone.update(range(i, i + 20))
        out.append((-1 if doc is None else doc, len(words), sorted(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out)


def some_rows(seed=11):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)]
    passages = [rng.choices(vocab, k=rng.choice([19, 20, 21, 35, 80])) for _ in range(6)]
    rows = [(100, None), (101, ""), (102, "few words"), (103, "same " * 300), (None, "same " * 50), (104, "x y " * 40), (105, "long " * 30 + "tail " * 20000)]
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, "  ".join(words)))
    rows += [(200 + i, rows[20 + i][1]) for i in range(10)]
    rows += [(rows[30 + i][0], rows[35 + i][1]) for i in range(5)]  # other texts under a known id
    rows += [(None, rows[40 + i % 6][1]) for i in range(9)]
    rows += [(300, " ".join(passages[3] + passages[4])), (300, " ".join(passages[4] + passages[3])), (300, " ".join(passages[3] + ["end"]))]
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "clash", "x") for d, t in rows], "doc_id long, text string, kept string, keys string").repartition(5)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r.kept) for r in S.removed(df).collect())


def test_matches_a_table_of_windows(spark):
    assert got(spark, some_rows()) == slow(some_rows())


def test_hot_keys_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_KEY", 3)
    monkeypatch.setattr(S, "SHARD_WORDS", 40)
    monkeypatch.setattr(S, "FLUSH_KEYS", 10)
    assert got(spark, some_rows(12)) == slow(some_rows(12))


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"a{i}" for i in range(30))
    assert [r[2] for r in got(spark, [(1, text), (1, text)])] == [[], []]
    assert S.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_texts_of_one_id(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(25)) for c in "pq")
    rows = [(0, q), (5, p), (5, q), (6, p), (None, p), (None, q), (None, q)]
    assert got(spark, rows) == slow(rows)
    rows = [(0, q), (5, p), (5, q), (6, p)]
    assert [(r[0], len(r[2])) for r in got(spark, rows)] == [(0, 0), (5, 0), (5, 25), (6, 25)]


def test_automaton_finds_first_places():
    rng = random.Random(13)
    for _ in range(40):
        texts = [[b"%d" % rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(5)]
        automaton = S.SuffixAutomaton()
        order = rng.sample(range(5), 5)
        offsets = {k: 1000 * k for k in range(5)}
        for k in order:
            automaton.start()
            for j, w in enumerate(texts[k]):
                automaton.add(w, offsets[k] + j)
        automaton.spread()
        for size in (1, 2, 4):
            for k in range(5):
                expected = []
                for j in range(len(texts[k]) - size + 1):
                    want = texts[k][j : j + size]
                    expected.append(min(offsets[m] + i + size - 1 for m in range(5) for i in range(len(texts[m]) - size + 1) if texts[m][i : i + size] == want))
                assert automaton.firsts(texts[k], size) == expected
