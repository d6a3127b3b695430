"""SimHash against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from quiltgraph.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root int"


def slow_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps: list[tuple[int, int]]) -> dict[int, int]:
    root = {d: d for d, _ in fps}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(fps):
        for b, g in fps[:i]:
            if (f ^ g).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in fps}


def some_texts() -> list[tuple[int, str | None]]:
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    texts: list[str | None] = [None, "", "One", "one two", "one two three", "ONE two\tthree", "Été à Paris", "x " * 30000]
    for _ in range(30):
        base = rng.choices(vocab, k=rng.randint(30, 200))
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[rng.randrange(len(near))] = "edited"
            texts.append(" ".join(near))
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    rows = some_texts()
    expected = slow_components([(d, slow_fingerprint(t)) for d, t in rows])
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA).repartition(5)
    got = simhash.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.fp % 2**64 for r in got} == {d: slow_fingerprint(t) for d, t in rows}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {2}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hot_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 4)
    masks = simhash._masks()
    for _ in range(simhash.ROUNDS):
        masks = [f for m in masks[:40] for f in simhash._finer(m)]
    assert all(64 - m.bit_count() <= simhash.BITS_LEFT for m in masks)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), 3):
                g ^= 1 << b
            fps.add(g)
    signed = [(f - (f >> 63 << 64),) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    got = {}
    for (f,) in signed:
        got.setdefault(roots.get(f, f), set()).add(f % 2**64)
    expected = {}
    for f, r in slow_components([(f, f) for f in fps]).items():
        expected.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_hub_and_chain_by_broadcast_and_beyond(spark, monkeypatch):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(9)] + [(7, 7)], "a long, b long")
    expected = {(i, 0) for i in range(1, 300)} | {(501 + i, 500) for i in range(9)}
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == expected
    monkeypatch.setattr(simhash, "BROADCAST_LINKS", 0)
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == expected


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    got = simhash.components(edges).collect()
    assert len(got) == 60 and {r.root for r in got} == {0}


def test_forest_spans_every_component():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 64, 50, dtype=np.uint64)
    left, right = simhash._forest(fps, np.zeros(50, int), 3)
    assert len(left) == len(right) == 49


def runs_of(text: str | None) -> set[tuple[str, ...]]:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    texts: list[str | None] = [None, "", "One", "one", "same " * 300, "same " * 5, "long " + "tail body " * 5000]
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(60, 300))
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 6):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(len(near))] = "edited"
            texts.append(" ".join(near))
        texts.append(" ".join(base + rng.choices(vocab, k=len(base) // 5)))
    return texts


def groups_by_all_pairs(texts: list[str | None]) -> set[frozenset[int]]:
    sets, root = [runs_of(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                root = [root[i] if r == root[j] else r for r in root]
    return {frozenset(i for i, r in enumerate(root) if r == q) for q in set(root)}


def found_groups(spark, texts: list[str | None]) -> set[frozenset[int]]:
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in enumerate(texts)], "row long, text string, node int, wide string").repartition(5)
    out: dict[int, set[int]] = {}
    for r in simhash.similar_groups(df, "row").collect():
        out.setdefault(r.group, set()).add(r.row)
    return set(map(frozenset, out.values()))


def pairs_found(found: set[frozenset[int]], texts: list[str | None]) -> tuple[int, int]:
    """Pairs at a similarity of 0.8 that are in one group, and all of them."""
    group, sets = {i: g for g in found for i in g}, [runs_of(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return sum(group[i] == group[j] for i, j in pairs), len(pairs)


def test_similar_groups_are_those_of_all_pairs(spark):
    texts = similar_texts()
    found, expected = found_groups(spark, texts), groups_by_all_pairs(texts)
    assert all(any(g <= e for e in expected) for g in found)
    hit, n = pairs_found(found, texts)
    assert n > 60 and hit >= 0.95 * n
    assert simhash.similar_groups(spark.createDataFrame([], "row long, text string"), "row").count() == 0


def test_similar_groups_with_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_WIDE", 3)
    rng = random.Random(6)
    base = rng.choices([f"w{i}" for i in range(500)], k=400)
    texts = []
    for k in range(60):
        near = list(base)
        near[rng.randrange(400)] = f"edit{k}"
        texts.append(" ".join(near))
    texts += [" ".join(rng.choices(base, k=100)) for _ in range(20)]
    assert found_groups(spark, texts) == groups_by_all_pairs(texts)


def test_similar_groups_lose_no_link_to_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_WIDE", 2)
    rng = random.Random(7)
    base = rng.choices([f"w{i}" for i in range(500)], k=300)
    texts = []
    for k in range(40):  # twins among texts that are nearly as alike
        one = list(base)
        for at in rng.sample(range(300), 8):
            one[at] = f"one{k}-{at}"
        two = list(one)
        for at in rng.sample(range(300), 5):
            two[at] = f"two{k}-{at}"
        texts += [" ".join(one), " ".join(two)]
    texts += [texts[0] + " " + " ".join(f"x{i}" for i in range(k)) for k in (68, 75, 300)]
    assert found_groups(spark, texts) == groups_by_all_pairs(texts)


def test_runs_are_frequent_by_a_share_of_the_rows(spark):
    """A passage of 60 rows is told as frequent in a table of any size, and only the passage is."""
    rng = random.Random(61)
    shared = " ".join(f"shared{k}" for k in range(12))
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(20)) + (f" {shared}" if i < 60 else "")) for i in range(300)]
    texts = spark.createDataFrame(rows, "row long, text string")
    inside = np.sort(simhash.shingle_hashes(shared.encode(), 5))
    for total in (300, 40_000, 10**6, 10**9):
        runs, counts = simhash._frequent(texts, 5, total)
        assert runs.tolist() == inside.tolist() and counts.min() >= simhash.FREQUENT
    runs, counts = simhash._frequent(texts.limit(0), 5, 0)
    assert len(runs) == len(counts) == 0
