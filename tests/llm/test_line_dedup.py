"""Site-relative line frequency against counting in Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quiltgraph.llm import line_dedup as L

SCHEMA = "doc_id long, text string, source string, lines string, host_key int"


def slow(rows, ratio=0.1, least=5):
    hosts: dict = {}
    for _, text, host in rows:
        hosts.setdefault(host, []).append({x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")})
    out = []
    for doc, text, host in rows:
        if text is None:
            out.append((doc, None))
            continue
        pages = hosts[host]
        gone = lambda x: (n := sum(x in p for p in pages)) >= least and n > ratio * len(pages)
        out.append((doc, "\n".join(x for x in text.split("\n") if not gone(x))))
    return out


def some_rows():
    rng = random.Random(41)
    lines = [f"line {i}" for i in range(30)] + ["", " ", "\t", "é"]
    weights = [30 // (i + 1) + 1 for i in range(34)]
    rows = [(i, "\n".join(rng.choices(lines, weights, k=rng.randint(0, 8))), rng.choice(["a", "a", "a", "b", None])) for i in range(150)]
    return rows + [(200, None, "a"), (201, "", "b"), (202, "x\n" * 30000, "a"), rows[0], rows[0]]


def test_matches_counting(spark, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    key = lambda x: (x[0], x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in L.without_boilerplate(df).collect()), key=key) == sorted(slow(rows), key=key)
    monkeypatch.setattr(L, "BROADCAST_LINES", 0)
    got = L.without_boilerplate(df, counts=("n_lines", "n_dropped"))
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    before = {(d, t): len(t.split("\n")) if t is not None else 0 for d, t, _ in rows}
    assert sum(r.n_lines for r in got.collect()) == sum(before[d, t] for d, t, _ in rows)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(slow(rows), key=key)


def test_host_of_url(spark):
    urls = ["https://M.Example.com:80/a?b=//c", "http://u@x.org", "ftp://h/#q", "no url"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(L.host_of(F.col("u"))).collect()
    assert [r[0] for r in got] == ["m.example.com", "x.org", "h", ""]


def test_empty_table(spark):
    assert L.without_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
